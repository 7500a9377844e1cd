"""What surrounds models: decoding of their outputs, prompts, captions, evidence.

Models themselves are tables of outputs here (or any Arrow UDF that makes such a table); all that
is done with their outputs is done by Spark.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import geometry as G
from ..functions import text as T

# Least scores of tokens, read items and faces; a face's least side; the box grid.
NER_SCORE, OCR_SCORE, FACE_SCORE, FACE_SIDE = 0.3, 0.5, 0.6, 5
# Types that a caption may name.
CAPTION_KEEPS = ("COUNTRY", "GENDER", "ORGANIZATION", "ORG", "COMPANY", "COMPANY_NAME", "NATIONALITY", "LANGUAGE")


def read_items(boxes: DataFrame) -> DataFrame:
    """Read texts (x, y, w, h, text, confidence) as items with a box; blank ones and those under
    0.5 go."""
    ok = (T.clean(F.col("text")) != "") & (F.coalesce("confidence", F.lit(0.0)) >= OCR_SCORE)
    return boxes.where(ok).withColumn("box", G.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))).drop("x", "y", "w", "h")


def token_labels(tokens: DataFrame, logits: str, names: list[str]) -> DataFrame:
    """tokens with label and score: the likeliest of `names` by the softmax of their logits."""
    p = T.softmax(F.col(logits))
    at = F.array_position(F.col("veil_p"), F.array_max("veil_p"))
    out = tokens.withColumn("veil_p", p)
    return out.withColumn("label", F.element_at(F.array(*map(F.lit, names)), at.cast("int"))).withColumn("score", F.array_max("veil_p")).drop("veil_p")


def token_offsets(text: Column, tokens: Column) -> Column:
    """(start, end) of each token text by a search from the end of the last one; trimmed if need
    be, empty where a token is not found."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def add(s: Column, t: Column) -> Column:
        whole = F.call_function("locate", t, text, s.at + 1)
        bare = F.trim(t)
        trimmed = F.call_function("locate", bare, text, s.at + 1)
        first = F.when(bare == "", 0).when(whole > 0, whole).otherwise(trimmed)
        size = F.when(whole > 0, F.length(t)).otherwise(F.length(bare))
        a = F.when(first > 0, first - 1).otherwise(s.at)
        b = F.when(first > 0, a + size).otherwise(s.at)
        return F.struct(b.alias("at"), F.concat(s.out, F.array(F.struct(a.alias("start"), b.alias("end")))).alias("out"))

    return F.aggregate(tokens, start, add, lambda s: s.out)


def adjacent_entities(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces (keys, entity, start, end, score) of one entity that touch (a gap of one at most) as
    one, with the least of their scores."""
    w = W.partitionBy(*keys).orderBy("start", "end")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    new = (F.lag("entity").over(w).isNull() | (F.lag("entity").over(w) != F.col("entity")) | (F.col("start") > F.max("end").over(before) + 1)).cast("int")
    runs = pieces.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.first("entity").alias("entity"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("score").alias("score")).drop("run")


def word_entities(tokens: Column) -> Column:
    """Entities of an array of tokens (text, label, score, start, end) in order, with mean scores.

    A token that continues a word (no space before it) belongs to the open entity whatever its own
    label. O, labels without a type and scores under 0.3 close it; I of the same type goes on.
    """
    entity = "struct<type:string,start:int,end:int,sum:double,n:int>"
    state = F.struct(F.lit(None).cast(entity).alias("open"), F.array().cast(f"array<{entity}>").alias("out"))

    def add(s: Column, t: Column) -> Column:
        prefix, kind = T.bio_label(t.label)
        more = F.struct(s.open.type.alias("type"), s.open.start.alias("start"), t.end.alias("end"), (s.open["sum"] + t.score).alias("sum"), (s.open.n + 1).alias("n"))
        fresh = F.struct(kind.alias("type"), t.start.alias("start"), t.end.alias("end"), t.score.alias("sum"), F.lit(1).alias("n"))
        closed = F.when(s.open.isNotNull(), F.concat(s.out, F.array(s.open))).otherwise(s.out)
        part = s.open.isNotNull() & ~t.text.rlike(r"^[ \n]") & (F.trim(t.text) != "")
        none = (prefix == "O") | kind.isNull() | (kind == "") | (t.score < NER_SCORE)
        same = (prefix == "I") & s.open.isNotNull() & (s.open.type == kind)
        go = part | (~none & same)
        return F.struct(F.when(go, more).when(none, F.lit(None).cast(entity)).otherwise(fresh).alias("open"), F.when(go, s.out).otherwise(closed).alias("out"))

    done = F.aggregate(tokens, state, add, lambda s: F.when(s.open.isNotNull(), F.concat(s.out, F.array(s.open))).otherwise(s.out))
    return F.transform(done, lambda e: F.struct(e.type.alias("entity"), e.start.alias("start"), e.end.alias("end"), (e["sum"] / e.n).alias("score")))


def faces(raw: DataFrame, keys: list[str], width: str = "width", height: str = "height") -> DataFrame:
    """Faces of raw outputs: boxes array<double> in groups of four (y1, x1, y2, x2 as parts of the
    image) in steps of sixteen, scores array<double>. Scores of 0.6, sides of 5 pixels, inside the
    image; suppressed and numbered anew by score."""
    rows = raw.select(*keys, width, height, "boxes", F.posexplode("scores").alias("veil_i", "score")).where(F.col("score") >= FACE_SCORE)
    at = lambda k: F.get(F.col("boxes"), F.col("veil_i") * 16 + k)
    box = G.box(at(1) * F.col(width), at(0) * F.col(height), at(3) * F.col(width), at(2) * F.col(height))
    rows = rows.withColumn("box", box)
    b = F.col("box")
    inside = (b.x1 >= 0) & (b.y1 >= 0) & (b.x2 <= F.col(width)) & (b.y2 <= F.col(height)) & (b.x2 - b.x1 >= FACE_SIDE) & (b.y2 - b.y1 >= FACE_SIDE)
    lists = rows.where(inside).groupBy(*keys).agg(F.collect_list(F.struct("score", "box")).alias("list"))
    kept = lists.select(*keys, F.posexplode(G.suppress(F.col("list"))).alias("veil_n", "f"))
    return kept.select(*keys, F.concat(F.lit("face_"), F.lpad(F.col("veil_n").cast("string"), 3, "0")).alias("source_id"), F.lit("FACE").alias("entity"), F.col("f.score").alias("score"), F.col("f.box").alias("box"))


def regions(findings: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """findings with region (clamped, padded by 2, faces by 3), and style (blur for faces)."""
    face = F.upper("entity") == "FACE"
    out = findings.withColumn("region", F.when(face, G.clamp(F.col("box"), F.col(width), F.col(height), 3)).otherwise(G.clamp(F.col("box"), F.col(width), F.col(height), 2)))
    return out.withColumn("style", F.when(face, "blur").otherwise("box"))


def redact_chunks(chunks: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """chunks (keys, id, text) with the texts of their findings (source_id, entity, text) replaced by
    [REDACTED:TYPE], longest first, case aside; redacted says whether there were any."""
    f = findings.where("text is not null and text <> ''").groupBy(*keys, F.col("source_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct((-F.length("text")).alias("n"), "text", "entity"))).alias("found"))
    out = chunks.join(f, [*keys, "id"], "left")
    put = lambda s, x: F.call_function("regexp_replace", s, F.concat(F.lit(r"(?i)\Q"), F.replace(x.text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E")), F.concat(F.lit("[REDACTED:"), x.entity, F.lit("]")))
    text = F.when(F.col("found").isNull(), F.col("text")).otherwise(F.aggregate("found", F.col("text"), put))
    return out.withColumn("text", text).withColumn("redacted", F.col("found").isNotNull()).drop("found")


def crop(box: Column, width: Column, height: Column, margin: float = 0.25) -> Column:
    """A candidate's box with a margin of its size, within the image."""
    dx, dy = (box.x2 - box.x1) * margin, (box.y2 - box.y1) * margin
    return G.clamp(G.box(box.x1 - dx, box.y1 - dy, box.x2 + dx, box.y2 + dy), width, height)


# Caps of prompts.
PROMPT_CANDIDATES, PROMPT_IDS, PROMPT_CHARS = 40, 120, 12000


def prompt(candidates: Column, text: Column) -> Column:
    """A reviewing model's prompt: the first 40 candidates (id, type, text), the text's first
    12,000 characters. The caps are the prompt's, as the model's window is."""
    lines = F.transform(F.slice(candidates, 1, PROMPT_CANDIDATES), lambda c: F.concat_ws(" | ", c.candidate_id, c.type, c.text))
    return F.concat(F.lit("Candidates:\n"), F.array_join(lines, "\n"), F.lit("\nText:\n"), F.substring(text, 1, PROMPT_CHARS))


def tier_path(stages: Column) -> Column:
    """Which tiers a run's stages (stage, status) reached, such as T0>T1>T2."""
    done = lambda name: F.exists(stages, lambda s: (s.stage == name) & (s.status == "done"))
    return F.array_join(F.array_compact(F.array(F.when(done("HEURISTICS"), "T0"), F.when(done("NER"), "T1"), F.when(done("REVIEW"), "T2"))), ">")


def stage_info(info: Column, field: str) -> Column:
    """A field of a stage's JSON; null where the JSON is cut short."""
    return F.get_json_object(info, f"$.{field}")


def evidence(findings: DataFrame, keys: list[str]) -> DataFrame:
    """A record of each document's findings as JSON, values left out."""
    item = F.struct("source_id", "entity", F.round("score", 4).alias("score"))
    return findings.groupBy(*keys).agg(F.to_json(F.struct(F.count("*").alias("n_findings"), F.array_sort(F.collect_list(item)).alias("final_findings"), F.array_sort(F.collect_set("entity")).alias("entity_types"))).alias("record"))


def first_json(text: str | None) -> str | None:
    """The first JSON object of a model's answer: fences and thoughts stripped, braces closed where
    it is cut short, bare keys quoted where that makes it valid; None without one."""
    s = re.sub(r"(?is)<think>.*?</think>\s*", "", re.sub(r"(?i)^```(?:json)?\s*|\s*```\s*$", "", (text or "").strip())).strip()
    if "{" not in s:
        at = s.find('"redactions"')
        if at < 0:
            return None
        s = "{" + s[at:]
    begin = s.index("{")
    depth, quoted, skip, end = 0, False, False, None
    for i in range(begin, len(s)):
        c = s[i]
        if quoted:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                end = i + 1
                break
    found = s[begin:end] if end else s[begin:] + "}" * depth
    for attempt in (found, re.sub(r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", r'\1"\2"\3', found)):
        try:
            json.loads(attempt)
            return attempt
        except ValueError:
            continue
    return found if end else None


def model_json(answer: Column) -> Column:
    """first_json() of each answer, in Arrow batches."""

    def work(answers: pd.Series) -> pd.Series:
        return answers.map(lambda x: first_json(None if x is None or x != x else x))

    return F.pandas_udf(work, StringType())(answer)


def clean_caption(text: str | None, known: list | None, most: int = 600) -> str | None:
    """A caption without the known values (text, type): longest first, white space and, for numbers,
    signs between digits aside; repeated sentences once; at most `most` characters, ending with a
    sentence where one ends beyond the 120th."""
    if text is None:
        return None
    rows = []
    for k in known or []:
        value, kind = re.sub(r"\s+", " ", k["text"] or "").strip(), re.sub(r"[^A-Z0-9_]", "_", (k["type"] or "PII").upper())
        if kind in CAPTION_KEEPS or len(value) < 2:
            continue
        rows.append((len(value), r"\s+".join(map(re.escape, value.split())), kind))
        digits = re.sub(r"\D", "", value)
        if len(digits) >= 4:
            rows.append((len(digits), "[^A-Za-z0-9]*".join(digits), kind))
    out = text
    for _, pattern, kind in sorted(rows, key=lambda r: -r[0]):
        out = re.sub(pattern, f"[REDACTED:{kind}]", out, flags=re.IGNORECASE)
    seen, parts = set(), []
    for p in re.split(r"(?<=[.!?])\s+", re.sub(r"\s+", " ", out).strip()):
        if p and p.lower() not in seen:
            seen.add(p.lower())
            parts.append(p)
    out = " ".join(parts)
    if len(out) > most:
        end = max(out.rfind(c, 0, most) for c in ".!?")
        out = out[: end + 1] if end > 120 else re.sub(r"\s+\S*$", "", out[:most])
    return out


def safe_caption(caption: Column, known: Column) -> Column:
    """clean_caption() of each caption, in Arrow batches; known is array<struct<text, type>>."""

    def work(captions: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([clean_caption(c, None if k is None else list(k)) for c, k in zip(captions, values, strict=True)], dtype=object)

    return F.pandas_udf(work, StringType())(caption, known)


def global_spans(text: Column, items: Column) -> Column:
    """(id, start, end) of an image's items (id, text) in its whole text, each searched from the end
    of the last one; null where one is not found."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<id:string,start:int,end:int>>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        bare = T.clean(x.text)
        at = F.call_function("locate", bare, text, s.at + 1)
        found = (bare != "") & (at > 0)
        span = F.struct(x.id.alias("id"), F.when(found, at - 1).alias("start"), F.when(found, at - 1 + F.length(bare)).alias("end"))
        return F.struct(F.when(found, at - 1 + F.length(bare)).otherwise(s.at).alias("at"), F.when(bare == "", s.out).otherwise(F.concat(s.out, F.array(span))).alias("out"))

    return F.aggregate(items, start, add, lambda s: s.out)
