"""Fusion of candidates and the gates before redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions import validators as V
from . import associate as A

# Confidence thresholds and caps.
FINAL, FALLBACK, HIGH, FLOOR, REVIEW_CAP = 0.5, 0.72, 0.9, 0.5, 6

_FUSED = f"struct<n:int,confidence:double,ord:bigint,text:string,ids:array<string>,label:string,types:array<string>,sources:array<string>,box:{G.BOX}>"


def fuse(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each fused candidate: text, ids, label, types, sources, confidence, box.

    candidates: keys, source (ner or deterministic_context), ids, text, label, type, confidence,
    box, ord. Equal text and ids merge: all sources and types, the highest confidence, the first
    label and box. Then, longest first, a text within another that shares an item (or whose box
    touches) joins it; but a deterministic value inside a model-only text of more than twice its
    length takes that text's place.
    """
    c = candidates.withColumn("text", T.clean(F.col("text"))).where("text <> ''").withColumn("ids", F.array_sort("ids"))
    merged = c.groupBy(*keys, T.candidate_key(F.col("text")).alias("key"), "ids").agg(
        F.min_by("text", "ord").alias("text"), F.min("ord").alias("ord"), F.min_by("label", F.when(F.col("label").isNotNull(), F.col("ord"))).alias("label"),
        F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_set("source")).alias("sources"), F.max("confidence").alias("confidence"),
        F.min_by("box", F.when(F.col("box").isNotNull(), F.col("ord"))).alias("box"),
    )
    item = F.struct((-F.length("text")).alias("n"), (-F.col("confidence")).alias("confidence"), "ord", "text", "ids", "label", "types", "sources", F.col("box").cast(G.BOX).alias("box"))
    lists = merged.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("list"))
    both = lambda a, b: F.array_sort(F.array_union(a, b))

    def put(kept: Column, x: Column) -> Column:
        shares = lambda k: F.arrays_overlap(k.ids, x.ids)
        touches = lambda k: k.box.isNotNull() & x.box.isNotNull() & (k.box.x2 >= x.box.x1) & (k.box.x1 <= x.box.x2) & (k.box.y2 >= x.box.y1) & (k.box.y1 <= x.box.y2)
        inside = lambda k: T.contained(x.text, k.text) & (shares(k) | touches(k))
        at = F.array_position(F.transform(kept, lambda k: F.coalesce(inside(k), F.lit(False))), True)

        def join(k: Column) -> Column:
            rescue = F.array_contains(x.sources, "deterministic_context") & F.forall(k.sources, lambda s: s == "ner") & (F.length(k.text) > 2 * F.length(x.text))
            new = F.struct(x.n.alias("n"), F.least(x.confidence, k.confidence).alias("confidence"), x.ord.alias("ord"), x.text.alias("text"), x.ids.alias("ids"), F.coalesce(x.label, k.label).alias("label"), both(x.types, k.types).alias("types"), both(x.sources, k.sources).alias("sources"), F.coalesce(x.box, k.box).alias("box"))
            old = F.struct(k.n.alias("n"), k.confidence.alias("confidence"), k.ord.alias("ord"), k.text.alias("text"), k.ids.alias("ids"), F.coalesce(k.label, x.label).alias("label"), both(k.types, x.types).alias("types"), both(k.sources, x.sources).alias("sources"), k.box.alias("box"))
            return F.when(~shares(k), k).when(rescue, new).otherwise(old)

        return F.when(at > 0, F.transform(kept, lambda k, i: F.when(i + 1 == at, join(k)).otherwise(k))).otherwise(F.concat(kept, F.array(x)))

    out = lists.select(*keys, F.posexplode(F.aggregate("list", F.array().cast(f"array<{_FUSED}>"), put)).alias("pos", "c"))
    cid = F.concat(F.lit("cand_"), F.lpad(F.col("pos").cast("string"), 3, "0"))
    return out.select(*keys, cid.alias("candidate_id"), "pos", "c.text", "c.ids", "c.label", "c.types", "c.sources", (-F.col("c.confidence")).alias("confidence"), "c.box")


def review(fused: DataFrame, keys: list[str]) -> DataFrame:
    """fused with tier: HIGH (two sources, or 0.9), LOW (0.5 at least; the six least sure of an
    image), CAPPED (LOW beyond them) or DROPPED."""
    dual = F.array_contains("sources", "ner") & F.array_contains("sources", "deterministic_context")
    tier = F.when(dual | (F.col("confidence") >= HIGH), "HIGH").when(F.col("confidence") >= FLOOR, "LOW").otherwise("DROPPED")
    out = fused.withColumn("tier", tier)
    nth = F.row_number().over(W.partitionBy(*keys, "tier").orderBy("confidence", "pos"))
    return out.withColumn("nth", nth).withColumn("tier", F.when((F.col("tier") == "LOW") & (F.col("nth") > REVIEW_CAP), "CAPPED").otherwise(F.col("tier"))).drop("nth")


def threshold(f: dict[str, Column]) -> Column:
    """The confidence that a finding needs: 0.5 if adjudicated or well supported, else 0.72."""
    names = F.exists(F.concat(F.array(F.coalesce(f["entity"], F.lit(""))), f["types"]), lambda t: F.lower(t).contains("name") | F.lower(t).contains("person"))
    dual = F.array_contains(f["sources"], "ner") & F.array_contains(f["sources"], "deterministic_context")
    lenient = (f["decision"] != "fusion_fallback") | dual | names | f["salvaged"] | f["confirmed"] | f["failed"]
    return F.when(F.coalesce(lenient, F.lit(False)), FINAL).otherwise(FALLBACK)


def gates(findings: DataFrame) -> DataFrame:
    """findings with drop_gate: the first gate that drops them, or null.

    Needs text, score, box, entity, types, sources, decision, and booleans salvaged, confirmed and
    failed; ocr_text and ocr_box of the item (null without). Gate 1: a valid box. 7: not a whole
    line's box for a part of it. 5: a plausible value that is no label (addresses: 6 to 80
    characters with a letter or digit). 6: the threshold.
    """
    text = F.col("text")
    address = text.contains("@") | (text.rlike(r"(?i)\bdot\b") & text.rlike(r"(?i)\bat\b"))
    value = F.when(address, text.rlike("(?i)[a-z0-9]") & F.length(text).between(6, 80)).otherwise(V.plausible_value(text))
    label = A.field_label(text)
    bare = label.isNotNull() & (T.candidate_key(label.label) == T.candidate_key(text))
    narrow = F.col("ocr_box").isNull() | G.value_only(F.col("box"), F.col("ocr_box"), F.col("ocr_text"), text)
    least = threshold({n: F.col(n) for n in ("entity", "types", "sources", "decision", "salvaged", "confirmed", "failed")})
    gate = F.when(~G.valid(F.col("box")), 1).when(~narrow, 7).when(~F.coalesce(value, F.lit(False)) | F.coalesce(bare, F.lit(False)), 5).when(F.col("score") < least, 6)
    return findings.withColumn("drop_gate", gate)


def unique_regions(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One finding for each rounded box of an image, the first."""
    b = F.col("box")
    order = W.partitionBy(*keys, *[G.half_up(b[n]) for n in ("x1", "y1", "x2", "y2")]).orderBy("ord")
    return findings.where("box is not null").withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


# Answers of a reviewing model that count.
def verdicts(fused: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """fused less the candidates that a review rejected. answers: keys, candidate_id, answer; only
    yes and no count (case aside), other answers leave a candidate unreviewed."""
    no = answers.where(F.lower(F.trim("answer")).rlike(r"^no\b"))
    return fused.join(no, [*keys, "candidate_id"], "left_anti")


def adjudicate(fused: DataFrame, output: DataFrame, keys: list[str], allowed: tuple[str, ...]) -> DataFrame:
    """Model output (keys, candidate_id, ids, type, text, confidence) checked against the fused
    candidates it refers to: status valid, or the first failure in order."""
    known = fused.select(*keys, "candidate_id", F.col("text").alias("fused_text"), F.col("ids").alias("fused_ids"))
    out = output.join(known, [*keys, "candidate_id"], "left")
    extra = F.size(F.array_except(F.coalesce("ids", F.array().cast("array<string>")), F.coalesce("fused_ids", F.array().cast("array<string>")))) > 0
    supported = T.text_match(F.col("text"), F.col("fused_text"))
    status = (
        F.when(F.col("fused_text").isNull(), "unknown-candidate").when(extra, "unknown-item").when(~F.coalesce(F.col("type").isin(*allowed), F.lit(False)), "unknown-type")
        .when(~F.coalesce(supported, F.lit(False)), "unsupported-text").when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "bad-confidence").otherwise("valid")
    )
    return out.withColumn("status", status)


def value_boxes(candidates: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """candidates (keys, candidate_id, text, ids, box) with value_box: the value's part of the first
    of their items (in the order of ids) that holds it; else the box around the items that the value
    is made of; else their own box."""
    it = items.select(*keys, "id", F.col("text").alias("item_text"), F.col("box").alias("item_box"))
    rows = candidates.select(*keys, "candidate_id", "text", F.posexplode("ids").alias("veil_pos", "id")).join(it, [*keys, "id"])
    value, line = T.candidate_key(F.col("text")), T.candidate_key(F.col("item_text"))
    holds = (line == value) | line.contains(value) | T.flat(line).contains(T.flat(value))
    part = F.when(line == value, F.col("item_box")).when(holds, G.sub_box(F.col("item_box"), F.col("item_text"), F.col("text")))
    piece = (line != "") & T.flat(value).contains(T.flat(line))
    best = rows.groupBy(*keys, "candidate_id").agg(
        F.min_by(part, F.when(part.isNotNull(), F.col("veil_pos"))).alias("whole"), F.collect_list(F.when(piece, F.col("item_box"))).alias("pieces")
    )
    out = candidates.join(best, [*keys, "candidate_id"], "left")
    made = F.when(F.size("pieces") > 0, G.union_of(F.col("pieces")))
    return out.withColumn("value_box", F.coalesce("whole", made, "box")).drop("whole", "pieces")


_FOUND = f"struct<n:int,score:double,ord:bigint,text:string,id:string,box:{G.BOX}>"


def drop_contained(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings (keys, ord, source_id, text, score, box) less those within a longer one of the same
    item or with a touching box (white space aside); of equal texts the surest stays."""
    item = F.struct((-F.length("text")).alias("n"), (-F.col("score")).alias("score"), "ord", "text", F.col("source_id").alias("id"), F.col("box").cast(G.BOX).alias("box"))
    lists = findings.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("list"))

    def put(kept: Column, x: Column) -> Column:
        touch = lambda k: k.box.isNotNull() & x.box.isNotNull() & (G.intersection(k.box, x.box) > 0)
        same = lambda k: (T.candidate_key(k.text) == T.candidate_key(x.text)) | T.contained(x.text, k.text)
        return F.when(F.exists(kept, lambda k: F.coalesce(same(k) & ((k.id == x.id) | touch(k)), F.lit(False))), kept).otherwise(F.concat(kept, F.array(x)))

    kept = lists.select(*keys, F.explode(F.aggregate("list", F.array().cast(f"array<{_FOUND}>"), put)).alias("k")).select(*keys, F.col("k.ord").alias("ord"))
    return findings.join(kept, [*keys, "ord"], "left_semi")


def adjudicate_or_fallback(fused: DataFrame, output: DataFrame, keys: list[str], allowed: tuple[str, ...], closed: bool = False) -> DataFrame:
    """Final findings with decision: an image whose model output is all valid is decided by it
    (adjudicated); any other falls back to its fused candidates, those that a valid item supports
    marked salvaged. With `closed` (fail closed) such an image has no findings; outcomes() says
    that its redaction is not complete."""
    checked = adjudicate(fused, output, keys, allowed)
    good = checked.groupBy(*keys).agg(F.bool_and(F.col("status") == "valid").alias("all_valid"))
    valid = checked.where("status = 'valid'")
    by_model = valid.join(good.where("all_valid"), keys, "left_semi").select(*keys, "candidate_id", "text", F.col("type").alias("entity"), F.col("confidence").alias("score"), F.lit("adjudicated").alias("decision"), F.lit(False).alias("salvaged"), F.lit(False).alias("failed"))
    if closed:
        return by_model
    rest = fused.join(good.where("all_valid"), keys, "left_anti").join(valid.select(*keys, "candidate_id", F.lit(True).alias("named")), [*keys, "candidate_id"], "left")
    by_fusion = rest.select(*keys, "candidate_id", "text", F.get("types", F.lit(0)).alias("entity"), F.col("confidence").alias("score"), F.lit("fusion_fallback").alias("decision"), F.coalesce("named", F.lit(False)).alias("salvaged"), F.lit(False).alias("failed"))
    return by_model.unionByName(by_fusion)


def outcomes(images: DataFrame, output: DataFrame, fused: DataFrame, keys: list[str], allowed: tuple[str, ...], closed: bool = False) -> DataFrame:
    """(keys, status, redaction_complete, fallback) of each row of images, as adjudicate_or_fallback()
    decides: ok where all output is valid, else whether it failed or there was none (skipped), and
    what steps in: fusion, or with `closed` fail_closed, which leaves the redaction incomplete."""
    good = adjudicate(fused, output, keys, allowed).groupBy(*keys).agg(F.bool_and(F.col("status") == "valid").alias("all_valid"))
    ok = F.coalesce("all_valid", F.lit(False))
    why = F.when(F.col("all_valid").isNull(), "model_skipped" if closed else "fallback_fusion").otherwise("model_failed" if closed else "fallback_after_model_failure")
    out = images.select(*keys).join(good, keys, "left")
    return out.select(*keys, F.when(ok, "ok").otherwise(why).alias("status"), (ok | F.lit(not closed)).alias("redaction_complete"), F.when(~ok, "fail_closed" if closed else "fusion").alias("fallback"))


def model_evidence(images: DataFrame, items: DataFrame, found: DataFrame, exact: DataFrame, fused: DataFrame, keys: list[str]) -> DataFrame:
    """What a model is shown of each image: (keys, image, items, model_candidates, exact_candidates,
    fused_candidates), the last four as arrays in order of their ids, empty where there are none.

    images: (keys, width, height); items: (keys, id, text, box, confidence); found: (keys, entity,
    text, score, source_id, box); exact: (keys, label, value, field_type, confidence, ids, box,
    reason); fused: as of fuse(). Texts are cleaned. Null texts are empty. No key may be named
    like an output.
    """
    text = lambda c: T.clean(F.coalesce(c, F.lit(""))).alias(c)
    parts = (
        (items, "items", ("id", text("text"), "box", "confidence")),
        (found, "model_candidates", ("source_id", "entity", text("text"), "score", "box")),
        (exact, "exact_candidates", ("ids", "label", text("value"), "field_type", "confidence", "box", "reason")),
        (fused, "fused_candidates", ("candidate_id", "ids", "text", "types", "sources", "confidence", "box")),
    )
    out = images.select(*keys, F.struct("width", "height").alias("image"))
    for df, name, columns in parts:
        out = out.join(df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def normalize_items(named: DataFrame, fused: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """What a model names, as candidates: named (keys, nth, raw, candidate_id, ids, text, type,
    confidence, additional) with its candidate found among the fused ones.

    A plain text (raw) is a candidate's id, an item's id or a candidate's text, tried in this order;
    else it is a text of its own. Other rows go by candidate id, shared items, or text. decision
    is existing if a fused candidate was found (and the row is not listed as additional).
    """
    f = fused.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("candidate_id", "ids", "text", "types", "confidence"))).alias("veil_fused"))
    o = items.groupBy(*keys).agg(F.collect_list(F.struct("id", "text", "confidence")).alias("veil_lines"))
    rows = named.join(f, keys, "left").join(o, keys, "left").withColumn("raw", F.trim("raw"))
    first = lambda rows, fits: F.get(F.filter(rows, fits), F.lit(0))
    rows = rows.withColumn("line", first("veil_lines", lambda x: x.id == F.col("raw")))
    rows = rows.withColumn("own", F.when(F.col("raw").isNull(), F.coalesce("ids", F.array().cast("array<string>"))).when(F.col("line").isNotNull(), F.array("raw")).otherwise(F.array().cast("array<string>")))
    wanted = T.candidate_key(F.coalesce("raw", "text"))
    by_id = first("veil_fused", lambda c: c.candidate_id == F.coalesce("raw", "candidate_id"))
    by_item = first("veil_fused", lambda c: F.arrays_overlap(c.ids, F.col("own")))
    by_text = F.when(F.col("raw").isNull() | F.col("line").isNull(), first("veil_fused", lambda c: (wanted != "") & (T.candidate_key(c.text) == wanted)))
    rows = rows.withColumn("m", F.coalesce(by_id, by_item, by_text))
    name = F.coalesce("candidate_id", "m.candidate_id", F.concat(F.lit("model_"), F.coalesce("raw", F.lit("item"))))
    return rows.select(
        *keys, "nth", name.alias("candidate_id"), F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce("m.ids", "own")).alias("ids"),
        F.coalesce(F.when(F.col("text") != "", F.col("text")), "m.text", "line.text", "raw", F.lit("")).alias("text"), F.coalesce("type", F.get("m.types", F.lit(0)), F.lit("person")).alias("type"),
        F.coalesce("confidence", "m.confidence", "line.confidence", F.lit(0.9)).alias("confidence"), F.when(F.col("m").isNotNull() & ~F.coalesce("additional", F.lit(False)), "existing").otherwise("additional").alias("decision"),
    )


def final_regions(candidates: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """candidates of normalize_items() with box, that of the value alone, or why there is none in
    rejected: label (an item of theirs does not hold the value), line or unresolved."""
    named = candidates.withColumns({"veil_id": F.col("candidate_id"), "candidate_id": F.col("nth").cast("string"), "box": F.lit(None).cast(G.BOX)})
    boxed = value_boxes(named, items, keys)
    it = items.select(*keys, "id", T.candidate_key(F.col("text")).alias("line"))
    want = T.candidate_key(F.col("text"))
    held = named.select(*keys, "nth", "text", F.explode("ids").alias("id")).join(it, [*keys, "id"]).where("line <> ''")
    held = held.groupBy(*keys, "nth").agg(F.bool_or(~F.col("line").contains(want)).alias("label"), F.bool_or(F.col("line").contains(want) & (F.length("line") > F.length(want) + 3)).alias("whole"))
    none = F.when(F.col("label"), "label").when(F.col("whole"), "line").otherwise("unresolved")
    out = boxed.join(held, [*keys, "nth"], "left").withColumn("rejected", F.when(F.col("value_box").isNull(), none))
    return out.select(*keys, "nth", F.col("veil_id").alias("candidate_id"), "ids", "text", "type", "confidence", "decision", F.col("value_box").alias("box"), "rejected")
