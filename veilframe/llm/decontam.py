"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Items are cut into windows of `width` consecutive words (a shorter item is one window). All
distinct windows, written as " w1 w2 ... ", go into one automaton; a document's words, written the
same way, are scanned once. A match's place gives its words by a binary search over word ends, and
their places in the original text from a second pass over contaminated documents only.

The automaton is sent to the executors. Its size is that of the benchmark, which is checked: where
the windows take more than `block_bytes`, the benchmark is split by a hash of the window into
blocks of about that size, whose automata scan the documents one after another; the runs that
they hit are put together per text.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, join_one, map_text, materialise, spread, table

WIDTH = 10
#: Bytes of window text in one automaton: about 50 times as many bytes in memory.
BLOCK_BYTES = 4 << 20

#: Byte to itself (lower-cased) where it is part of a word, else to a space.
_FOLD = bytes(b if b >= 0x80 or chr(b).isascii() and (chr(b).isdigit() or "a" <= chr(b) <= "z") else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters A-Z (lower-cased) and non-ASCII characters, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(text: str | None, width: int = WIDTH) -> set[bytes]:
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def _automaton(found: dict[bytes, list]) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for window, items in found.items():
        # one character a byte: matches are on bytes, so that offsets are byte offsets
        auto.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, items))
    if found:
        auto.make_automaton()
    return auto


def _windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item, window) of all items; a null id is named ""."""

    def run(batches):
        for batch in batches:
            items, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = windows_of(text, width)
                items += [item] * len(mine)
                found += mine
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.binary())], names=["item", "window"])

    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").mapInArrow(run, "item string, window binary")


def _scanner(found):
    """What map_text() makes of a broadcast block of windows."""

    def make():
        auto = _automaton(found.value)
        return lambda texts: _scan(texts, auto)

    return make


def _scan(texts: list, auto: ahocorasick.Automaton) -> list[list]:
    """Per text: words, hit words, items, and the hit runs: words at to `to`, exclusive, and their
    code points."""
    n_words, n_hit, items_of, spans_of = [], [], [], []
    for text in texts:
        words = words_of(text)
        hits, items = [], set()
        if words:
            line = f" {b' '.join(words).decode('latin-1')} "
            for end, (width, ids) in auto.iter(line) if len(auto) else ():
                hits.append((end, width))
                items.update(ids)
        spans, total = [], 0
        if hits:
            # the character after word k is at ends[k]
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
            runs: list[list[int]] = []
            last = np.searchsorted(ends, [e for e, _ in hits])
            for k, width in sorted((int(k) - w + 1, w) for k, (_, w) in zip(last, hits, strict=True)):
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], k + width)
                else:
                    runs.append([k, k + width])
            total = sum(b - a for a, b in runs)
            spans = _original(text, runs)
        n_words.append(len(words))
        n_hit.append(total)
        items_of.append(sorted(items))
        spans_of.append(spans)
    return [n_words, n_hit, items_of, spans_of]


def _original(text: str, runs: list[list[int]]) -> list[dict]:
    """Runs of words with their code points, end exclusive."""
    raw = text.encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(raw.translate(_FOLD), dtype=np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    points = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)  # code points up to this byte
    return [{"at": a, "to": b, "start": int(points[starts[a]]) - 1, "end": int(points[stops[b - 1] - 1])} for a, b in runs]


_SPAN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("at", "to", "start", "end")]))
_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", _SPAN)]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (ids as sorted strings) and spans (start, end) appended.

    Null and empty texts have no words and no hits. Items without words have no windows; items
    with a null id count under the name "" and repeated items once. An empty benchmark hits
    nothing. Other columns of docs stay, but for those named like an output, which it replaces.
    """
    spark = docs.sparkSession
    windows = _windows(benchmark, width).groupBy("window").agg(F.collect_set("item").alias("items"))
    total = windows.agg(F.sum(F.length("window") + 16)).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    if blocks == 1:
        found = spark.sparkContext.broadcast({bytes(r.window): list(r["items"]) for r in windows.toLocalIterator()})
        return map_text(docs, text, _FIELDS, _scanner(found)).withColumn("spans", F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))))
    windows = materialise(windows, "windows")
    whole = F.coalesce(F.col(text), F.lit(""))
    keys = [F.xxhash64(whole), F.xxhash64(whole, F.lit(1))]
    texts = docs.select(keys[0].alias("k"), keys[1].alias("l"), F.col(text).alias("text"))
    parts = None
    for i in range(blocks):  # one block at a time on the driver and in a task
        mine = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == i)
        found = spark.sparkContext.broadcast({bytes(r.window): list(r["items"]) for r in mine.toLocalIterator()})
        hits = map_text(texts, "text", _FIELDS, _scanner(found)).where("n_hit > 0").groupBy("k", "l").agg(F.first("items").alias("items"), F.first("spans").alias("spans"), F.count("*").alias("n"))
        hits = materialise(hits, f"block-{i}")
        found.destroy()
        parts = hits if parts is None else parts.union(hits)
    own = [free_name(docs, n) for n in ("veil_k", "veil_l", "veil_n", "veil_items", "veil_runs")]
    of = parts.groupBy("k", "l").agg(F.max("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    of = of.mapInArrow(_merged, of.schema).toDF(*own)  # at most one row a block and text goes into a group
    counted = map_text(docs, text, _FIELDS[:1], lambda: lambda texts: [[len(words_of(t)) for t in texts]])
    kept = [c for c in counted.columns if c.lower() not in ("n_words", "n_hit", "items", "spans")]
    out = join_one(counted.select(*kept, "n_words", keys[0].alias(own[0]), keys[1].alias(own[1])), materialise(of, "hits"), own[:2], own[2], "left")
    n_hit = F.coalesce(F.aggregate(own[4], F.lit(0).cast("long"), lambda n, r: n + r.to - r.at), F.lit(0).cast("long"))
    items, spans = F.coalesce(own[3], F.array().cast("array<string>")), F.coalesce(own[4], F.array().cast(_SPAN))
    return out.select(*kept, "n_words", n_hit.alias("n_hit"), items.alias("items"), F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))).alias("spans"))


def _merged(batches):
    """Rows whose spans are put in order, those that overlap or touch as one."""
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            runs: list[dict] = []
            for r in sorted(row["spans"], key=lambda r: (r["at"], r["to"])):
                if runs and r["at"] <= runs[-1]["to"]:
                    runs[-1] |= {"to": max(runs[-1]["to"], r["to"]), "end": max(runs[-1]["end"], r["end"])}
                else:
                    runs.append(r)
            row["spans"] = runs
        yield pa.RecordBatch.from_pylist(rows, batch.schema)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
    FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hit GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""
