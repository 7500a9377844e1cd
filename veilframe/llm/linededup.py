"""Line dedup: runs of repeated lines, found by winnowing. DataFrame operations only.

Lines are hashed. From every line starts a window: the fewest lines that hold `least` words; and
another one ends at every line. The smallest line hash of a window is its fingerprint, at that
line's position. Any run of `least` words or more that two places share holds whole windows, so
both places select the same fingerprints (the winnowing guarantee, with windows measured in words).
Fingerprints of one place only are dropped. The others' positions are joined on the fingerprint
with the earliest position whose window goes on alike before and behind the fingerprint, which
extends the match both ways up to the window's ends; matches that touch make up the run. All
matched lines but those of the earliest place go.

So a line goes exactly if it lies in a run of consecutive lines (blank ones aside) with at least
`least` words that occurs earlier: in a document of a smaller id, or before, without overlap, in
its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, free_name, join_one, materialise, table

LEAST_WORDS = 50

_DOC = ["doc_id", "th"]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, h1, h2, nw) of lines that have words, once for identical rows."""
    whole = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n").alias("lines"))
    words = lambda x: F.size(F.array_remove(F.split(x, r"[\x20\x09-\x0D]+"), ""))
    coded = whole.select(*_DOC, F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(x, F.lit(1)).alias("h2"), words(x).alias("nw"))).alias("lines"))
    one = coded.groupBy(*_DOC).agg(F.first("lines").alias("lines"))
    return one.select(*_DOC, F.posexplode("lines").alias("pos", "line")).select(*_DOC, "pos", "line.h1", "line.h2", F.col("line.nw").cast("long").alias("nw")).where("nw > 0")


def _windows(lines: DataFrame, least: int) -> DataFrame:
    """(doc_id, th, way, a, b, mark, place, before, after): windows of lines a to b; mark is the
    smallest line hash, place stands for where that line is, before and after for the window's lines
    on its two sides."""
    doc = W.partitionBy(*_DOC)
    lines = lines.withColumn("upto", F.sum("nw").over(doc.orderBy("pos").rowsBetween(W.unboundedPreceding, 0))).withColumn("start", F.col("upto") - F.col("nw"))

    def seen(way: str, over) -> Column:
        least_line = F.min(F.struct("h1", "pos")).over(over)
        return F.struct(F.lit(way).alias("way"), F.min("pos").over(over).alias("a"), F.max("pos").over(over).alias("b"), F.sum("nw").over(over).alias("n"), least_line.alias("m"), F.collect_list("h1").over(over).alias("l1"), F.collect_list("h2").over(over).alias("l2"))

    both = lines.select(*_DOC, seen("f", doc.orderBy("start").rangeBetween(0, least - 1)).alias("f"), seen("b", doc.orderBy("upto").rangeBetween(1 - least, 0)).alias("t"))
    one = both.select(*_DOC, F.explode(F.array("f", "t")).alias("x")).where(F.col("x.n") >= least).select(*_DOC, "x.*").withColumn("k", F.array_position("l1", F.col("m.h1")).cast("int"))
    side = lambda begin, length: F.xxhash64(F.slice("l1", begin, length), F.slice("l2", begin, length))  # noqa: E731  from the fingerprint's own line on, whose second hash counts, too
    return one.select(*_DOC, "way", "a", "b", F.col("m.h1").alias("mark"), F.xxhash64(*_DOC, "m.pos").alias("place"), side(F.lit(1), F.col("k")).alias("before"), side(F.col("k"), F.size("l1")).alias("after"))


def repeated_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, th, runs): lines to delete, as an array of (a, b), of the documents that have any."""
    windows = materialise(_windows(_lines(docs), least), "windows")
    shared = windows.groupBy("way", "mark").agg(F.min("place").alias("p"), F.max("place").alias("q")).where("p <> q").select("way", "mark")
    positions = materialise(windows.join(shared, ["way", "mark"], "left_semi").drop("place"), "positions")
    discard(windows)
    alike = ["way", "mark", "before", "after"]
    first = positions.groupBy(*alike).agg(F.min(F.struct(*_DOC, "a", "b")).alias("first"), F.count("*").alias("n")).where("n > 1")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    hits = join_one(positions, materialise(first, "first"), alike, "n").where(~same | (F.col("a") > F.col("first.b"))).select(*_DOC, "a", "b")
    order = W.partitionBy(*_DOC).orderBy("a", "b")
    hits = hits.withColumn("new", F.coalesce((F.col("a") > F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1)) + 1).cast("int"), F.lit(1)))
    hits = hits.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = hits.groupBy(*_DOC, "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))


def delete_repeated(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """docs (with doc_id and text) with its text less the repeated runs, and n_lines, n_removed
    and removed ("a-b" line ranges from 0, comma-joined) appended.

    A text whose lines all go is empty. Null texts stay null, with no lines; empty ones have one
    line and stay. Rows that are equal in doc_id and text count as one document and have the same
    result. Null ids come first. An empty table stays empty. Other columns stay, but for those named
    like an output, which are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "removed")]
    of_id, of_th, th, at, new = (free_name(docs, n) for n in ("veil_of_id", "veil_of_th", "veil_th", "veil_runs", "veil_text"))
    runs = repeated_runs(docs.select("doc_id", "text"), least).withColumnsRenamed({"doc_id": of_id, "th": of_th, "runs": at})
    found = docs.select(*kept, F.xxhash64("text").alias(th))
    found = found.join(runs, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(th) == F.col(of_th)) & F.col("text").isNotNull(), "left")
    lines = F.split("text", "\n")
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.exists(at, lambda r: (i >= r.a) & (i <= r.b))), "\n")
    n = F.coalesce(F.aggregate(at, F.lit(0).cast("long"), lambda s, r: s + r.b - r.a + 1), F.lit(0).cast("long"))
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(rest)
    removed = F.coalesce(F.array_join(F.transform(at, lambda r: F.concat(r.a.cast("string"), F.lit("-"), r.b.cast("string"))), ","), F.lit(""))
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long")
    found = found.withColumns({"n_lines": n_lines, "n_removed": n, "removed": removed, new: text})
    return found.select(*[F.col(new).alias("text") if c == "text" else F.col(c) for c in kept], "n_lines", "n_removed", "removed")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed, kept_sha256) of every document; null texts: none kept."""
    found = delete_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH raw AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l0 AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line, len(list_filter(regexp_split_to_array(ls[i], '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS nw FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw)),
l1 AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l0 WHERE nw > 0),
l2 AS (SELECT *, upto - nw AS before FROM l1),
w AS (
  SELECT doc_id, 'f' AS way, min(pos) OVER x AS a, max(pos) OVER x AS b, sum(nw) OVER x AS n, md5(CAST(list(line) OVER x AS VARCHAR)) AS g FROM l2 WINDOW x AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, 'b', min(pos) OVER x, max(pos) OVER x, sum(nw) OVER x, md5(CAST(list(line) OVER x AS VARCHAR)) FROM l2 WINDOW x AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
k AS (SELECT * FROM w WHERE n >= 50),
f AS (SELECT way, g, min(ROW(doc_id, a, b)) AS first FROM k GROUP BY way, g HAVING count(*) > 1),
hits AS (SELECT k.doc_id, k.a, k.b FROM k JOIN f USING (way, g) WHERE k.doc_id <> f.first[1] OR k.a > f.first[3]),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(a, b + 1)) AS p FROM hits)),
isles AS (SELECT doc_id, min(p) AS a, max(p) AS b FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM gone) GROUP BY doc_id, i),
runs AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed, sum(b - a + 1) AS n FROM isles GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l0 ANTI JOIN gone ON l0.doc_id = gone.doc_id AND l0.pos = gone.p GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
