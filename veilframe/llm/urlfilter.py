"""URL filters: a blocked Bloom filter before an exact hash join. DataFrame operations only.

Listed entries are host suffixes with path prefixes, written "host/path". A url's host and path
are cut into the entries that could fit it: its host suffixes with its path prefixes, of the
numbers of labels and lengths that the list has. Each such candidate is tested in a Bloom filter
whose bits for a key lie in one 64-bit block; those that pass meet the list in a hash join, which
removes false positives. Distinct (host, path) pairs only are judged, so that a hot host or url is
worked on once; its verdict goes back to its pages by a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_one, materialise, table

# The rules, most specific wins, and the canonical urls of the block list.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
LISTED = ("spam-farm.example.org/", "cheap-pills.example.com/", "spam-farm.example.net/", "cheap-pills.example.org/", "cheap-pills.example.net/")

#: Listed keys in a block on average, and bits set for a key.
KEYS_A_BLOCK, BITS = 4, 4
#: Blocks at most (of two longs each): the filter is broadcast whatever the list's length; beyond
#: that it lets more through, which the exact join removes.
MOST_BLOCKS = 1 << 21
#: A list of up to so many entries (about 100 bytes each) is broadcast, a longer one is joined by a
#: shuffle of what passes the filter.
BROADCAST_ROWS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if null or without "://"."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), r"^[^?#]*", 0)
    empty = F.lit("")
    return F.coalesce(F.translate(host, _UPPER, _LOWER), empty), F.coalesce(path, empty)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    mask = None
    for i in range(BITS):
        bit = F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) of the keys of listed (column key)."""
    return listed.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("bits"))


def listed_hits(candidates: DataFrame, listed: DataFrame) -> DataFrame:
    """candidates (with a column key) joined with the rows of listed (distinct keys) of that key,
    by way of the Bloom filter."""
    n = listed.count()
    small = n <= BROADCAST_ROWS
    blocks = min(MOST_BLOCKS, max(1, -(-n // KEYS_A_BLOCK)))
    bits = bloom(listed, blocks)
    key = F.col("key")
    possible = candidates.withColumn("block", _block(key, blocks)).join(F.broadcast(bits), "block").where(F.col("bits").bitwiseAND(_mask(key)) == _mask(key)).drop("block", "bits")
    return possible.join(F.broadcast(listed) if small else listed, "key")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and entry appended.

    rules: (verdict, host, path); the longest "host/path" that fits wins, then the longer host,
    then the greater text; its verdict holds. Where no rule fits, an entry of listed (column entry,
    "host/path") that fits blocks and is named in `entry`, else the page is allowed. For the list,
    a host counts without user, password and the ports 80 and 443, and a path with single slashes.
    Null urls and urls without "://" have an empty host and path. Repeated rows stay, as do other
    columns, but for those named like an output, which are replaced.
    """
    host, path = host_and_path(F.col(url))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "entry")]
    at = pages.select(*kept, host.alias("host"), path.alias("path"))
    says, copies = free_name(at, "veil_says"), free_name(at, "veil_copies")
    urls = materialise(at.groupBy("host", "path").agg(F.count("*").alias("copies")), "urls")
    entries = rules.select(F.lit("rule").alias("kind"), F.lower("host").alias("host"), "path", F.col("verdict").alias("says")).union(
        listed.select(F.lit("list"), F.lower(F.substring_index("entry", "/", 1)), F.expr("substring(entry, length(substring_index(entry, '/', 1)) + 1)"), F.lit("block"))
    )
    entries = entries.where("host is not null and path is not null").groupBy("kind", "host", "path").agg(F.max("says").alias("says"))
    entries = materialise(entries.withColumn("entry", F.concat("host", "path")).withColumn("key", F.concat_ws(" ", "kind", "entry")), "entries")
    sizes = entries.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    labels, lengths = sorted(sizes.labels), sorted(sizes.lengths)
    if not labels:
        return at.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow"), "entry": F.lit(None).cast("string")})
    plain = urls.select("host", "path", F.lit("rule").alias("kind"), F.col("host").alias("h"), F.col("path").alias("p"))
    canonical = urls.select("host", "path", F.lit("list").alias("kind"), F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":(80|443)?$", "").alias("h"), F.regexp_replace("path", r"/+", "/").alias("p"))
    numbers = lambda xs: F.array(*map(F.lit, xs))
    suffixes = F.transform(F.filter(numbers(labels), lambda n: n <= F.size(F.split("h", r"\."))), lambda n: F.call_function("substring_index", F.col("h"), F.lit("."), -n))
    prefixes = F.transform(F.filter(numbers(lengths), lambda n: n <= F.length("p")), lambda n: F.call_function("substring", F.col("p"), F.lit(1), n))
    candidates = plain.union(canonical).select("host", "path", "kind", F.explode(suffixes).alias("suffix"), "p").select("host", "path", "kind", "suffix", F.explode(prefixes).alias("prefix"))
    candidates = candidates.select("host", "path", F.concat_ws(" ", "kind", F.concat("suffix", "prefix")).alias("key"))
    hits = listed_hits(candidates, entries.select("key", "kind", F.col("entry").alias("fits"), F.length("host").alias("n_host"), "says"))
    # the longest wins: order by (length, host length, text) through a struct
    rank = F.struct(F.length("fits"), F.col("n_host"), F.col("fits"), F.col("says"))
    best = hits.groupBy("host", "path").agg(F.max(F.when(F.col("kind") == "rule", rank)).alias("r"), F.max(F.when(F.col("kind") == "list", rank)).alias("l"))
    judged = best.select("host", "path", F.col("r.fits").alias("rule"), F.col("r.says").alias(says), F.col("l.fits").alias("entry"))
    judged = materialise(judged.join(urls.withColumnRenamed("copies", copies), ["host", "path"]), "judged")
    found = join_one(at, judged, ["host", "path"], copies, "left")
    verdict = F.coalesce(says, F.when(F.col("entry").isNotNull(), "block"), F.lit("allow"))
    return found.select(*kept, "host", "path", "rule", verdict.alias("verdict"), "entry")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict, entry) of every page, by RULES and LISTED."""
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    listed = spark.createDataFrame([(x,) for x in LISTED], "entry string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules, listed).drop("url")


_values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_listed = ", ".join(f"('{x}')" for x in LISTED)
OP4_SQL = rf"""
WITH rules(says, rhost, rpath) AS (VALUES {_values}), listed(entry) AS (VALUES {_listed}),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS a FROM pages),
parts AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(a, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(substr(a, length(regexp_extract(a, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
fits AS (SELECT r, says, rhost || rpath AS rule, row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
    FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
lists AS (SELECT r, max(entry) AS entry FROM (SELECT r, path, regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', '') AS h, regexp_replace(path, '/+', '/', 'g') AS p FROM parts) x
    JOIN listed ON (h = split_part(entry, '/', 1) OR ends_with(h, '.' || split_part(entry, '/', 1))) AND starts_with(p, substr(entry, length(split_part(entry, '/', 1)) + 1)) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN entry IS NOT NULL THEN 'block' END, 'allow') AS verdict, entry
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (r) LEFT JOIN lists USING (r)
"""
