"""Balanced shards from global prefix sums of bytes. DataFrame operations only.

Rows are ordered by (hash of the text, id), which is range-partitioned. Sums per partition give
each partition's offset, a window within a partition the rest, so every row knows its global
offset in bytes and in rows. The total is cut at equal targets, a row going where its middle lies.
Equal texts are neighbours in this order; a group of them that takes at most 1/GROUP_PART of a
shard goes as a whole where its middle lies, a larger one is cut like other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_one, materialise, table

SHARDS = 8
#: Groups of equal texts up to this part of a shard's bytes stay together.
GROUP_PART = 500


def shards(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of docs.

    size: UTF-8 bytes of the text plus 1 (null: 1, like an empty text). Shards 0 to n - 1 are
    contiguous in the order, with bytes as equal as one row or kept group allows. slot numbers a
    shard's rows from 0. Null ids come first among equal texts; repeated rows are rows of their
    own. Fewer rows than shards leave some shards empty; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), F.xxhash64(whole).alias("h"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = materialise(rows.repartitionByRange(parts, "h", "doc_id").withColumn("p", F.spark_partition_id()), "ranges")
    # one row a partition, so that a single task may add them up
    sums = rows.groupBy("p").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("p", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    total = sums.agg(F.sum("bytes")).first()[0] or 1
    within = W.partitionBy("p").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        rows.withColumn("upto", F.sum("size").over(within))
        .withColumn("nth", F.count("*").over(within))
        .join(F.broadcast(offsets), "p")
        .select("doc_id", "size", "text_crc32", "h", (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("start"), (F.col("rows_before") + F.col("nth") - 1).alias("at"))
    )
    placed = materialise(placed, "placed")
    groups = placed.groupBy("h").agg(F.count("*").alias("copies"), F.sum("size").alias("g_size"), F.min("start").alias("g_start"))
    groups = groups.where((F.col("copies") > 1) & (F.col("g_size") * n * GROUP_PART <= total)).select("h", "copies", "g_size", "g_start")
    dealt = join_one(placed, materialise(groups, "groups"), ["h"], "copies", "left").select("doc_id", "size", "text_crc32", "at", F.least(F.lit(n - 1), F.expr(f"cast((coalesce(2 * g_start + g_size, 2 * start + size) * {n}) div {2 * total} as int)")).alias("shard"))
    dealt = materialise(dealt, "dealt")
    firsts = dealt.groupBy("shard").agg(F.min("at").alias("first"))  # n rows
    return dealt.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document, by the bytes law."""
    found = shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
