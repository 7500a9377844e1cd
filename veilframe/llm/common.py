"""What the training-data operators share: shared storage, Arrow maps, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A slice that a Python function sees at once holds at most so many rows and bytes of text
#: (and one row at least).
SLICE_ROWS, SLICE_BYTES = 4096, 8 << 20

#: Bytes of an Arrow batch between Spark and Python at most: each task holds several in memory
#: outside the heap, rounded up to powers of two.
BATCH_BYTES = 2 << 20


#: What an operator keeps in a Python worker between its tasks. Spark reuses workers, so the next
#: operator's first task in a worker lets go of the others' entries.
CACHE: dict[str, object] = {}


def let_go(keep: str | None) -> None:
    if gone := [k for k in CACHE if k != keep]:
        for k in gone:
            del CACHE[k]
        gc.collect()


def give_back() -> None:
    """Return what a task no longer needs to the system: idle workers share memory with the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the session names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="veilframe-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone by now; the folder is scratch space
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it: cuts the lineage, survives lost
    executors, is computed once. The files go when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veil_path = path
    atexit.register(_gone, weakref.ref(spark), path)
    return out


def _gone(spark: weakref.ref, path: str) -> None:
    if (s := spark()) is not None:
        remove(s, path)


def discard(df: DataFrame) -> None:
    if path := getattr(df, "_veil_path", None):
        remove(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly where the input has fewer partitions than the cluster has cores (one
    small file); larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def hot_keys(spark: SparkSession) -> int:
    """How many keys join_one() broadcasts: four for each shuffle partition, whatever the data."""
    return 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def join_one(rows: DataFrame, one: DataFrame, keys: list[str], n: str, how: str = "inner", several: bool = False) -> DataFrame:
    """rows joined on `keys` (no nulls) with `one`, which says in column `n` how many of rows have
    the key; how is inner or left. `one` is best written before; its rows are narrow and have
    distinct keys, unless there are `several` (few) of a key.

    The rows of the hot_keys() commonest keys are joined by a broadcast. All others are joined by a
    shuffle, in which no key has more than one in hot_keys() of all rows. rows is read twice.
    """
    named = one.select(*keys, n)
    named = (named.dropDuplicates(keys) if several else named).orderBy(F.desc(n), *keys).limit(hot_keys(rows.sparkSession))
    named = materialise(named.select(*keys), "hot")
    hot = one.join(F.broadcast(named), keys, "left_semi")
    rest = rows.join(F.broadcast(named), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(one, keys, how))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, bounded by SLICE_ROWS and SLICE_BYTES of column `at` (a text,
    binary, or a struct of texts)."""
    n, begin = batch.num_rows, 0
    column = batch.column(at)
    sizes = [0] * n
    for texts in column.flatten() if pa.types.is_struct(column.type) else [column]:
        sizes = [a + b for a, b in zip(sizes, pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist(), strict=True)]
    total = 0
    for i, size in enumerate(sizes):
        if i > begin and (total + size > SLICE_BYTES or i - begin >= SLICE_ROWS):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < n:
        yield batch.slice(begin)


def map_text(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list], list]],
    cache: str | None = None,
) -> DataFrame:
    """df with `fields` appended, computed from column `text` in Arrow batches.

    `make` runs once a task and returns a function from a list of texts to one list (or Arrow
    array) per field. A column of df whose name is that of a field is replaced. `cache` names the
    operator's entry of CACHE, if it has one.
    """
    conf = df.sparkSession.conf  # read when the plan runs, so the smaller bound has to stay set
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != str(BATCH_BYTES):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    new = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in new]
    if text not in kept:  # the text itself is to be replaced: pass it under another name
        alias = free_name(df, "veil_text")
        df, source, kept = df.withColumn(alias, F.col(text)), alias, kept
        df = df.select(*kept, source)
    else:
        source = text
        df = df.select(*kept)
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    at = df.columns.index(source)
    kept_at = [df.columns.index(c) for c in kept]
    names, from_spark = [f.name for f in schema], fields

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        let_go(cache)
        types = [to_arrow_type(f.dataType) for f in from_spark]
        work = make()
        for batch in batches:
            for part in slices(batch, at):
                out = work(part.column(at).to_pylist())
                cols = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in kept_at] + cols, names=names)
        del work
        give_back()

    return df.mapInArrow(run, schema)


def map_struct(df: DataFrame, name: str, fields: list[T.StructField], make) -> DataFrame:
    """map_text() for a column that is a struct of texts; the function gets dicts."""
    return map_text(df, name, fields, make)


def train_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, y) of labelled training rows, at most `most` of either class, by a hash of doc_id.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out and never taken. Repeated labels
    of a document count once (the largest); null labels and ids do not count. The ids are at most
    2 x most, so that the broadcast is bounded by that parameter. Of repeated rows of a document
    the smallest text (null counts as empty) is taken.
    """
    of = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .withColumn("deal", F.xxhash64("doc_id"))
    )
    both = [of.where(F.col("y") == y).orderBy("deal", "doc_id").limit(most) for y in (0, 1)]
    ids = both[0].union(both[1]).select("doc_id", "y")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph of edges (a, b); component is its smallest node.

    Alternating large-star and small-star rounds; each round is two aggregations and two joins on
    the edge list, written to the shared folder. Nothing is collected but a row of counts.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(edges, "edges")
    before = None
    while True:
        size = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == before or not size[0]:
            break
        before = size
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        after = materialise(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        discard(now)
        now = after
    nodes = now.groupBy("a").agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("a")).distinct().join(nodes, "a", "left_anti")
    return nodes.select(F.col("a").alias("node"), "component").union(roots.select(F.col("a").alias("node"), F.col("a").alias("component")))
