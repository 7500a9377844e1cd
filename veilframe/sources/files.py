"""Files: ground truth, runs, images as data, JSON and Markdown results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRUTH = "_fixture string, entities array<struct<id:string,entity_type:string,text:string,action:string,bbox:array<double>>>"


def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """(fixture, gt_ord, gt_id, entity_type, text, action, bbox) of the JSON files of a folder but
    the visual tasks; malformed files are left out. A file without a name for its fixture gives
    its own."""
    rows = spark.read.schema(TRUTH).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{folder}/*.json")
    rows = rows.withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.json$", 1)).where("file <> 'visual-tasks'")
    name = F.regexp_replace(F.coalesce("_fixture", "file"), r"\.html$", "")
    return rows.select(name.alias("fixture"), F.posexplode("entities").alias("gt_ord", "e")).select("fixture", "gt_ord", F.col("e.id").alias("gt_id"), "e.entity_type", "e.text", "e.action", "e.bbox")


def visual_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """(id, fixture, kind, check, expected) of a folder's visual tasks."""
    schema = "tasks array<struct<id:string,fixture:string,kind:string,check:string,expected:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(f"{folder}/visual-tasks.json").select(F.explode("tasks").alias("t")).select("t.*")


def runs(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Rows of run files with the file they are from; files in the order of their names."""
    return spark.read.schema(schema).json(pattern).withColumn("file", F.col("_metadata.file_name"))


def lines(spark: SparkSession, path: str, end: str = "END") -> DataFrame:
    """Lines of text files as texts, without those that only say END."""
    return spark.read.text(path).withColumnRenamed("value", "text").where(F.trim("text") != end)


def images(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, image) of image files."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("content").alias("image"))


def data_url(url: Column) -> Column:
    """The bytes of a base64 data URL; null for others."""
    data = F.regexp_extract(url, r"^data:[^;,]*;base64,(.*)$", 1)
    return F.when(data != "", F.unbase64(data))


def tools_of(answer: Column) -> Column:
    """Tools of a server's answer, JSON or an event stream's data line."""
    body = F.when(answer.rlike(r"(?m)^data:"), F.regexp_extract(answer, r"(?m)^data:\s*(.*)$", 1)).otherwise(answer)
    return F.from_json(F.get_json_object(body, "$.result.tools"), "array<struct<name:string,description:string,inputSchema:string>>")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def frames(top: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """A page's text with that of its frames (keys, frame_ord, text), a blank line between; frames
    without text count as unreachable."""
    kids = children.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("frame_ord", "text")))).alias("kids"), F.count_if(F.col("text").isNull()).alias("unreachable")
    )
    out = top.join(kids, keys, "left")
    text = F.array_join(F.array_compact(F.concat(F.array("text"), F.coalesce(F.col("kids.text"), F.array().cast("array<string>")))), "\n\n")
    return out.select(*keys, text.alias("text"), F.coalesce("unreachable", F.lit(0)).alias("unreachable"))


def markdown(df: DataFrame, missing: str = "-") -> str:
    """A small result as a Markdown table; nulls as `missing`."""
    rows = [[missing if v is None else str(v) for v in r] for r in df.collect()]
    head = [f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + [f"| {' | '.join(r)} |" for r in rows]) + "\n"


def report(sections: list[tuple[str, DataFrame | None]], title: str) -> str:
    """A Markdown report of small results (a row for each fixture, type, task or fact), each under
    its heading; what was not measured (none, or no rows) says so."""
    out = [f"# {title}", ""]
    for name, df in sections:
        table = markdown(df) if df is not None else ""
        out += [f"## {name}", "", table if table.count("\n") > 2 else "NOT MEASURED.", ""]
    return "\n".join(out)
