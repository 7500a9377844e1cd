"""Text as items with boxes, as an optical reader would give them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box

#: The fixed-width model: characters of 8 by 16 on lines 20 apart.
WIDTH, HEIGHT, LEADING = 8, 16, 20


def items_of(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, ord, id, text, confidence, box): the parts of a text's lines between two spaces, a
    comma or a full stop, at the places that a fixed-width font gives them."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("row", "line"))
    parts = F.split("line", r"(?<=[.,])\s+|\s{2,}")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<x:int,t:string>>").alias("out"))
    placed = F.aggregate(parts, start, lambda s, t: F.struct((s.at + F.length(t) + 2).alias("at"), F.concat(s.out, F.array(F.struct(s.at.alias("x"), t.alias("t")))).alias("out")), lambda s: s.out)
    rows = lines.select(*keys, "row", F.posexplode(placed).alias("col", "p")).where("trim(p.t) <> ''")
    x, y = F.col("p.x") * WIDTH, F.col("row") * LEADING
    cell = box(x, y, x + F.length("p.t") * WIDTH, y + HEIGHT)
    order = F.col("row") * 100_000 + F.col("col")
    return rows.select(*keys, order.cast("long").alias("ord"), F.concat(F.lit("ocr_"), F.col("row").cast("string"), F.lit("_"), F.col("col").cast("string")).alias("id"), F.col("p.t").alias("text"), F.lit(0.9).alias("confidence"), cell.alias("box"))
