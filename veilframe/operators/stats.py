"""Statistics of runs: summaries, trends, drift, retention, stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import round1


def summarize(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, median, p95 (nearest rank), min, max and std (sample; 0 for one value) of finite
    values, to one decimal; n is 0 and the rest null where there are none."""
    v = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), round1(F.avg(v)).alias("mean"), round1(F.median(v)).alias("median"), round1(F.expr(f"percentile_disc(0.95) within group (order by case when not isnan({value}) and abs({value}) <> double('infinity') then {value} end)")).alias("p95"),
        round1(F.min(v)).alias("min"), round1(F.max(v)).alias("max"), F.when(F.count(v) > 0, round1(F.coalesce(F.stddev_samp(v), F.lit(0.0)))).alias("std"),
    )


def slope(y: Column, x: Column) -> Column:
    """Least squares slope; null without variance of x."""
    return F.regr_slope(y, x)


def drift(df: DataFrame, by: list[str], order: str, value: str, limit: float) -> DataFrame:
    """Trend of a value over each group's runs: slope a run, median of the second half less that of
    the first (null under four runs), total growth, and a verdict (leak: both over their bounds)."""
    w = W.partitionBy(*by)
    rows = df.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    half = F.floor(F.col("n") / 2)
    late, early = F.when(F.col("i") >= half, F.col(value)), F.when(F.col("i") < half, F.col(value))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope(value, "i").alias("slope"), F.when(F.count("*") >= 4, F.median(late) - F.median(early)).alias("drift"), (F.max_by(value, "i") - F.min_by(value, "i")).alias("growth")
    )
    verdict = F.when(F.col("n") == 1, "single sample").when(F.col("drift").isNull(), "too few samples").when((F.col("drift") > limit) & (F.col("slope") > 0), "leak signal").otherwise("stable")
    return out.withColumn("verdict", verdict)


def last_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group: a top-k, as retention asks."""
    return df.withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= n).drop("nth")


def stages(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Stage durations of (by, order, stage, status in START, DONE, ERROR): the first start of a
    stage until its end; open without one."""
    w = W.partitionBy(*by, "stage").orderBy(order)
    ends = F.sum(F.when(F.col("status") != "START", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = df.withColumn("span", F.coalesce(ends, F.lit(0)))
    one = rows.groupBy(*by, "stage", "span").agg(F.min(F.when(F.col("status") == "START", F.col(order))).alias("begun"), F.max(F.when(F.col("status") != "START", F.col(order))).alias("ended"), F.max(F.when(F.col("status") != "START", F.lower("status"))).alias("status"))
    done = one.where("begun is not null or ended is not null")
    return done.select(*by, "stage", "span", "begun", "ended", F.coalesce("status", F.lit("open")).alias("status"))


def failure_streaks(df: DataFrame, by: list[str], order: str, failed: Column, n: int = 3) -> DataFrame:
    """Groups that had n failures in a row, with the order of the n-th."""
    w = W.partitionBy(*by).orderBy(order)
    rows = df.withColumn("bad", failed.cast("int"))
    rows = rows.withColumn("run", F.sum(1 - F.col("bad")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.where("bad = 1").withColumn("k", F.row_number().over(W.partitionBy(*by, "run").orderBy(order)))
    return rows.where(F.col("k") == n).groupBy(*by).agg(F.min(order).alias("aborted_at"))
