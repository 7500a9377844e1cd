"""Evaluation of findings against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

# Types that count as the same.
ALIASES = {"PERSON_NAME": ("PERSON_NAME", "FIRST_NAME", "LAST_NAME", "FULL_NAME", "NAME"), "ADDRESS": ("ADDRESS", "STREET_ADDRESS", "LOCATION"), "DATE": ("DATE", "DOB", "TIME")}


def type_compatible(truth: Column, found: Column) -> Column:
    g, f = F.upper(F.coalesce(truth, F.lit(""))), F.upper(F.coalesce(found, F.lit("unknown")))
    out = g == f
    for name, others in ALIASES.items():
        out = out | ((g == name) & f.isin(*others))
    return out


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; null where a denominator is 0."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return p, r, F.try_divide(2 * p * r, p + r)


def score_runs(truth: DataFrame, findings: DataFrame, runs: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """tp, fp, fn, type_mismatch and over_redact of each run.

    truth: on, gt_ord, gt_id, entity_type, text, action (REDACT or LEAVE). findings: keys, ord,
    entity, text. runs: keys with the `on` columns among them. A finding matches the first REDACT
    truth (in order) whose text holds it or lies in it; truth matched by several counts once. A
    finding without match that matches a LEAVE text over-redacts. Truth without text is left out.
    """
    texts = truth.where("text is not null").select(*on, "gt_ord", "gt_id", "entity_type", "action", T.match_key(F.col("text")).alias("gt_key"))
    found = findings.select(*keys, "ord", "entity", T.match_key(F.col("text")).alias("key"))
    x, y = F.col("key"), F.col("gt_key")
    near = (F.least(F.length(x), F.length(y)) >= 3) & (x.contains(y) | y.contains(x))
    pairs = found.join(texts, on).where(near)
    g = F.struct("gt_ord", "gt_id", "entity_type")
    best = pairs.groupBy(*keys, "ord").agg(F.min(F.when(F.col("action") == "REDACT", g)).alias("g"), F.max(F.col("action") == "LEAVE").alias("left"), F.first("entity").alias("entity"))
    counts = best.groupBy(*keys).agg(
        F.countDistinct("g.gt_id").alias("tp"), F.count("g").alias("n_matched"), F.count_if(F.col("g").isNotNull() & ~type_compatible(F.col("g.entity_type"), F.col("entity"))).alias("type_mismatch"),
        F.count_if(F.col("g").isNull() & F.col("left")).alias("over_redact"),
    )
    totals = findings.groupBy(*keys).agg(F.count("*").alias("n_found"))
    wanted = texts.where("action = 'REDACT'").groupBy(*on).agg(F.countDistinct("gt_id").alias("n_truth"))
    out = runs.select(*keys).distinct().join(counts, keys, "left").join(totals, keys, "left").join(wanted, on, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(*keys, zero(F.col("tp")).alias("tp"), (zero(F.col("n_found")) - zero(F.col("n_matched"))).alias("fp"), (zero(F.col("n_truth")) - zero(F.col("tp"))).alias("fn"), zero(F.col("type_mismatch")).alias("type_mismatch"), zero(F.col("over_redact")).alias("over_redact"))


def micro(scores: DataFrame, by: list[str]) -> DataFrame:
    """Summed counts of runs with precision, recall and F1."""
    sums = scores.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn", "type_mismatch", "over_redact")], F.count("*").alias("runs"))
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("*", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def best_iou(truth: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """truth (keys, gt_id, box) with the best intersection over union of a finding's box; 0 without."""
    g, f = truth.alias("g"), findings.select(*keys, "box").alias("f")
    pairs = g.join(f, [F.col(f"g.{k}") == F.col(f"f.{k}") for k in keys], "left")
    iou = F.when(F.col("f.box").isNotNull(), G.iou(F.col("g.box"), F.col("f.box"))).otherwise(0.0)
    return pairs.groupBy(*[F.col(f"g.{k}").alias(k) for k in keys], "gt_id").agg(F.max(iou).alias("iou"))
