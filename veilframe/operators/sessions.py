"""Sessions of a device: its tier, approvals, cooldowns, restarts; accuracy over runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What names a dedicated or an integrated device.
DEDICATED_VENDORS = ("nvidia",)
DEDICATED_WORDS = ("geforce", "rtx", "gtx", "discrete", "arc a", "quadro")
DEDICATED_AMD_WORDS = ("rx ", "radeon pro", "discrete")
# Seconds for an approval, seconds of rest after a timeout, captures between restarts.
APPROVAL_S, COOLDOWN_S, CAPTURES = 55, 90, 15


def gpu_tier(vendor: Column, description: Column, fallback: Column) -> Column:
    """cpu for a fallback adapter; dedicated by vendor or words; integrated for any other adapter
    that names itself; else unknown. Nulls count as empty, a null fallback as false."""
    v, d = F.lower(F.coalesce(vendor, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    any_of = lambda c, words: F.coalesce(*[F.when(c.contains(w), True) for w in words], F.lit(False))
    own = any_of(v, DEDICATED_VENDORS) | any_of(d, DEDICATED_WORDS) | (v.contains("amd") & any_of(d, DEDICATED_AMD_WORDS))
    return F.when(F.coalesce(fallback, F.lit(False)), "cpu").when(own, "dedicated").when((v != "") | (d != ""), "integrated").otherwise("unknown")


def approvals(asks: DataFrame, answers: DataFrame, keys: list[str], window_s: int = APPROVAL_S) -> DataFrame:
    """asks (keys, at) with approved and reason, from answers (keys, at, kind).

    The first answer from the ask on until window_s seconds later counts; only "approve" approves.
    Of answers at one time the smallest kind counts. Without an answer the reason is "timeout".
    Null keys have no answer. Repeated asks have the same result.
    """
    of = answers.select(*keys, F.col("at").alias("veil_at"), F.col("kind").alias("veil_kind"))
    met = asks.select(*keys, "at").distinct().join(of, keys).where((F.col("veil_at") >= F.col("at")) & (F.col("veil_at") <= F.col("at") + window_s))
    first = met.groupBy(*keys, "at").agg(F.min(F.struct("veil_at", "veil_kind")).alias("veil_first"))
    out = asks.join(first, [*keys, "at"], "left")
    kind = F.col("veil_first.veil_kind")
    return out.withColumns({"approved": F.coalesce(kind == "approve", F.lit(False)), "reason": F.coalesce(kind, F.lit("timeout"))}).drop("veil_first")


def cooldown_step(until: float, at: float, took: float, timed_out: bool, rest_s: float = COOLDOWN_S) -> tuple[float, bool]:
    """The end of the rest after a call, and whether the call is skipped. A skipped call does not
    run, so its timeout does not count."""
    if at < until:
        return until, True
    return (at + took + rest_s if timed_out else until), False


def cooldowns(calls: DataFrame, key: str) -> DataFrame:
    """(key, at, skipped) of calls (key, at, took, timed_out), in order of time for each key. Null
    durations count as 0, null flags as false."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        until, rows = float("-inf"), []
        for c in pdf.sort_values(["at", "took", "timed_out"]).itertuples():
            until, skipped = cooldown_step(until, c.at, c.took, c.timed_out)
            rows.append((c.key, c.at, skipped))
        return pd.DataFrame(rows, columns=[key, "at", "skipped"])

    chosen = calls.select(F.col(key).cast("string").alias("key"), F.col("at").cast("double").alias("at"), F.coalesce(F.col("took").cast("double"), F.lit(0.0)).alias("took"), F.coalesce("timed_out", F.lit(False)).alias("timed_out"))
    return chosen.groupBy("key").applyInPandas(fold, f"`{key}` string, at double, skipped boolean")


def restarts(captures: DataFrame, key: str, after: int = CAPTURES) -> DataFrame:
    """(key, at, reason) of captures (key, at, events as array of (t, kind)): why the capture asks
    for a restart, else null.

    Device events later than any seen before ask for one; else the `after`-th capture since the last
    restart does (never for 0 or less). The count begins anew after a restart. Null events are none.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        n, seen, rows = 0, 0.0, []
        for c in pdf.sort_values("at").itertuples():
            n += 1
            fresh = [e for e in c.events if e["t"] > seen]
            seen = max([seen, *(e["t"] for e in fresh)])
            reason = f"gpu-event ({len(fresh)} new: {','.join(e['kind'] for e in fresh)})" if fresh else f"capture-count {n} >= {after}" if 0 < after <= n else None
            n = 0 if reason else n
            rows.append((c.key, c.at, reason))
        return pd.DataFrame(rows, columns=[key, "at", "reason"])

    event = "array<struct<t:double,kind:string>>"
    chosen = captures.select(F.col(key).cast("string").alias("key"), F.col("at").cast("double").alias("at"), F.coalesce(F.filter("events", lambda e: e.t.isNotNull()), F.array().cast(event)).cast(event).alias("events"))
    return chosen.groupBy("key").applyInPandas(fold, f"`{key}` string, at double, reason string")


def layout_digest(items: Column) -> Column:
    """A line for each item (text, box) that has a text: its rounded box and its text, quoted."""
    corner = lambda v: F.floor(v + 0.5).cast("string")
    box = lambda b: F.when(b.isNull(), "[]").otherwise(F.concat(F.lit("["), F.concat_ws(",", corner(b.x1), corner(b.y1), corner(b.x2), corner(b.y2)), F.lit("]")))
    return F.array_join(F.transform(F.filter(items, lambda i: F.coalesce(i.text, F.lit("")) != ""), lambda i: F.concat(F.lit("- "), box(i.box), F.lit(' "'), i.text, F.lit('"'))), "\n")


def accuracy(runs: DataFrame, by: list[str], means: list[str], medians: list[str]) -> DataFrame:
    """Over each group's runs: their number, the mean of ratios (name_mean) and the median of counts
    (name_p50); nulls do not count, and without a value the result is null."""
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), *[F.avg(c).alias(f"{c}_mean") for c in means], *[F.median(c).alias(f"{c}_p50") for c in medians])


def pass_rates(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, passed, scored, accuracy) of checks (by, ok, skipped): skipped ones do not count, ones
    without a result fail; accuracy is null where none counts."""
    rows = results.select(*by, F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce(~F.col("skipped"), F.lit(True)).alias("counts"))
    passed, scored = F.count_if(F.col("ok") & F.col("counts")), F.count_if("counts")
    return rows.groupBy(*by).agg(passed.alias("passed"), scored.alias("scored"), F.try_divide(passed, scored).alias("accuracy"))
