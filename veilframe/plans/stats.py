"""Queries of statistics over events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import round1
from ..operators import stats as S
from .common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def a5_summarize(spark, sf_dir):
    return S.summarize(_events(spark, sf_dir), ["event_type"], "value")


_R1 = "floor(({x}) * 10 + 0.5) / 10"
SQL["a5_summarize"] = "SELECT event_type, count(value) AS n, " + ", ".join(f"{_R1.format(x=e)} AS {n}" for n, e in (("mean", "avg(value)"), ("median", "median(value)"), ("p95", "quantile_disc(value, 0.95)"), ("min", "min(value)"), ("max", "max(value)"), ("std", "coalesce(stddev_samp(value), 0)"))) + " FROM events GROUP BY event_type"


def a6_round1(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", round1(F.col("value") - 50).alias("rounded"))


SQL["a6_round1"] = "SELECT event_id, floor((value - 50) * 10 + 0.5) / 10 AS rounded FROM events"


def a7_slope(spark, sf_dir):
    """Trend of an event's value by its id, a user."""
    return _events(spark, sf_dir).groupBy("user_id").agg(F.round(S.slope(F.col("value"), F.col("event_id")), 8).alias("slope"))


SQL["a7_slope"] = "SELECT user_id, round(regr_slope(value, event_id), 8) AS slope FROM events GROUP BY user_id"


def a8_stage_summary(spark, sf_dir):
    """Milliseconds between a user's events, as durations of the later one's type."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    ms = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1000.0
    rows = _events(spark, sf_dir).withColumn("ms", ms).where("ms is not null")
    return S.summarize(rows, ["event_type"], "ms").withColumnRenamed("event_type", "stage")


SQL["a8_stage_summary"] = "WITH r AS (SELECT event_type AS stage, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000.0::DOUBLE AS ms FROM events), value AS (SELECT stage, ms::DOUBLE AS value FROM r WHERE ms IS NOT NULL) SELECT stage, count(value) AS n, " + ", ".join(f"{_R1.format(x=e)} AS {n}" for n, e in (("mean", "avg(value)"), ("median", "median(value)"), ("p95", "quantile_disc(value, 0.95)"), ("min", "min(value)"), ("max", "max(value)"), ("std", "coalesce(stddev_samp(value), 0)"))) + " FROM value GROUP BY stage"


def a9_drift(spark, sf_dir):
    """Drift of each user's values over their events."""
    out = S.drift(_events(spark, sf_dir), ["user_id"], "event_id", "value", 5.0)
    return out.select("user_id", "n", F.round("slope", 6).alias("slope"), F.round("drift", 6).alias("drift"), F.round("growth", 6).alias("growth"), "verdict")


SQL["a9_drift"] = """
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
g AS (SELECT user_id, count(*) AS n, regr_slope(value, i) AS slope, CASE WHEN count(*) >= 4 THEN median(value) FILTER (WHERE i >= n // 2) - median(value) FILTER (WHERE i < n // 2) END AS drift, max_by(value, i) - min_by(value, i) AS growth FROM r GROUP BY user_id)
SELECT user_id, n, round(slope, 6) AS slope, round(drift, 6) AS drift, round(growth, 6) AS growth, CASE WHEN n = 1 THEN 'single sample' WHEN drift IS NULL THEN 'too few samples' WHEN drift > 5.0 AND slope > 0 THEN 'leak signal' ELSE 'stable' END AS verdict FROM g
"""


def a11_suite_rollup(spark, sf_dir):
    """Counts by type and overall (summed), and mean of the types' means."""
    by = _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    total = by.agg(F.lit("(all)").alias("event_type"), F.sum("n").alias("n"), F.avg("mean").alias("mean"))
    return by.unionByName(total).select("event_type", "n", F.round("mean", 6).alias("mean"))


SQL["a11_suite_rollup"] = "WITH b AS (SELECT event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY event_type) SELECT event_type, n, round(mean, 6) AS mean FROM b UNION ALL SELECT '(all)', CAST(sum(n) AS BIGINT), round(avg(mean), 6) FROM b"


def a13_escalation(spark, sf_dir):
    """Paths of users' sessions through event types and the share with an error."""
    by = _events(spark, sf_dir).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ">").alias("path"), F.max(F.col("event_type") == "error").alias("hit"))
    return by.groupBy("path").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")) * 100, 6).alias("error_pct"))


SQL["a13_escalation"] = "WITH b AS (SELECT user_id, string_agg(DISTINCT event_type, '>' ORDER BY event_type) AS path, max(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS hit FROM events GROUP BY user_id) SELECT path, count(*) AS n, round(avg(hit) * 100, 6) AS error_pct FROM b GROUP BY path"


def a21_census(spark, sf_dir):
    return _events(spark, sf_dir).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.countDistinct("user_id").alias("n_users"))


SQL["a21_census"] = "SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, count(DISTINCT user_id) AS n_users FROM events"


def w4_stage_pairs(spark, sf_dir):
    """Views begin and purchases or errors end a user's stage."""
    rows = _events(spark, sf_dir).where("event_type in ('view', 'purchase', 'error')")
    status = F.when(F.col("event_type") == "view", "START").when(F.col("event_type") == "error", "ERROR").otherwise("DONE")
    out = S.stages(rows.select("user_id", "event_id", F.lit("visit").alias("stage"), status.alias("status")), ["user_id"], "event_id")
    return out.select("user_id", "stage", F.col("span").cast("long").alias("span"), F.coalesce("begun", F.lit(-1)).alias("begun"), F.coalesce("ended", F.lit(-1)).alias("ended"), "status")


SQL["w4_stage_pairs"] = """
WITH r AS (SELECT user_id, event_id, event_type = 'view' AS opens, event_type FROM events WHERE event_type IN ('view', 'purchase', 'error')),
s AS (SELECT *, coalesce(sum(CASE WHEN opens THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM r)
SELECT user_id, 'visit' AS stage, CAST(span AS BIGINT) AS span, coalesce(min(event_id) FILTER (WHERE opens), -1) AS begun, coalesce(max(event_id) FILTER (WHERE NOT opens), -1) AS ended,
  coalesce(max(CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' END), 'open') AS status FROM s GROUP BY user_id, span
"""


def w7_last_n(spark, sf_dir):
    """The last five turns of each conversation."""
    rows = S.last_n(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], 5)
    return rows.select("conv_id", "turn", "role")


SQL["w7_last_n"] = "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5"


def w9_half_medians(spark, sf_dir):
    """Medians of the halves of each type's events."""
    from pyspark.sql import Window as W

    w = W.partitionBy("event_type", "user_id")
    rows = _events(spark, sf_dir).withColumn("i", F.row_number().over(w.orderBy("event_id")) - 1).withColumn("n", F.count("*").over(w))
    late = F.col("i") >= F.floor(F.col("n") / 2)
    return rows.groupBy("event_type", "user_id").agg(F.median(F.when(~late, F.col("value"))).alias("first_half"), F.median(F.when(late, F.col("value"))).alias("second_half"))


SQL["w9_half_medians"] = "WITH r AS (SELECT event_type, user_id, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type, user_id) AS n FROM events) SELECT event_type, user_id, median(value) FILTER (WHERE i < n // 2) AS first_half, median(value) FILTER (WHERE i >= n // 2) AS second_half FROM r GROUP BY event_type, user_id"


def w10_first_runs(spark, sf_dir):
    """The first event of each user, and its type."""
    return _events(spark, sf_dir).groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"))


SQL["w10_first_runs"] = "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id"


def f5_log_filter(spark, sf_dir):
    """Events of type error whose properties hold a 7: shown and total, by user."""
    shown = (F.col("event_type") == "error") & F.lower("props").contains("7")
    return _events(spark, sf_dir).groupBy("user_id").agg(F.count_if(shown).alias("n_shown"), F.count("*").alias("n_total"))


SQL["f5_log_filter"] = "SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND contains(lower(props), '7')) AS n_shown, count(*) AS n_total FROM events GROUP BY user_id"


#: Fixed users: the first has no error.
_CLEAN = [(-1, "click"), (-1, "view"), (-2, "click"), (-2, "error")]


def f8_clean_runs(spark, sf_dir):
    """Users without any error, with their number of events."""
    events = _events(spark, sf_dir).select("user_id", "event_type").union(spark.createDataFrame(_CLEAN, "user_id long, event_type string"))
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.col("event_type") == "error").alias("bad")).where("not bad").select("user_id", "n")


SQL["f8_clean_runs"] = "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING NOT bool_or(event_type = 'error') UNION ALL SELECT -1, 2"


def m10_event_ring(spark, sf_dir):
    """The last 50 events of each type."""
    return S.last_n(_events(spark, sf_dir), ["event_type"], [F.desc("ts"), F.desc("event_id")], 50).select("event_type", "event_id")


SQL["m10_event_ring"] = "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50"


def m12_failure_streaks(spark, sf_dir):
    """Users with three errors in a row, and the event of the third."""
    return S.failure_streaks(_events(spark, sf_dir), ["user_id"], "event_id", F.col("event_type") == "error")


SQL["m12_failure_streaks"] = """
WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events),
k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS k FROM r WHERE event_type = 'error')
SELECT user_id, min(event_id) AS aborted_at FROM k WHERE k = 3 GROUP BY user_id
"""


def s19_drop_fields(spark, sf_dir):
    """Events as messages without their heavy field."""
    message = F.struct("event_id", "event_type", F.struct(F.col("props").alias("image"), F.col("value").alias("score")).alias("result"))
    light = message.withField("result", message["result"].dropFields("image"))
    return _events(spark, sf_dir).select("event_id", F.to_json(light).alias("message"))


SQL["s19_drop_fields"] = """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","result":{"score":' || value || '}}' AS message FROM events"""


def s23_latest_by_key(spark, sf_dir):
    """The latest event of each user: an upsert by key."""
    return S.last_n(_events(spark, sf_dir), ["user_id"], [F.desc("ts"), F.desc("event_id")], 1).select("user_id", "event_id", "event_type")


SQL["s23_latest_by_key"] = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"

QUERIES |= {
    f.__name__: f
    for f in (
        a5_summarize, a6_round1, a7_slope, a8_stage_summary, a9_drift, a11_suite_rollup, a13_escalation, a21_census, w4_stage_pairs, w7_last_n, w9_half_medians, w10_first_runs, f5_log_filter,
        f8_clean_runs, m10_event_ring, m12_failure_streaks, s19_drop_fields, s23_latest_by_key,
    )
}
