"""Queries of actions, requests and pairing codes, on logs derived from pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import actions as A
from ..streaming import streams as M
from .common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _actions(spark, sf_dir):
    """A log of actions: parts as labels, tools and inputs by their key."""
    k = F.col("p_partkey")
    tools = F.array(*map(F.lit, ("click", "type", "select_option", "submit", "scroll", "")))
    inputs = F.array(*map(F.lit, ("text", "file", "", "color", "Email")))
    part = table(spark, sf_dir, "part")
    name = next(c for c, t in part.dtypes if t == "string")
    words = F.array(*map(F.lit, ("Delete it", "Pay now", "order", "Send", "confirm", "Close account", "transfer", "Next", "border")))
    pick = lambda a, n: F.get(a, (k % n).cast("int"))
    return part.select("p_partkey", pick(tools, 6).alias("tool"), pick(words, 9).alias("label"), F.col(name).alias("text"), pick(inputs, 5).alias("input_type"), (k % 4 == 0).alias("is_form_submit"))


def v19_destructive(spark, sf_dir):
    a = _actions(spark, sf_dir)
    reasons = A.destructive_reasons(F.col("tool"), F.col("label"), F.lit(""), F.col("input_type"), F.col("is_form_submit"))
    return a.select("p_partkey", F.array_join(reasons, ";").alias("reasons"), (F.size(reasons) > 0).alias("destructive"))


_hay = "lower(label)"
SQL["v19_destructive"] = (
    "WITH a AS (SELECT p_partkey, ['click', 'type', 'select_option', 'submit', 'scroll', ''][p_partkey % 6 + 1] AS tool, ['Delete it', 'Pay now', 'order', 'Send', 'confirm', 'Close account', 'transfer', 'Next', 'border'][p_partkey % 9 + 1] AS label, "
    "['text', 'file', '', 'color', 'Email'][p_partkey % 5 + 1] AS input_type, p_partkey % 4 = 0 AS sub FROM part), r AS (SELECT p_partkey, list_filter([CASE WHEN tool = 'submit' OR sub THEN 'form-submit' END, CASE "
    + " ".join(f"WHEN regexp_matches({_hay}, '{p}') THEN 'keyword:{p[:32]}'" for p in A.DESTRUCTIVE)
    + " END, CASE WHEN tool IN ('type', 'select_option') AND input_type <> '' AND lower(input_type) NOT IN ('text', 'search', 'email', 'tel', 'url', 'password', 'number') THEN 'unknown-input-type:' || input_type END, "
    "CASE WHEN tool NOT IN ('click', 'type', 'select_option', 'submit') THEN 'unknown-tool:' || CASE WHEN tool = '' THEN '(missing)' ELSE tool END END], lambda x: x IS NOT NULL) AS reasons FROM a) "
    "SELECT p_partkey, array_to_string(reasons, ';') AS reasons, len(reasons) > 0 AS destructive FROM r"
)


def c4_gate(spark, sf_dir):
    """Actions by tool: how many need approval."""
    return A.gate(_actions(spark, sf_dir).withColumn("text", F.lit(""))).groupBy("tool").agg(F.count("*").alias("n"), F.count_if("destructive").alias("n_gated"))


SQL["c4_gate"] = "WITH d AS (" + SQL["v19_destructive"] + ") SELECT ['click', 'type', 'select_option', 'submit', 'scroll', ''][p_partkey % 6 + 1] AS tool, count(*) AS n, count(*) FILTER (WHERE destructive AND p_partkey % 6 <> 4) AS n_gated FROM d GROUP BY 1"


def c1_tools(spark, sf_dir):
    return spark.createDataFrame([(t,) for t in A.TOOLS], "tool string")


SQL["c1_tools"] = f"SELECT unnest({list(A.TOOLS)}) AS tool"


def f6_tool_filter(spark, sf_dir):
    return c1_tools(spark, sf_dir).where(F.col("tool").contains("li"))


SQL["f6_tool_filter"] = f"SELECT tool FROM (SELECT unnest({list(A.TOOLS)}) AS tool) WHERE contains(tool, 'li')"


def c5_tool_calls(spark, sf_dir):
    """Properties of events as tool calls: what is wrong with them."""
    call = A.tool_call(F.concat(F.lit('{"tool":"'), F.col("event_type"), F.lit('","args":'), F.col("props"), F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", call.alias("c")).select("event_id", "c.tool", "c.problem")


SQL["c5_tool_calls"] = f"SELECT event_id, event_type AS tool, CASE WHEN event_type NOT IN {A.TOOLS} THEN 'unknown-tool' END AS problem FROM events"


def j20_correlate(spark, sf_dir):
    """Views as requests of users (id: the day's hour), purchases as responses within an hour."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.hour("ts").alias("id"), F.col("ts").alias("at"), "event_type")
    q = e.where("event_type = 'view'").select("client", "id", "at")
    r = e.where("event_type in ('purchase', 'error')").select("client", "id", "at", F.when(F.col("event_type") == "purchase", "ok").otherwise("error").alias("status"))
    return A.correlate(q, r, 3600)


SQL["j20_correlate"] = """
WITH e AS (SELECT user_id AS client, CAST(hour(ts) AS INT) AS id, ts AS "at", event_type FROM events), q AS (SELECT * FROM e WHERE event_type = 'view'), r AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'ok' ELSE 'error' END AS status FROM e WHERE event_type IN ('purchase', 'error')),
f AS (SELECT q.client, q.id, q."at", min(ROW(r."at", r.status)) FILTER (WHERE r."at" IS NOT NULL) AS r FROM q LEFT JOIN r ON q.client = r.client AND q.id = r.id AND r."at" >= q."at" AND r."at" <= q."at" + INTERVAL 3600 SECONDS GROUP BY ALL),
w AS (SELECT *, coalesce(max(coalesce(r[1], "at" + INTERVAL 3600 SECONDS)) OVER (PARTITION BY client, id ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > "at", false) AS pending FROM f)
SELECT client, id, "at", CASE WHEN pending THEN 'duplicate' WHEN r IS NULL THEN 'timeout' ELSE r[2] END AS status, CASE WHEN pending OR r IS NULL THEN NULL ELSE r[1] END AS answered_at FROM w
"""


def m6_pairing(spark, sf_dir):
    """Signups issue a code, purchases use it, errors mistype it: outcomes by kind."""
    kind = F.when(F.col("event_type") == "signup", "issue").when(F.col("event_type") == "purchase", "right").otherwise("wrong")
    e = table(spark, sf_dir, "events").where("event_type in ('signup', 'purchase', 'error')")
    rows = e.select(F.col("user_id").cast("string").alias("code_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), kind.alias("kind"))
    return M.replay_codes(rows).groupBy("kind", "outcome").agg(F.count("*").alias("n"))


def a22_status(spark, sf_dir):
    """Users by role (odd ones agents): how many, how many with an event of type signup."""
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.col("event_type") == "signup").alias("known"))
    return by.groupBy(F.when(F.col("user_id") % 2 == 1, "agent").otherwise("client").alias("role")).agg(F.count("*").alias("n"), F.count_if("known").alias("n_known"))


SQL["a22_status"] = "WITH b AS (SELECT user_id, bool_or(event_type = 'signup') AS known FROM events GROUP BY user_id) SELECT CASE WHEN user_id % 2 = 1 THEN 'agent' ELSE 'client' END AS role, count(*) AS n, count(*) FILTER (WHERE known) AS n_known FROM b GROUP BY 1"

QUERIES |= {f.__name__: f for f in (v19_destructive, c4_gate, c1_tools, f6_tool_filter, c5_tool_calls, j20_correlate, m6_pairing, a22_status)}
