"""Actions of agents: which need approval, which arguments are valid, which requests were answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words of destructive actions, in order; only the first that fits is named.
DESTRUCTIVE = (
    r"delete|remove|erase|destroy|wipe",
    r"buy|purchase|checkout|pay\b|payment|order\b",
    r"\bsend\b|\bsubmit\b|confirm|irreversible|permanent",
    r"cancel (order|subscription|account)|close account|deactivate",
    r"transfer|withdraw",
)
SAFE_INPUTS = ("text", "search", "email", "tel", "url", "password", "number")
TOOLS = ("capture_tab", "read_page", "list_interactive_elements", "list_tabs", "click", "type", "select_option", "submit", "scroll")


def destructive_reasons(tool: Column, label: Column, text: Column, input_type: Column, is_submit: Column) -> Column:
    """Why an action needs approval; empty if it does not. Unknown tools and inputs do."""
    tool, kind = F.coalesce(tool, F.lit("")), F.coalesce(input_type, F.lit(""))
    hay = F.lower(F.trim(F.concat(F.coalesce(label, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))))
    word = F.coalesce(*[F.when(hay.rlike(p), F.lit(f"keyword:{p[:32]}")) for p in DESTRUCTIVE])
    return F.array_compact(
        F.array(
            F.when((tool == "submit") | F.coalesce(is_submit, F.lit(False)), "form-submit"),
            word,
            F.when(tool.isin("type", "select_option") & (kind != "") & ~F.lower(kind).isin(*SAFE_INPUTS), F.concat(F.lit("unknown-input-type:"), kind)),
            F.when(~tool.isin("click", "type", "select_option", "submit"), F.concat(F.lit("unknown-tool:"), F.when(tool == "", "(missing)").otherwise(tool))),
        )
    )


def gate(actions: DataFrame) -> DataFrame:
    """actions (tool, label, text, input_type, is_form_submit) with reasons and destructive;
    scrolling is never gated."""
    reasons = destructive_reasons(F.col("tool"), F.col("label"), F.col("text"), F.col("input_type"), F.col("is_form_submit"))
    out = actions.withColumn("reasons", F.when(F.coalesce(F.col("tool") == "scroll", F.lit(False)), F.array().cast("array<string>")).otherwise(reasons))
    return out.withColumn("destructive", F.size("reasons") > 0)


def tool_call(text: Column) -> Column:
    """struct(tool, args, problem) of a JSON tool call: its name known, its arguments an object."""
    name = F.get_json_object(text, "$.tool")
    args = F.get_json_object(text, "$.args")
    problem = F.when(F.get_json_object(text, "$").isNull(), "not-json").when(name.isNull() | ~name.isin(*TOOLS), "unknown-tool").when(~F.coalesce(F.ltrim(args).startswith("{"), F.lit(False)), "bad-arguments")
    return F.struct(name.alias("tool"), args.alias("args"), problem.alias("problem"))


def correlate(requests: DataFrame, responses: DataFrame, timeout_s: int = 60) -> DataFrame:
    """requests (client, id, at) with the status of their first response within the timeout, or
    "timeout". A request whose id is pending at its client is "duplicate"; late and repeated
    responses are ignored."""
    key = ["client", "id"]
    within = F.expr(f"interval {timeout_s} seconds")
    q, r = requests.alias("q"), responses.alias("r")
    near = [F.col("q.client") == F.col("r.client"), F.col("q.id") == F.col("r.id"), F.col("r.at") >= F.col("q.at"), F.col("r.at") <= F.col("q.at") + within]
    first = q.join(r, near, "left").groupBy(F.col("q.client").alias("client"), F.col("q.id").alias("id"), F.col("q.at").alias("at")).agg(F.min(F.struct("r.at", "r.status")).alias("r"))
    ended = first.withColumn("answered", F.coalesce("r.at", F.col("at") + within))
    w = W.partitionBy(*key).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    pending = F.max("answered").over(w) > F.col("at")
    status = F.when(F.coalesce(pending, F.lit(False)), "duplicate").when(F.col("r.at").isNull(), "timeout").otherwise(F.col("r.status"))
    return ended.select(*key, "at", status.alias("status"), F.when(status.isin("duplicate", "timeout"), F.lit(None)).otherwise(F.col("r.at")).alias("answered_at"))


def resolve_refs(refs: DataFrame, now: DataFrame) -> DataFrame:
    """refs (page_id, ref, dom_path, tag, label) with state: ok, or stale where the page's element
    at that path is gone or has another tag or label."""
    n = now.select("page_id", "dom_path", F.col("tag").alias("now_tag"), F.col("label").alias("now_label"))
    out = refs.join(n, ["page_id", "dom_path"], "left")
    state = F.when(F.col("now_tag").isNull(), "stale-gone").when(F.col("now_tag") != F.col("tag"), "stale-tag").when(~F.col("now_label").eqNullSafe(F.col("label")), "stale-label").otherwise("ok")
    return out.withColumn("state", state).drop("now_tag", "now_label")


#: Tools that act on an element, and inputs that text can be typed into.
REF_TOOLS = ("click", "type", "select_option", "submit")


def preview(actions: DataFrame, elements: DataFrame) -> DataFrame:
    """actions (page_id, tool, ref) with reason (null if it could be done) and what it would act on:
    tag, label, text, input_type and is_form_submit, as gate() takes them."""
    e = elements.select("page_id", "ref", "tag", "label", "text", "input_type", "is_submit", "has_form", "options")
    out = actions.drop("tag", "label", "input_type", "is_form_submit").withColumnRenamed("text", "typed").join(e, ["page_id", "ref"], "left")
    acts = F.coalesce(F.col("tool").isin(*REF_TOOLS), F.lit(False))
    scroll = F.coalesce(F.col("tool") == "scroll", F.lit(False))
    reason = F.when(scroll, F.lit(None)).when(~acts, "unsupported-tool").when(F.col("tag").isNull(), "unknown-ref")
    known = lambda c: F.when(reason.isNull() & ~scroll, F.coalesce(c, F.lit("")))
    submits = F.when(reason.isNull(), F.coalesce(~scroll & ((F.col("tool") == "submit") | F.col("is_submit")), F.lit(False)))
    return out.withColumns({"reason": reason, "label": known(F.col("label")), "text": known(F.col("text")), "input_type": known(F.col("input_type")), "is_form_submit": submits})


def execution(actions: DataFrame, elements: DataFrame) -> DataFrame:
    """actions (page_id, tool, ref, and text, value, direction as the tool wants) with reason: why
    it cannot be done, or null."""
    out = preview(actions, elements)
    typeable = (F.col("tag") == "textarea") | ((F.col("tag") == "input") & F.col("input_type").isin(*SAFE_INPUTS))
    wrong = (
        F.when(F.col("tool") == "scroll", F.when(~F.coalesce(F.col("direction").isin("up", "down"), F.lit(False)), "bad-arguments"))
        .when(F.col("tool") == "type", F.when(F.col("typed").isNull(), "bad-arguments").when(~typeable, "not-typeable"))
        .when(F.col("tool") == "select_option", F.when(F.col("tag") != "select", "not-typeable").when(F.col("value").isNull(), "bad-arguments").when(~F.array_contains("options", F.col("value")), "invalid-option"))
        .when(F.col("tool") == "submit", F.when(~F.col("has_form"), "no-form"))
    )
    return out.withColumn("reason", F.coalesce("reason", wrong)).select(*[c for c in actions.columns if c != "text"], F.col("typed").alias("text"), "reason")


def hello(messages: DataFrame, paired: DataFrame) -> DataFrame:
    """messages (token, role) with status: welcome and the client's id where the token is known and
    the role (extension if null) is the client's, else unauthorized."""
    known = paired.select(F.col("token"), F.col("client_id"), F.coalesce("role", F.lit("extension")).alias("paired_role"))
    out = messages.join(known, "token", "left")
    ok = F.coalesce(F.col("paired_role") == F.when(F.col("role") == "agent", "agent").otherwise("extension"), F.lit(False))
    return out.select(*messages.columns, F.when(ok, "welcome").otherwise("unauthorized").alias("status"), F.when(ok, F.col("client_id")).alias("client_id"))


def target_socket(sockets: DataFrame, keys: list[str]) -> DataFrame:
    """The socket (client_id) that a bridge's calls go to: of the open, authenticated ones of
    extensions the one active last."""
    able = sockets.where(F.col("authenticated") & F.col("open") & (F.col("role") == "extension"))
    return able.groupBy(*keys).agg(F.max_by("client_id", F.struct(F.coalesce("last_active", F.lit(0)), "client_id")).alias("client_id"))
