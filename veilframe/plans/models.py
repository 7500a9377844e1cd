"""Queries around models, on outputs derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import actions as A
from ..operators import detect as D
from ..operators import fuse as U
from ..operators import models as M
from ..sources.files import data_url
from .common import docs, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _tokens(spark, sf_dir):
    """Words of conversations as tokens: capitalised ones are names, with scores by length."""
    rows = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "text", F.regexp_extract_all("text", F.lit(r" ?[^ ]+"), F.lit(0)).alias("tokens"))
    rows = rows.withColumn("offsets", M.token_offsets(F.col("text"), F.col("tokens")))
    zipped = F.zip_with("tokens", "offsets", lambda t, o: F.struct(t.alias("text"), F.when(F.trim(t).rlike("^[A-Z]"), "B-FIRST_NAME").when(F.trim(t).rlike("[0-9]"), "I-PHONE_NUMBER").otherwise("O").alias("label"), (F.lit(1.0) / F.greatest(F.length(t), F.lit(1))).alias("score"), o.start.alias("start"), o.end.alias("end")))
    return rows.select("conv_id", "turn", "text", zipped.alias("tokens"))


def l13_token_offsets(spark, sf_dir):
    """Tokens whose place in the text holds them."""
    rows = _tokens(spark, sf_dir).select("conv_id", "turn", "text", F.explode("tokens").alias("t"))
    there = F.expr("substring(text, t.start + 1, t.end - t.start) = t.text")
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n_tokens"), F.count_if(there).alias("n_found"))


SQL["l13_token_offsets"] = "WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(text, ' ?[^ ]+')) AS n FROM conversations) SELECT conv_id, turn, n AS n_tokens, n AS n_found FROM t WHERE n > 0"


def a17_word_entities(spark, sf_dir):
    found = _tokens(spark, sf_dir).select("conv_id", "turn", F.explode(M.word_entities(F.col("tokens"))).alias("e"))
    return found.select("conv_id", "turn", "e.entity", "e.start", "e.end", F.round("e.score", 6).alias("score"))


def a16_adjacent_entities(spark, sf_dir):
    rows = _tokens(spark, sf_dir).select("conv_id", "turn", F.explode("tokens").alias("t")).where("t.label <> 'O'")
    pieces = rows.select("conv_id", "turn", F.substring_index("t.label", "-", -1).alias("entity"), "t.start", "t.end", "t.score")
    return M.adjacent_entities(pieces, ["conv_id", "turn"]).select("conv_id", "turn", "entity", "start", "end", F.round("score", 6).alias("score"))


def t17_bio_labels(spark, sf_dir):
    """Event types as token labels."""
    label = F.concat(F.when(F.col("event_id") % 3 == 0, "B-").when(F.col("event_id") % 3 == 1, "I-").otherwise(""), F.col("event_type"))
    prefix, kind = T.bio_label(label)
    return table(spark, sf_dir, "events").select(prefix.alias("prefix"), kind.alias("entity")).groupBy("prefix", "entity").agg(F.count("*").alias("n"))


SQL["t17_bio_labels"] = "SELECT CASE WHEN event_id % 3 = 1 THEN 'I' ELSE 'B' END AS prefix, upper(event_type) AS entity, count(*) AS n FROM events GROUP BY ALL"


def l14_token_labels(spark, sf_dir):
    """Embeddings' first three values as logits: the likeliest label of each."""
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    found = M.token_labels(table(spark, sf_dir, "embeddings").withColumn("logits", logits), "logits", ["O", "B-CITY", "I-CITY"])
    return found.select("vec_id", F.col("label").alias("token_label"), F.round("score", 6).alias("score"))


SQL["l14_token_labels"] = "WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, ['O', 'B-CITY', 'I-CITY'][list_position(v, list_max(v))] AS token_label, round(1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS score FROM e"


def s3_read_items(spark, sf_dir):
    """Order lines as read texts: those sure enough, with their boxes."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("x"), F.lit(2).alias("y"), F.col("l_quantity").alias("w"), F.lit(3).alias("h"), F.when(F.col("l_linenumber") == 3, " ").otherwise("text").alias("text"), (F.col("l_quantity") / 50).cast("double").alias("confidence"))
    return M.read_items(rows).select("l_orderkey", "l_linenumber", F.col("box.x2").alias("x2"))


SQL["s3_read_items"] = "SELECT l_orderkey, l_linenumber, CAST(l_linenumber + l_quantity AS DOUBLE) AS x2 FROM lineitem WHERE l_linenumber <> 3 AND CAST(l_quantity / 50 AS DOUBLE) >= 0.5"


def l22_faces(spark, sf_dir):
    """Embeddings as raw face outputs."""
    part = lambda x: F.abs(x.cast("double")) % 1
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(640).alias("width"), F.lit(480).alias("height"), F.transform("embedding", part).alias("boxes"), F.array(F.lit(0.9), F.lit(0.7), F.lit(0.3)).alias("scores"))
    return M.faces(rows, ["vec_id"]).select("vec_id", "source_id", "score", *[F.round(f"box.{c}", 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


def r5_redact_chunks(spark, sf_dir):
    """Lines of documents with the values detected in them taken out by text."""
    from ..functions import spans as S

    d = docs(spark, sf_dir)
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).select("doc_id", F.concat(F.lit("line_"), F.col("n").cast("string")).alias("id"), "text").where(F.col("text").rlike(D.ANY))
    found = S.once(lines, "d", D.all_spans(F.col("text"))).select("doc_id", F.col("id").alias("source_id"), F.explode("d").alias("s")).select("doc_id", "source_id", F.col("s.type").alias("entity"), F.col("s.value").alias("text"))
    return M.redact_chunks(lines, found, ["doc_id"]).where("redacted").select("doc_id", "id", "text")


def r6_regions(spark, sf_dir):
    """Orders' boxes as regions: faces blurred, others boxed."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(300).alias("width"), F.lit(200).alias("height"), F.when(k % 5 == 0, "FACE").otherwise("ID").alias("entity"), G.box(k % 310, k % 190, k % 310 + 20, k % 190 + 10).alias("box"))
    return M.regions(rows).groupBy("style").agg(F.count("*").alias("n"), F.count("region").alias("n_regions"), F.sum(F.col("region.x1")).cast("long").alias("sum_x1"))


SQL["r6_regions"] = """
WITH b AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 2 END AS p, o_orderkey % 310 AS x, o_orderkey % 190 AS y FROM orders),
c AS (SELECT p, greatest(0, x - p) AS x1, least(300, x + 20 + p) AS x2, greatest(0, y - p) AS y1, least(200, y + 10 + p) AS y2 FROM b)
SELECT CASE WHEN p = 3 THEN 'blur' ELSE 'box' END AS style, count(*) AS n, count(*) FILTER (WHERE x2 > x1 AND y2 > y1) AS n_regions, CAST(sum(x1) FILTER (WHERE x2 > x1 AND y2 > y1) AS BIGINT) AS sum_x1 FROM c GROUP BY p
"""


def t15_safe_captions(spark, sf_dir):
    """First sentences of documents as captions, without the values detected in their texts."""
    found = D.detect(docs(spark, sf_dir)).where(F.size("detections") > 0)
    known = F.transform("detections", lambda s: F.struct(s.value.alias("text"), s.type.alias("type")))
    return found.select("doc_id", M.safe_caption(F.col("text"), known).alias("caption"))


def t16_model_json(spark, sf_dir):
    """Properties of events within a model's talk: the JSON that is found."""
    said = F.concat(F.lit("Sure! ```json\n"), F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.replace("props", F.lit('"k"'), F.lit("k"))), F.lit("\n``` done"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(M.model_json(said), "$.k").cast("int").alias("k"))


SQL["t16_model_json"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"


def t19_tier_paths(spark, sf_dir):
    """Users' events as stages: how far they came."""
    name = F.when(F.col("event_type") == "view", "HEURISTICS").when(F.col("event_type") == "click", "NER").when(F.col("event_type") == "purchase", "REVIEW").otherwise("INIT")
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.hour("ts").alias("hour")).agg(F.collect_set(F.struct(name.alias("stage"), F.lit("done").alias("status"))).alias("stages"))
    return rows.groupBy(M.tier_path(F.col("stages")).alias("path")).agg(F.count("*").alias("n"))


SQL["t19_tier_paths"] = """
WITH s AS (SELECT user_id, hour(ts) AS h, bool_or(event_type = 'view') AS a, bool_or(event_type = 'click') AS b, bool_or(event_type = 'purchase') AS c FROM events GROUP BY ALL)
SELECT concat_ws('>', CASE WHEN a THEN 'T0' END, CASE WHEN b THEN 'T1' END, CASE WHEN c THEN 'T2' END) AS path, count(*) AS n FROM s GROUP BY 1
"""


def t20_prompts(spark, sf_dir):
    """A prompt for each document with detections; its length only."""
    found = D.detect(docs(spark, sf_dir)).where(F.size("detections") > 0)
    cands = F.transform("detections", lambda s, i: F.struct(F.concat(F.lit("cand_"), i.cast("string")).alias("candidate_id"), s.type.alias("type"), s.value.alias("text")))
    return found.select("doc_id", F.length(M.prompt(cands, F.col("text"))).cast("long").alias("n_chars"))


def t21_stage_info(spark, sf_dir):
    """A field of events' properties, some of them cut short."""
    info = F.when(F.col("event_id") % 4 == 0, F.substring("props", 1, 5)).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", M.stage_info(info, "k").alias("k"))


SQL["t21_stage_info"] = "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events"


def s1_data_urls(spark, sf_dir):
    """Texts as data URLs and back: bytes of each conversation's turn."""
    url = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8")))
    url = F.regexp_replace(url, r"[\r\n]", "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length(data_url(url)).cast("long").alias("n_bytes"))


SQL["s1_data_urls"] = "SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS n_bytes FROM conversations"


def s17_evidence(spark, sf_dir):
    found = D.detect(docs(spark, sf_dir)).select("doc_id", F.posexplode("detections").alias("i", "s"))
    rows = found.select("doc_id", F.concat(F.lit("src_"), F.col("i").cast("string")).alias("source_id"), F.col("s.type").alias("entity"), F.col("s.confidence").alias("score"))
    return M.evidence(rows, ["doc_id"])


def j5_global_spans(spark, sf_dir):
    """Lines of conversations found again in their whole text."""
    rows = table(spark, sf_dir, "conversations")
    items = F.transform(F.split("text", "\n"), lambda t, i: F.struct(F.concat(F.lit("ocr_"), i.cast("string")).alias("id"), t.alias("text")))
    spans = rows.select("conv_id", "turn", F.explode(M.global_spans(F.col("text"), items)).alias("s"))
    return spans.select("conv_id", "turn", "s.id", "s.start", "s.end")


def j15_adjudicate(spark, sf_dir):
    """A model's output on documents' candidates, some of it made up: what is wrong with it."""
    found = D.detect(docs(spark, sf_dir)).select("doc_id", F.posexplode("detections").alias("i", "s"))
    fused = found.select("doc_id", F.concat(F.lit("cand_"), F.col("i").cast("string")).alias("candidate_id"), F.col("s.value").alias("text"), F.array(F.lit("a")).alias("ids"), "i", "s.type")
    k = F.col("doc_id") + F.col("i")
    said = fused.select(
        "doc_id", F.when(k % 5 == 1, "cand_x").otherwise(F.col("candidate_id")).alias("candidate_id"), F.when(k % 5 == 2, F.array(F.lit("b"))).otherwise(F.col("ids")).alias("ids"),
        F.when(k % 5 == 3, "NO_TYPE").otherwise(F.col("type")).alias("type"), F.when(k % 5 == 4, "something else").otherwise(F.col("text")).alias("text"), F.lit(0.9).alias("confidence"),
    )
    from ..functions.patterns import MODEL_TYPES, TIER0

    out = U.adjudicate(fused.drop("i", "type"), said, ["doc_id"], tuple({p.type for p in TIER0} | set(MODEL_TYPES)))
    return out.groupBy("status").agg(F.count("*").alias("n"))


def j21_verdicts(spark, sf_dir):
    """Candidates left after a review that says no to every third of them."""
    found = D.detect(docs(spark, sf_dir)).select("doc_id", F.posexplode("detections").alias("i", "s"))
    fused = found.select("doc_id", F.concat(F.lit("cand_"), F.col("i").cast("string")).alias("candidate_id"), "i")
    answers = fused.select("doc_id", "candidate_id", F.when(F.col("i") % 3 == 0, "No.").when(F.col("i") % 3 == 1, "yes").otherwise("maybe").alias("answer"))
    return U.verdicts(fused, answers, ["doc_id"]).select("doc_id", "candidate_id")


def j22_references(spark, sf_dir):
    """References to customers' places after some have moved: which are stale."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("page_id"), F.col("c_custkey"))
    path = F.concat(F.lit("div["), F.col("c_custkey").cast("string"), F.lit("]"))
    refs = c.select("page_id", F.concat(F.lit("el_"), F.col("c_custkey").cast("string")).alias("ref"), path.alias("dom_path"), F.lit("a").alias("tag"), F.lit("x").alias("label"))
    now = c.where("c_custkey % 7 <> 0").select("page_id", path.alias("dom_path"), F.when(F.col("c_custkey") % 5 == 0, "button").otherwise("a").alias("tag"), F.when(F.col("c_custkey") % 3 == 0, "y").otherwise("x").alias("label"))
    return A.resolve_refs(refs, now).groupBy("state").agg(F.count("*").alias("n"))


SQL["j22_references"] = "SELECT CASE WHEN c_custkey % 7 = 0 THEN 'stale-gone' WHEN c_custkey % 5 = 0 THEN 'stale-tag' WHEN c_custkey % 3 = 0 THEN 'stale-label' ELSE 'ok' END AS state, count(*) AS n FROM customer GROUP BY 1"


def l17_crops(spark, sf_dir):
    """Orders' boxes with a margin of a quarter."""
    k = F.col("o_orderkey")
    c = M.crop(G.box(k % 280, k % 180, k % 280 + 40, k % 180 + 20), F.lit(300), F.lit(200))
    return table(spark, sf_dir, "orders").select("o_orderkey", c.x1.alias("x1"), c.y1.alias("y1"), c.x2.alias("x2"), c.y2.alias("y2"))


SQL["l17_crops"] = "SELECT o_orderkey, CAST(greatest(0, o_orderkey % 280 - 10) AS DOUBLE) AS x1, CAST(greatest(0, o_orderkey % 180 - 5) AS DOUBLE) AS y1, CAST(least(300, o_orderkey % 280 + 50) AS DOUBLE) AS x2, CAST(least(200, o_orderkey % 180 + 25) AS DOUBLE) AS y2 FROM orders"

def j17_value_boxes(spark, sf_dir):
    """Boxes of values detected in documents' items."""
    from .layout import _candidates, _items_of_documents

    fused = U.fuse(_candidates(spark, sf_dir), ["doc_id"])
    out = U.value_boxes(fused, _items_of_documents(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", "candidate_id", *[F.round(f"value_box.{c}", 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


def u5_contained_findings(spark, sf_dir):
    """Findings in documents' items less those that lie within others."""
    from ..functions import spans as S
    from .layout import _items_of_documents

    items = S.once(_items_of_documents(spark, sf_dir), "d", D.all_spans(F.col("text")))
    rows = items.select("doc_id", (F.col("ord") * 1000).alias("base"), F.col("id").alias("source_id"), "box", F.posexplode("d").alias("i", "s"))
    found = rows.select("doc_id", (F.col("base") + F.col("i")).alias("ord"), "source_id", F.col("s.value").alias("text"), F.col("s.confidence").alias("score"), "box")
    return U.drop_contained(found, ["doc_id"]).select("doc_id", "ord", "text")


def l15_adjudicate_or_fallback(spark, sf_dir):
    """Model output that is wrong for every third document: who decides, and how many findings."""
    found = D.detect(docs(spark, sf_dir)).select("doc_id", F.posexplode("detections").alias("i", "s"))
    fused = found.select("doc_id", F.concat(F.lit("cand_"), F.col("i").cast("string")).alias("candidate_id"), F.col("s.value").alias("text"), F.array(F.lit("a")).alias("ids"), F.array("s.type").alias("types"), F.col("s.confidence").alias("confidence"))
    said = fused.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "cand_x").otherwise(F.col("candidate_id")).alias("candidate_id"), "ids", F.col("types")[0].alias("type"), "text", F.lit(0.9).alias("confidence"))
    from ..functions.patterns import TIER0

    out = U.adjudicate_or_fallback(fused, said, ["doc_id"], tuple(p.type for p in TIER0))
    return out.groupBy("decision", "salvaged").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def s9_frames(spark, sf_dir):
    """Conversations as pages: their first turn with the others as frames, system turns unreachable."""
    from ..sources.files import frames

    c = table(spark, sf_dir, "conversations")
    kids = c.where("turn > 0").select("conv_id", F.col("turn").alias("frame_ord"), F.when(F.col("role") != "system", F.col("text")).alias("text"))
    out = frames(c.where("turn = 0").select("conv_id", "text"), kids, ["conv_id"])
    return out.select("conv_id", F.md5("text").alias("text_md5"), "unreachable")


SQL["s9_frames"] = """
SELECT conv_id, md5(string_agg(CASE WHEN turn = 0 OR role <> 'system' THEN text END, chr(10) || chr(10) ORDER BY turn)) AS text_md5, count(*) FILTER (WHERE turn > 0 AND role = 'system') AS unreachable
FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) GROUP BY conv_id
"""


def t5_contained(spark, sf_dir):
    """Neighbouring words of conversations of which one holds the other."""
    words = F.split("text", r"[ \n]+")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(pairs).alias("p"))
    return rows.groupBy("conv_id", "turn").agg(F.count_if(T.contained(F.col("p.a"), F.col("p.b"))).alias("n_contained"))


SQL["t5_contained"] = r"""
WITH w AS (SELECT conv_id, turn, regexp_split_to_array(text, '[ \n]+') AS w FROM conversations), p AS (SELECT conv_id, turn, lower(w[i]) AS a, lower(w[i + 1]) AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w))
SELECT conv_id, turn, count(*) FILTER (WHERE a <> '' AND b <> '' AND a <> b AND contains(b, a)) AS n_contained FROM p GROUP BY conv_id, turn
"""


def u7_distinct_sentences(spark, sf_dir):
    """Sentences of conversations, each once whatever its case."""
    parts = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda p: p != "")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(parts).cast("long").alias("n"), F.size(F.array_distinct(F.transform(parts, F.lower))).cast("long").alias("n_distinct"))
    return rows


QUERIES |= {
    f.__name__: f
    for f in (
        l13_token_offsets, a17_word_entities, a16_adjacent_entities, t17_bio_labels, l14_token_labels, s3_read_items, l22_faces, r5_redact_chunks, r6_regions, t15_safe_captions, t16_model_json,
        t19_tier_paths, t20_prompts, t21_stage_info, s1_data_urls, s17_evidence, j5_global_spans, j15_adjudicate, j21_verdicts, j22_references, l17_crops, j17_value_boxes, u5_contained_findings, l15_adjudicate_or_fallback,
        s9_frames, t5_contained, u7_distinct_sentences,
    )
}
