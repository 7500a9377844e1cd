"""Queries over texts laid out as items: reading order, labels and values, fusion, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import spans as S
from ..operators import detect as D
from ..operators import fuse as U
from ..operators import layout as L
from ..sources.layout import items_of
from .common import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEYS = ["conv_id", "turn"]


def _items(spark, sf_dir):
    return items_of(spread(table(spark, sf_dir, "conversations")), KEYS)


def _ordered(spark, sf_dir):
    return L.reading_order(_items(spark, sf_dir), KEYS)


def w3_reading_order(spark, sf_dir):
    return _ordered(spark, sf_dir).select(*KEYS, "id", "row", "reading_order")


def l4_same_line(spark, sf_dir):
    return L.same_line(_items(spark, sf_dir), KEYS).select(*KEYS, "label", "field_type", "value", "confidence")


def j6_side_by_side(spark, sf_dir):
    return L.side_by_side(L.with_labels(_ordered(spark, sf_dir)), KEYS).select(*KEYS, F.array_join("ids", ",").alias("ids"), "label", "value", "confidence")


def j7_vertical(spark, sf_dir):
    return L.vertical(L.with_labels(_ordered(spark, sf_dir)), KEYS).select(*KEYS, F.array_join("ids", ",").alias("ids"), "label", "value", "confidence")


def j8_multi_line(spark, sf_dir):
    return L.multi_line(_ordered(spark, sf_dir), KEYS).select(*KEYS, F.array_join("ids", ",").alias("ids"), "label", "value", "confidence")


def j9_cross_item(spark, sf_dir):
    return L.cross_item(_ordered(spark, sf_dir), KEYS).select(*KEYS, F.array_join("ids", ",").alias("ids"), "value", "confidence")


def l9_row_formats(spark, sf_dir):
    return L.row_formats(_ordered(spark, sf_dir), KEYS).select(*KEYS, F.array_join("ids", ",").alias("ids"), "field_type", "value", "confidence")


def l10_field_candidates(spark, sf_dir):
    return L.field_candidates(_items(spark, sf_dir), KEYS).select(*KEYS, F.array_join("ids", ",").alias("ids"), "source", "field_type", "value", F.round("confidence", 6).alias("confidence"))


def j3_entity_items(spark, sf_dir):
    """Detections of documents with the lines that they touch (overlapping intervals)."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text")).select("doc_id", F.col("ord").cast("long").alias("ord"), F.concat(F.lit("line_"), F.col("ord").cast("string")).alias("id"), "text", F.lit(None).cast(G.BOX).alias("box"))
    entities = D.detect(docs).select("doc_id", F.explode("detections").alias("s")).select("doc_id", F.col("s.type").alias("entity"), F.col("s.confidence").alias("score"), "s.start", "s.end")
    found = L.findings_of_entities(entities, L.global_spans(lines, ["doc_id"]), ["doc_id"])
    return found.select("doc_id", "entity", "start", "end", "source_id")


def j13_relationships(spark, sf_dir):
    """Related pairs of items by image: how many of each relation."""
    pairs = L.relationships(_items(spark, sf_dir), KEYS)
    names = [c for c in pairs.columns if c not in (*KEYS, "a_id", "b_id")]
    return pairs.groupBy(*KEYS).agg(F.count("*").alias("n_pairs"), *[F.count_if(n).alias(f"n_{n}") for n in names])


def j14_input_candidates(spark, sf_dir):
    return L.input_candidates(_items(spark, sf_dir), KEYS).select(*KEYS, "label_id", "value_id", F.round("confidence", 6).alias("confidence"))


def l11_buttons(spark, sf_dir):
    return L.button_candidates(_items(spark, sf_dir), KEYS).select(*KEYS, "id", F.round("confidence", 6).alias("confidence"))


def l11_links(spark, sf_dir):
    return L.link_candidates(_items(spark, sf_dir), KEYS).select(*KEYS, "id", F.round("confidence", 6).alias("confidence"))


def a20_horizontal_groups(spark, sf_dir):
    return L.horizontal_groups(_ordered(spark, sf_dir), KEYS).select(*KEYS, "row", F.array_join("children", ",").alias("children"), F.round("confidence", 6).alias("confidence"))


def w6_containers(spark, sf_dir):
    return L.containers(_items(spark, sf_dir), KEYS).select(*KEYS, F.array_join("ids", ",").alias("ids"), F.round("confidence", 6).alias("confidence"))


def _candidates(spark, sf_dir):
    """Detections as a model's findings and formats as deterministic ones, on the same items."""
    items = _items_of_documents(spark, sf_dir)
    tier0 = S.once(items, "d", D.all_spans(F.col("text"))).withColumn("s", F.explode("d"))
    made = lambda source, text, label, share, box, at: F.struct(
        F.lit(source).alias("source"), F.array("id").alias("ids"), text.alias("text"), F.lit(label).cast("string").alias("label"), F.col("s.type").alias("type"),
        (F.col("s.confidence") * share).alias("confidence"), box.alias("box"), (F.col("ord") * 1000 + F.col("s.start") + at).alias("ord"),
    )
    model = made("ner", F.col("text"), None, 0.9, F.col("box"), 0)
    exact = made("deterministic_context", F.col("s.value"), "value", 1.0, G.sub_box(F.col("box"), F.col("text"), F.col("s.value")), 500)
    return tier0.select("doc_id", F.explode(F.array(model, exact)).alias("c")).select("doc_id", "c.*")


def _items_of_documents(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return items_of(docs, ["doc_id"]).where(F.col("text").rlike(D.ANY))


def a2_fuse(spark, sf_dir):
    fused = U.fuse(_candidates(spark, sf_dir), ["doc_id"])
    return fused.select("doc_id", "candidate_id", "text", F.array_join("types", ",").alias("types"), F.array_join("sources", ",").alias("sources"), F.round("confidence", 6).alias("confidence"))


def f4_review_tiers(spark, sf_dir):
    tiers = U.review(U.fuse(_candidates(spark, sf_dir), ["doc_id"]), ["doc_id"])
    return tiers.groupBy("tier").agg(F.count("*").alias("n"))


def f2_gates(spark, sf_dir):
    """Fused candidates by the gate that drops them."""
    fused = U.fuse(_candidates(spark, sf_dir), ["doc_id"])
    no = F.lit(False)
    rows = fused.select("doc_id", "text", F.col("confidence").alias("score"), "box", F.col("types")[0].alias("entity"), "types", "sources", F.lit("fusion_fallback").alias("decision"), no.alias("salvaged"), no.alias("confirmed"), no.alias("failed"), F.lit(None).cast("string").alias("ocr_text"), F.lit(None).cast(G.BOX).alias("ocr_box"))
    return U.gates(rows).groupBy("drop_gate").agg(F.count("*").alias("n"))


def s2_working_resolution(spark, sf_dir):
    """Sizes of lineitem's (quantity, price) as images, within 1600 on either side."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 40).cast("int").alias("w"), (F.col("l_linenumber") * 400).cast("int").alias("h"))
    size = G.working_scale(F.col("w"), F.col("h"))
    return rows.select("l_orderkey", "l_linenumber", size.width.alias("width"), size.height.alias("height"))


SQL["s2_working_resolution"] = """
WITH r AS (SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity * 40) AS INT) AS w, CAST(l_linenumber * 400 AS INT) AS h FROM lineitem), s AS (SELECT *, least(1.0::DOUBLE, 1600.0::DOUBLE / w, 1600.0::DOUBLE / h) AS k FROM r)
SELECT l_orderkey, l_linenumber, CAST(greatest(1, floor(w * k + 0.5)) AS INT) AS width, CAST(greatest(1, floor(h * k + 0.5)) AS INT) AS height FROM s
"""


def v13_clamp(spark, sf_dir):
    """Orders as boxes that stand over an image's edge, clamped with padding."""
    k = F.col("o_orderkey")
    b = G.box(k % 700 - 50, k % 500 - 20, k % 700 + 30, k % 500 + 10)
    c = G.clamp(b, F.lit(600), F.lit(400), 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", c.x1.alias("x1"), c.y1.alias("y1"), c.x2.alias("x2"), c.y2.alias("y2"))


_IN = lambda v, most: f"greatest(0.0::DOUBLE, least({most}.0::DOUBLE, ({v})::DOUBLE))"
SQL["v13_clamp"] = f"""
WITH b AS (SELECT o_orderkey, {_IN("o_orderkey % 700 - 50 - 2", 600)} AS x1, {_IN("o_orderkey % 500 - 20 - 2", 400)} AS y1, {_IN("o_orderkey % 700 + 30 + 2", 600)} AS x2, {_IN("o_orderkey % 500 + 10 + 2", 400)} AS y2 FROM orders),
r AS (SELECT *, floor(x2 - x1 + 0.5) > 0 AND floor(y2 - y1 + 0.5) > 0 AS ok FROM b)
SELECT o_orderkey, CASE WHEN ok THEN floor(x1 + 0.5) END AS x1, CASE WHEN ok THEN floor(y1 + 0.5) END AS y1, CASE WHEN ok THEN floor(x2 + 0.5) END AS x2, CASE WHEN ok THEN floor(y2 + 0.5) END AS y2 FROM r
"""


def v22_iou(spark, sf_dir):
    """Intersection over union of two boxes of each order."""
    k = F.col("o_orderkey")
    a, b = G.box(k % 10, k % 7, k % 10 + 10, k % 7 + 10), G.box(k % 13, k % 11, k % 13 + 12, k % 11 + 8)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(G.iou(a, b), 6).alias("iou"))


SQL["v22_iou"] = """
WITH b AS (SELECT o_orderkey, greatest(0, least(o_orderkey % 10 + 10, o_orderkey % 13 + 12) - greatest(o_orderkey % 10, o_orderkey % 13)) * greatest(0, least(o_orderkey % 7 + 10, o_orderkey % 11 + 8) - greatest(o_orderkey % 7, o_orderkey % 11)) AS i FROM orders)
SELECT o_orderkey, round(i::DOUBLE / (100 + 96 - i), 6) AS iou FROM b
"""


def k2_suppression(spark, sf_dir):
    """Boxes of each order's lines: which stay after non-maximum suppression."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    b = F.struct((F.col("l_extendedprice") % 100 / 100).cast("double").alias("score"), n.alias("n"), G.box(n * 20 + k % 5, k % 9, n * 20 + 40, k % 9 + 30).alias("box"))
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(b).alias("boxes"))
    return lists.select("l_orderkey", F.array_join(F.transform(G.suppress(F.col("boxes")), lambda x: x.n.cast("string")), ",").alias("kept"))


def u3_unique_regions(spark, sf_dir):
    """Orders' boxes: one for each rounded place of a customer."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", k.alias("ord"), G.box(k % 3 + 0.4, k % 2 + 0.2, k % 3 + 10, k % 2 + 5).alias("box"))
    return U.unique_regions(rows, ["o_custkey"]).select("o_custkey", F.col("ord").alias("first_order"))


SQL["u3_unique_regions"] = "SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey, floor(o_orderkey % 3 + 0.4 + 0.5), floor(o_orderkey % 2 + 0.2 + 0.5), floor(o_orderkey % 3 + 10.5), floor(o_orderkey % 2 + 5.5)"

QUERIES |= {
    f.__name__: f
    for f in (
        w3_reading_order, l4_same_line, j6_side_by_side, j7_vertical, j8_multi_line, j9_cross_item, l9_row_formats, l10_field_candidates, j3_entity_items, j13_relationships, j14_input_candidates,
        l11_buttons, l11_links, a20_horizontal_groups, w6_containers, a2_fuse, f4_review_tiers, f2_gates, s2_working_resolution, v13_clamp, v22_iou, k2_suppression, u3_unique_regions,
    )
}
