"""Layout: reading order, labels and values by geometry, structure of a screen.

Inputs are items (keys, ord, id, text, confidence, box). All joins have the image's keys as
equalities; what depends on an order of items is computed in arrays of one image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import spans as S
from ..functions import text as T
from ..functions import validators as V
from . import associate as A
from . import detect as D


def _middle(b: Column) -> Column:
    return (b.y1 + b.y2) / 2


def reading_order(items: DataFrame, keys: list[str]) -> DataFrame:
    """items with row, row_y and reading_order: rows from top to bottom, items from left to right.

    In order of their middles, items join the first row whose mean middle is nearer than
    max(8, 0.6 of the item's height), or begin a row. A fold over the image's items, as rows move
    when items join them.
    """
    item = F.struct(_middle(F.col("box")).alias("y"), "ord", (F.col("box.y2") - F.col("box.y1")).alias("h"))
    lists = items.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("list"))
    rows = "array<struct<sum:double,n:int,ords:array<bigint>>>"

    def put(state: Column, it: Column) -> Column:
        tol = F.greatest(F.lit(8.0), F.greatest(F.lit(1.0), it.h) * 0.6)
        at = F.array_position(F.transform(state, lambda r: F.abs(r["sum"] / r.n - it.y) < tol), True)
        joined = F.transform(state, lambda r, i: F.when(i + 1 == at, F.struct((r["sum"] + it.y).alias("sum"), (r.n + 1).alias("n"), F.concat(r.ords, F.array(it.ord)).alias("ords"))).otherwise(r))
        new = F.array(F.struct(it.y.alias("sum"), F.lit(1).alias("n"), F.array(it.ord).alias("ords")))
        return F.when(at > 0, joined).otherwise(F.concat(state, new))

    folded = lists.select(*keys, F.aggregate("list", F.array().cast(rows), put).alias("rows"))
    ordered = F.array_sort(F.transform("rows", lambda r: F.struct((r["sum"] / r.n).alias("y"), r.ords.alias("ords"))))
    exploded = folded.select(*keys, F.posexplode(ordered).alias("row", "r")).select(*keys, "row", F.col("r.y").alias("row_y"), F.explode("r.ords").alias("ord"))
    out = items.join(exploded, [*keys, "ord"])
    order = F.row_number().over(W.partitionBy(*keys).orderBy("row", "box.x1", "ord")) - 1
    return out.withColumn("reading_order", order)


_CANDIDATE = ("source", "ids", "label", "value", "field_type", "confidence", "reason", "box")


def _candidate(df: DataFrame, keys: list[str], source: str, ids: Column, label: Column, value: Column, kind: Column, confidence: Column | float, reason: str, box: Column) -> DataFrame:
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return df.select(*keys, F.lit(source).alias("source"), ids.alias("ids"), label.alias("label"), value.alias("value"), kind.alias("field_type"), c.alias("confidence"), F.lit(reason).alias("reason"), box.cast(G.BOX).alias("box"))


def with_labels(items: DataFrame) -> DataFrame:
    """items with hit: the label of a sensitive field that their text is, or null."""
    return S.once(items, "hit", A.field_label(F.col("text")))


def same_line(items: DataFrame, keys: list[str]) -> DataFrame:
    """Values within an item: "Label: value". The box is the value's part of the item's."""
    found = A.same_line(items).where("found is not null")
    return _candidate(found, keys, "deterministic_context", F.array("id"), F.col("found.label"), F.col("found.value"), F.col("found.type"), F.col("found.confidence"), "same line", G.sub_box(F.col("box"), F.col("text"), F.col("found.value")))


def _fit(value: Column, kind: Column) -> Column:
    return V.plausible_value(value) & F.coalesce(V.field_value_passes(kind, value), F.lit(True))


def side_by_side(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """The first plausible item to the right of a label in its row (gap of -5 at least)."""
    labels = ordered.where("hit is not null").alias("l")
    on = [F.col(f"l.{k}") == F.col(f"v.{k}") for k in keys] + [F.col("l.row") == F.col("v.row"), F.col("v.reading_order") > F.col("l.reading_order"), F.col("v.box.x1") - F.col("l.box.x2") >= -5, _fit(F.col("v.text"), F.col("l.hit.type"))]
    pairs = labels.join(ordered.alias("v"), on)
    order = W.partitionBy(*[F.col(f"l.{k}") for k in keys], F.col("l.ord")).orderBy("v.reading_order")
    first = pairs.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    first = first.select(*[F.col(f"l.{k}").alias(k) for k in keys], "l.id", "l.hit", F.col("v.id").alias("value_id"), F.col("v.text").alias("value"), F.col("v.box").alias("box"))
    return _candidate(first, keys, "deterministic_context", F.array("id", "value_id"), F.col("hit.label"), T.clean(F.col("value")), F.col("hit.type"), 0.92, "side by side", F.col("box"))


def _row_edges(ordered: DataFrame, keys: list[str]) -> DataFrame:
    rows = ordered.groupBy(*keys, "row").agg(F.min("box.y1").alias("top"), F.max("box.y2").alias("bottom"))
    return rows


def vertical(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """Plausible items of the next row (gap of 0 to 50) that stand under a label."""
    edges = _row_edges(ordered, keys)
    below = edges.select(*keys, (F.col("row") - 1).alias("row"), F.col("top").alias("next_top"))
    gaps = edges.join(below, [*keys, "row"]).where((F.col("next_top") - F.col("bottom")).between(0, 50)).select(*keys, "row")
    labels = ordered.where("hit is not null").join(gaps, [*keys, "row"], "left_semi").alias("l")
    l, v = F.col("l.box"), F.col("v.box")
    wide = F.greatest(l.x2 - l.x1, v.x2 - v.x1)
    shared = F.greatest(F.lit(0.0), F.least(l.x2, v.x2) - F.greatest(l.x1, v.x1)) / F.nullif(wide, F.lit(0.0))
    off = F.abs((l.x1 + l.x2) / 2 - (v.x1 + v.x2) / 2)
    on = [F.col(f"l.{k}") == F.col(f"v.{k}") for k in keys] + [F.col("l.row") + 1 == F.col("v.row"), (F.coalesce(shared, F.lit(0.0)) >= 0.15) | (off <= wide * 0.8), _fit(F.col("v.text"), F.col("l.hit.type"))]
    pairs = labels.join(ordered.alias("v"), on).select(*[F.col(f"l.{k}").alias(k) for k in keys], "l.id", "l.hit", F.col("v.id").alias("value_id"), F.col("v.text").alias("value"), F.col("v.box").alias("box"))
    return _candidate(pairs, keys, "deterministic_context", F.array("id", "value_id"), F.col("hit.label"), T.clean(F.col("value")), F.col("hit.type"), 0.9, "vertical", F.col("box"))


def multi_line(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """Labels over two rows; the value behind a colon in the second (0.88) or in the third (0.86)."""
    # a label's key is that of its parts with a space between, so that long pairs are left out before
    sized = S.once(ordered, "key_length", F.length(T.label_key(F.col("text"))))
    on = [F.col(f"u.{k}") == F.col(f"m.{k}") for k in keys] + [F.col("u.row") + 1 == F.col("m.row"), F.col("u.key_length") + F.col("m.key_length") < A.LONGEST]
    pairs = sized.alias("u").join(sized.alias("m"), on)
    pairs = pairs.select(*[F.col(f"u.{k}").alias(k) for k in keys], F.col("u.id").alias("u_id"), F.col("m.id").alias("m_id"), F.col("m.text").alias("m_text"), F.col("m.box").alias("m_box"), F.col("m.row").alias("m_row"), F.concat_ws(" ", "u.text", "m.text").alias("both"))
    found = S.once(pairs, "hit", A.field_label(F.col("both"))).where("hit is not null")
    after = F.trim(F.regexp_extract("m_text", r"(?s)^[^:]*:(.*)$", 1))
    inside = V.plausible_value(after) & F.col("m_text").contains(":")
    here = _candidate(found.where(inside), keys, "deterministic_context", F.array("u_id", "m_id"), F.col("hit.label"), T.clean(after), F.col("hit.type"), 0.88, "multi-line label", G.sub_box(F.col("m_box"), F.col("m_text"), after))
    rest = found.where(~inside).alias("p")
    on = [F.col(f"p.{k}") == F.col(f"v.{k}") for k in keys] + [F.col("p.m_row") + 1 == F.col("v.row"), V.plausible_value(F.col("v.text"))]
    below = rest.join(ordered.alias("v"), on).select(*[F.col(f"p.{k}").alias(k) for k in keys], "u_id", "m_id", F.col("p.hit").alias("hit"), F.col("v.id").alias("v_id"), F.col("v.text").alias("value"), F.col("v.box").alias("box"))
    return here.unionByName(_candidate(below, keys, "deterministic_context", F.array("u_id", "m_id", "v_id"), F.col("hit.label"), T.clean(F.col("value")), F.col("hit.type"), 0.86, "multi-line label, value below", F.col("box")))


def cross_item(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """Four bare digits whose left neighbour (gap -5 to 120) ends in a word such as "ending"."""
    left = W.partitionBy(*keys, "row").orderBy("box.x1", "ord")
    found = ordered.withColumn("anchor", F.lag(F.struct("text", "box")).over(left))
    gap = F.col("box.x1") - F.col("anchor.box.x2")
    ok = T.clean(F.col("text")).rlike("^[0-9]{4}$") & T.clean(F.col("anchor.text")).rlike(r"(?i)\b(ending|ends|last\s*4|card|account)\.?$") & gap.between(-5, 120)
    return _candidate(found.where(ok), keys, "deterministic_format", F.array("id"), T.clean(F.col("anchor.text")), T.clean(F.col("text")), F.lit("CARD_NUMBER"), 0.88, "cross-item anchor", F.col("box"))


def item_formats(items: DataFrame, keys: list[str]) -> DataFrame:
    """Formats that need no label, within an item; the box is the value's part."""
    found = S.once(items, "spans", D.unlabeled_spans(F.col("text"))).withColumn("s", F.explode("spans"))
    return _candidate(found, keys, "deterministic_format", F.array("id"), F.lit(None).cast("string"), D.normalized_value(F.col("s.type"), F.col("s.value")), F.col("s.type"), F.col("s.confidence"), "format", G.sub_box(F.col("box"), F.col("text"), F.col("s.value")))


def row_formats(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """The same over the joined text of a row of several items; ids and box of the items that a
    match touches."""
    part = F.struct("reading_order", "id", "text", "box")
    rows = ordered.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(part)).alias("parts")).where(F.size("parts") > 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<start:int,end:int,id:string,box:{G.BOX}>>").alias("out"))
    places = F.aggregate("parts", start, lambda s, p: F.struct((s.at + F.length(p.text) + 1).alias("at"), F.concat(s.out, F.array(F.struct(s.at.alias("start"), (s.at + F.length(p.text)).alias("end"), p.id.alias("id"), p.box.alias("box")))).alias("out")), lambda s: s.out)
    rows = rows.select(*keys, "row", F.array_join(F.col("parts.text"), " ").alias("text"), places.alias("places"))
    found = S.once(rows, "spans", D.unlabeled_spans(F.col("text"))).withColumn("s", F.explode("spans"))
    found = found.withColumn("touched", F.filter("places", lambda p: S.overlap(p, F.col("s")))).where(F.size("touched") > 1)
    return _candidate(found, keys, "deterministic_format", F.col("touched.id"), F.lit(None).cast("string"), D.normalized_value(F.col("s.type"), F.col("s.value")), F.col("s.type"), F.col("s.confidence"), "row format", G.union_of(F.col("touched.box")))


def labeled_first(labeled: DataFrame, formats: DataFrame, keys: list[str]) -> DataFrame:
    """Formats that no labeled candidate has in a shared item: the same value, or one within the
    other, whatever the case and the punctuation at the edges."""
    l, f = labeled.alias("l"), formats.alias("f")
    x, y = (F.lower(T.strip_edges(F.col(f"{c}.value"))) for c in "lf")
    within = (x == y) | ((x != "") & (y != "") & (x.contains(y) | y.contains(x)))
    return f.join(l, [*[F.col(f"l.{k}") == F.col(f"f.{k}") for k in keys], F.arrays_overlap("l.ids", "f.ids"), within], "left_anti")


def dedupe(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One candidate for each (type, value): the surest; ties by items, then reason."""
    order = W.partitionBy(*keys, "field_type", "value").orderBy(F.desc("confidence"), F.array_join("ids", ","), "reason")
    return candidates.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def field_candidates(items: DataFrame, keys: list[str]) -> DataFrame:
    """All candidates of images: labels with values by line, row and column, and formats."""
    ordered = S.kept(with_labels(reading_order(items, keys)))
    labeled = same_line(ordered, keys).unionByName(side_by_side(ordered, keys)).unionByName(vertical(ordered, keys)).unionByName(multi_line(ordered, keys))
    formats = item_formats(ordered, keys).unionByName(row_formats(ordered, keys)).unionByName(cross_item(ordered, keys))
    return dedupe(labeled.unionByName(labeled_first(labeled, formats, keys)), keys)


# --- structure of a screen ------------------------------------------------------------------------


def sizes(items: DataFrame, keys: list[str]) -> DataFrame:
    """items with their image's width and height (the largest x2 and y2) and centre, in parts."""
    w = W.partitionBy(*keys)
    b = F.col("box")
    out = items.withColumns({"image_w": F.max("box.x2").over(w), "image_h": F.max("box.y2").over(w), "cx": (b.x1 + b.x2) / 2, "cy": (b.y1 + b.y2) / 2, "w": b.x2 - b.x1, "h": b.y2 - b.y1})
    return out.withColumns({"nx": F.col("cx") / F.col("image_w"), "ny": F.col("cy") / F.col("image_h")})


def relationship(a: str, b: str) -> dict[str, Column]:
    """The seventeen relations of two sized items, as columns."""
    p, q = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    x, y = F.col(f"{a}.box"), F.col(f"{b}.box")
    dx, dy = F.abs(p("cx") - q("cx")), F.abs(p("cy") - q("cy"))
    ht, wt = F.greatest(F.lit(8.0), F.least(p("h"), q("h")) * 0.5), F.greatest(F.lit(8.0), F.least(p("w"), q("w")) * 0.5)
    ox = F.greatest(F.lit(0.0), F.least(x.x2, y.x2) - F.greatest(x.x1, y.x1))
    oy = F.greatest(F.lit(0.0), F.least(x.y2, y.y2) - F.greatest(x.y1, y.y1))
    much_x, much_y = ox > F.greatest(p("w"), q("w")) * 0.3, oy > F.greatest(p("h"), q("h")) * 0.3
    holds = lambda s, t: (s.x1 <= t.x1) & (s.y1 <= t.y1) & (s.x2 >= t.x2) & (s.y2 >= t.y2)
    row = dy < ht
    return {
        "same_row": row, "same_column": dx < wt, "above": x.y2 < y.y1 - 2, "below": x.y1 > y.y2 + 2, "left_of": x.x2 < y.x1 - 2, "right_of": x.x1 > y.x2 + 2,
        "near": (dx < wt + 20) & (dy < ht + 20), "overlaps": (ox > 0) & (oy > 0), "horizontally_aligned": row, "vertically_aligned": dx < wt, "significant_overlap": much_x,
        "significant_vertical_overlap": much_y, "contains": holds(x, y), "contains_reverse": holds(y, x),
        "likely_same_container": ((dx < p("image_w") * 0.3) & (dy < p("image_h") * 0.3)) | (much_x & ~row) | (much_y & row),
        "same_vertical_position": F.abs(p("ny") - q("ny")) < 0.1, "same_horizontal_position": F.abs(p("nx") - q("nx")) < 0.1,
    }


def relationships(items: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of an image's items (in order) with their relations, of those in the same row or
    column, near, overlapping or containing each other."""
    sized = sizes(items, keys)
    a, b = sized.alias("a"), sized.alias("b")
    rel = relationship("a", "b")
    keep = rel["same_row"] | rel["same_column"] | rel["near"] | rel["overlaps"] | rel["significant_overlap"] | rel["significant_vertical_overlap"] | rel["contains"] | rel["contains_reverse"]
    pairs = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.ord") < F.col("b.ord"), keep])
    return pairs.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), *[c.alias(n) for n, c in rel.items()])


def input_candidates(items: DataFrame, keys: list[str]) -> DataFrame:
    """Labels over values (gap 0 to 40) that overlap sideways; the first label of each value."""
    sized = sizes(items.where("length(text) >= 2"), keys)
    a, b = F.col("a.box"), F.col("b.box")
    gap = b.y1 - a.y2
    wide = F.greatest(F.col("a.w"), F.col("b.w"))
    ratio = F.coalesce(F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) / F.nullif(wide, F.lit(0.0)), F.lit(0.0))
    off = F.abs(F.col("a.cx") - F.col("b.cx"))
    strong = (ratio > 0.3) & (off < F.col("a.w") * 0.5)
    weak = (ratio > 0.15) & (off < F.col("a.w"))
    pairs = sized.alias("a").join(sized.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [(gap > 0) & (gap < 40), strong | weak])
    score = F.when(strong, 0.5 + 0.3 * ratio + 0.2 * (1 - off / F.greatest(F.col("a.w"), F.lit(1.0)))).otherwise(0.3 + 0.4 * ratio)
    rows = pairs.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.ord").alias("a_ord"), F.col("a.id").alias("label_id"), F.col("b.id").alias("value_id"), score.alias("confidence"))
    first = W.partitionBy(*keys, "value_id").orderBy("a_ord")
    return rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "a_ord")


def button_candidates(items: DataFrame, keys: list[str]) -> DataFrame:
    """Texts up to 30 characters that are compact (0.3), low on the screen (0.3), flat (0.2)."""
    sized = sizes(items, keys)
    n = F.length(T.clean(F.col("text")))
    part = lambda c, v: F.when(c, v).otherwise(0)
    score = part((F.col("w") < F.col("image_w") * 0.6) & (F.col("h") < F.col("image_h") * 0.3), 30) + part(F.col("ny") > 0.4, 30) + part(F.col("h") < F.col("image_h") * 0.25, 20)
    out = sized.where(n.between(1, 30)).withColumn("score", score / 100).where("score >= 0.75")
    return out.select(*keys, "id", F.least(F.lit(0.9), 0.5 + F.col("score") * 0.7).alias("confidence"))


# Words of links.
LINK_WORDS = ("forgot", "reset", "sign up", "login", "contact", "support", "previous", "next", "back", "home", "close", "cancel", "submit")


def link_candidates(items: DataFrame, keys: list[str]) -> DataFrame:
    """Texts up to 40 characters with a link's word (0.3) or of less than 40 in height (0.3)."""
    text = F.lower(T.clean(F.col("text")))
    flat = (F.col("box.y2") - F.col("box.y1")) < 40
    score = F.when(text.rlike("|".join(LINK_WORDS)), 30).otherwise(0) + F.when(flat, 30).otherwise(0)
    out = items.where(F.length(text).between(1, 40)).withColumn("score", score / 100).where("score >= 0.3")
    return out.select(*keys, "id", F.least(F.lit(0.85), 0.4 + F.col("score") * 0.7).alias("confidence"))


def horizontal_groups(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two items or more with similar heights (coefficient of variation under 0.5) that
    stand apart from the first one."""
    rows = ordered.groupBy(*keys, "row").agg(
        F.array_sort(F.collect_list(F.struct("box.x1", "id", "box"))).alias("list"), F.stddev_pop(F.col("box.y2") - F.col("box.y1")).alias("sd"), F.avg(F.col("box.y2") - F.col("box.y1")).alias("mean")
    )
    rows = rows.where((F.size("list") >= 2) & (F.col("sd") / F.greatest("mean", F.lit(1.0)) < 0.5))
    first = F.col("list")[0].box
    mid = lambda b: (b.x1 + b.x2) / 2
    apart = F.forall(F.slice("list", 2, F.size("list")), lambda x: mid(x.box) > mid(first) + F.greatest(x.box.x2 - x.box.x1, first.x2 - first.x1) * 0.3)
    out = rows.where(apart)
    return out.select(*keys, "row", F.col("list.id").alias("children"), G.union_of(F.col("list.box")).alias("box"), (0.7 + 0.3 * F.size("list") / 4).alias("confidence"))


def containers(items: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters of items around their first one, from the top: those near it that no earlier
    cluster has. Two items at least, under 0.8 of the image's width and height."""
    sized = sizes(items, keys)
    item = F.struct("cy", "cx", "ord", "id", "w", "h", "box")
    lists = sized.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("list"), F.max("image_w").alias("image_w"), F.max("image_h").alias("image_h"))
    kind = f"struct<cy:double,cx:double,ord:bigint,id:string,w:double,h:double,box:{G.BOX}>"

    def put(state: Column, it: Column) -> Column:
        close = lambda c: (F.abs(it.cx - c[0].cx) < (c[0].w + it.w) * 0.5 + 20) & (F.abs(it.cy - c[0].cy) < (c[0].h + it.h) * 0.5 + 20)
        at = F.array_position(F.transform(state, close), True)
        joined = F.transform(state, lambda c, i: F.when(i + 1 == at, F.concat(c, F.array(it))).otherwise(c))
        return F.when(at > 0, joined).otherwise(F.concat(state, F.array(F.array(it))))

    clusters = lists.select(*keys, "image_w", "image_h", F.explode(F.aggregate("list", F.array().cast(f"array<array<{kind}>>"), put)).alias("c"))
    out = clusters.where(F.size("c") >= 2).withColumn("box", G.union_of(F.col("c.box")))
    small = (F.col("box.x2") - F.col("box.x1") < F.col("image_w") * 0.8) & (F.col("box.y2") - F.col("box.y1") < F.col("image_h") * 0.8)
    return out.where(small).select(*keys, F.col("c.id").alias("ids"), "box", (0.5 + 0.3 * F.least(F.size("c") / 6, F.lit(1.0))).alias("confidence"))


def global_spans(items: DataFrame, keys: list[str]) -> DataFrame:
    """items with start and end: their places in the image's text, items joined by new lines."""
    w = W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    return items.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def findings_of_entities(entities: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Entities (keys, entity, score, start, end) with the items they touch; unmapped ones stay."""
    e, s = entities.alias("e"), spans.alias("s")
    found = e.join(s, [F.col(f"e.{k}") == F.col(f"s.{k}") for k in keys] + [F.col("s.start") < F.col("e.end"), F.col("s.end") > F.col("e.start")], "left")
    return found.select(*[F.col(f"e.{k}").alias(k) for k in keys], "e.entity", "e.score", "e.start", "e.end", F.coalesce("s.id", F.lit("unmapped")).alias("source_id"), F.col("s.box").alias("box"))
