"""Redaction of pages by segments, and their text put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..sources.html import segments
from . import detect as D


def forced_placeholder(reason: Column, forced_type: Column) -> Column:
    """The placeholder of a value that is always redacted."""
    name = F.when(forced_type.rlike("^[A-Z0-9_]+$"), forced_type)
    name = F.coalesce(name, F.when(reason.rlike("password|hidden|cc-csc"), "PASSWORD").when(reason.contains("cc-number"), "CARD_NUMBER").otherwise("FORM_SECRET"))
    return F.concat(F.lit("<"), name, F.lit(">"))


def redact_segments(segs: DataFrame) -> DataFrame:
    """Segments with redacted and findings (type, source, confidence, forced; never a value)."""
    found = D.detect(segs)
    found = S.once(found, "extra", D.extra_spans(F.col("text")))
    found = S.once(found, "d", S.merge_free(F.col("detections"), F.col("extra"))).drop("detections", "extra")
    finding = lambda t, source, c, forced: F.struct(t.alias("type"), source.alias("source"), c.cast("double").alias("confidence"), F.lit(forced).alias("forced"))
    place = forced_placeholder(F.coalesce("force_reason", F.lit("")), F.coalesce("forced_type", F.lit("")))
    forced = F.array(finding(F.regexp_replace(place, "[<>]", ""), F.lit("dom"), F.lit(1.0), True))
    tier0 = F.transform("d", lambda s: finding(s.type, F.lit("dom"), s.confidence, False))
    return found.select(
        *segs.columns,
        F.when(F.col("force_redact"), place).otherwise(S.redact(F.col("text"), F.col("d"))).alias("redacted"),
        F.when(F.col("force_redact"), forced).otherwise(tier0).alias("findings"),
    )


def rebuild(segs: DataFrame, text: str = "redacted") -> DataFrame:
    """(page_id, document): texts in order; a blank line between blocks, one new line between list
    items or cells, a space between inline parts of a block. Attributes and form values are lines."""
    part = F.struct("seg_ord", F.col(text).alias("t"), "block_role", "kind")
    lists = segs.groupBy("page_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return lists.select("page_id", _document(F.col("parts")).alias("document"))


def _document(parts: Column) -> Column:
    """One text of parts (t, block_role, kind) in order."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("last"))

    def add(s: Column, p: Column) -> Column:
        role = F.when(p.kind != "text", "line").otherwise(p.block_role)
        gap = F.when(s.out == "", "").when((role == "inline") & (s["last"] == "inline"), " ").when(role.isin("list_item", "table_cell", "line") & (s["last"] == role), "\n").otherwise("\n\n")
        return F.struct(F.concat(s.out, gap, p.t).alias("out"), role.alias("last"))

    return F.aggregate(parts, start, add, lambda s: s.out)


def read_page(pages: DataFrame) -> DataFrame:
    """(page_id, status, sanitized_text, findings): what may leave, allow-listed fields only.

    Pages without any segment have an empty text; null pages report an error.
    """
    segs = redact_segments(segments(pages, associate=True))
    part = F.struct("seg_ord", F.col("redacted").alias("t"), "block_role", "kind", F.col("id").alias("segment_id"), "hint", "findings")
    lists = segs.groupBy("page_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    finding = lambda p, f: F.struct(f.type.alias("type"), f.source.alias("source"), f.confidence.alias("confidence"), p.segment_id.alias("segment_id"), f.forced.alias("force_redacted"), p.hint.alias("structural_hint"))
    finds = F.flatten(F.transform("parts", lambda p: F.transform(p.findings, lambda f: finding(p, f))))
    found = lists.select("page_id", _document(F.col("parts")).alias("document"), finds.alias("findings"))
    out = pages.select("page_id", F.col("html").isNull().alias("bad")).join(found, "page_id", "left")
    none = F.from_json(F.lit("[]"), found.schema["findings"].dataType)
    return out.select("page_id", F.when(F.col("bad"), "error").otherwise("ok").alias("status"), F.coalesce("document", F.lit("")).alias("sanitized_text"), F.coalesce("findings", none).alias("findings"))
