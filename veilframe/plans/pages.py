"""Queries over pages: segments, labels, tags, redaction, interactive elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import associate as A
from ..operators import pages as P
from ..sources.html import elements, segments
from .common import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages"))


def s4_segments(spark, sf_dir):
    return segments(_pages(spark, sf_dir)).select("page_id", "seg_ord", "kind", "tag", "attr", "block_role", "dom_path", F.length("text").cast("long").alias("n_chars"))


def s6_distinct_segments(spark, sf_dir):
    """Segments whose (tag, kind, attribute, path) occurs once in their page."""
    segs = segments(_pages(spark, sf_dir))
    return segs.groupBy("page_id", "kind", "tag", "attr", "dom_path").agg(F.min("seg_ord").alias("seg_ord"), F.count("*").alias("n"))


def s10_dom_text(spark, sf_dir):
    """Visible text of each page, a line a text."""
    segs = segments(_pages(spark, sf_dir)).where("kind = 'text'")
    lists = segs.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seg_ord", "text"))).alias("t"))
    return lists.select("page_id", F.array_join(F.col("t.text"), "\n").alias("text"))


def s18_read_page(spark, sf_dir):
    return P.read_page(_pages(spark, sf_dir)).select("page_id", "status", "sanitized_text", F.to_json("findings").alias("findings"))


def a18_rebuild(spark, sf_dir):
    return P.rebuild(segments(_pages(spark, sf_dir)), "text")


def r4_segment_redaction(spark, sf_dir):
    """Segments that redaction changes."""
    done = P.redact_segments(segments(_pages(spark, sf_dir), associate=True))
    return done.where(F.size("findings") > 0).select("page_id", "seg_ord", "force_redact", F.to_json("findings").alias("findings"), "redacted")


def j1_label_resolution(spark, sf_dir):
    """Form values with the label that belongs to them."""
    segs = segments(_pages(spark, sf_dir)).where("kind = 'form_value'")
    return segs.select("page_id", "seg_ord", F.col("hint.label_text").alias("label_text"), F.col("hint.autocomplete_type").alias("autocomplete_type"))


def j2_table_headers(spark, sf_dir):
    segs = segments(_pages(spark, sf_dir)).where("hint.table_header is not null")
    return segs.select("page_id", "seg_ord", F.col("hint.table_header").alias("table_header"))


SQL["j1_label_resolution"] = "SELECT page_id, CAST(NULL AS INT) AS seg_ord, CAST(NULL AS VARCHAR) AS label_text, CAST(NULL AS VARCHAR) AS autocomplete_type FROM pages WHERE regexp_matches(html, '(?i)<(input|select|textarea)[ >]')"
SQL["j2_table_headers"] = "SELECT page_id, CAST(NULL AS INT) AS seg_ord, CAST(NULL AS VARCHAR) AS table_header FROM pages WHERE regexp_matches(html, '(?i)<th[ >]')"


def l5_secret_labels(spark, sf_dir):
    """Texts of pages that name a secret."""
    segs = segments(_pages(spark, sf_dir)).where("kind = 'text'")
    hit = A.secret_label(F.col("text"))
    return segs.select("page_id", "seg_ord", hit.alias("h")).where("h is not null").select("page_id", "seg_ord", "h.label", "h.type", "h.weak")


def l7_associations(spark, sf_dir):
    segs = segments(_pages(spark, sf_dir), associate=True).where("force_redact")
    return segs.select("page_id", "seg_ord", "force_reason", "forced_type")


_TAGS = ("p", "li", "a", "div", "h1", "script", "table", "br")


def t10_tag_counts(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", *[T.count_tag(html, t).alias(f"n_{t}") for t in _TAGS])


SQL["t10_tag_counts"] = "SELECT page_id, " + ", ".join(rf"CAST(len(regexp_extract_all(html, '(?i)<{t}[\s>]')) AS BIGINT) AS n_{t}" for t in _TAGS) + " FROM pages"


def t10_first_heading(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.first_heading(F.col("html")).alias("h1"))


_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace({x}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
SQL["t10_first_heading"] = "SELECT page_id, " + _STRIP.format(x="regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)") + " AS h1 FROM pages"


def t10_strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("text_md5"))


SQL["t10_strip_tags"] = "SELECT page_id, md5(" + _STRIP.format(x="html") + ") AS text_md5 FROM pages"


def t11_block_roles(spark, sf_dir):
    """Segments by block role."""
    segs = segments(_pages(spark, sf_dir)).where("kind = 'text'")
    return segs.groupBy(T.block_role(F.col("tag")).alias("block_role")).agg(F.count("*").alias("n"))


def t12_scopes(spark, sf_dir):
    """Texts by scope (their path less two parts)."""
    segs = segments(_pages(spark, sf_dir)).where("kind = 'text'")
    return segs.groupBy("page_id", T.scope_key(F.col("dom_path")).alias("scope"), T.tr_prefix(F.col("dom_path")).alias("row")).agg(F.count("*").alias("n"))


def l20_static_checks(spark, sf_dir):
    """Static checks of each page: its first heading is its title, it has list items, rows, text."""
    html = F.col("html")
    body = T.strip_tags(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        (T.first_heading(html) == T.strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))).alias("heading_equals"),
        (T.count_tag(html, "li") >= 3).alias("li_count"),
        (T.count_tag(html, "tr") > 0).alias("tr_count"),
        T.strip_tags(html).contains("the").alias("contains_text"),
        (body == "").alias("body_empty"),
    )


SQL["l20_static_checks"] = (
    "SELECT page_id, " + _STRIP.format(x="regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)") + " = " + _STRIP.format(x="regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + " AS heading_equals, "
    r"len(regexp_extract_all(html, '(?i)<li[\s>]')) >= 3 AS li_count, len(regexp_extract_all(html, '(?i)<tr[\s>]')) > 0 AS tr_count, contains(" + _STRIP.format(x="html") + ", 'the') AS contains_text, "
    + _STRIP.format(x="regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1)") + " = '' AS body_empty FROM pages"
)


def l21_check_summary(spark, sf_dir):
    """Share of the static checks that pass; checks that were not measured (null) count as failed."""
    checks = l20_static_checks(spark, sf_dir)
    names = [c for c in checks.columns if c != "page_id"]
    rows = checks.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(n, F.lit(False)).alias("ok")) for n in names])).alias("c"))
    return rows.groupBy("c.name").agg(F.count_if("c.ok").alias("n_passed"), F.count("*").alias("n_scored"))


SQL["l21_check_summary"] = "WITH c AS (" + SQL["l20_static_checks"] + "), u AS (UNPIVOT c ON heading_equals, li_count, tr_count, contains_text, body_empty INTO NAME name VALUE ok) SELECT name, count(*) FILTER (WHERE ok) AS n_passed, count(*) AS n_scored FROM u GROUP BY name"


def l2_field_labels(spark, sf_dir):
    """Texts of pages that are labels of sensitive fields."""
    segs = segments(_pages(spark, sf_dir)).where("kind = 'text'")
    return segs.select("page_id", "seg_ord", A.field_label(F.col("text")).alias("h")).where("h is not null").select("page_id", "seg_ord", "h.label", "h.type")


def f7_interactive(spark, sf_dir):
    """Interactive elements by page with stable references, once for each path and tag."""
    return elements(_pages(spark, sf_dir)).select("page_id", "ref", "tag", "role", "label", "dom_path")


QUERIES |= {
    f.__name__: f
    for f in (
        s4_segments, s6_distinct_segments, s10_dom_text, s18_read_page, a18_rebuild, r4_segment_redaction, j1_label_resolution, j2_table_headers, l5_secret_labels, l7_associations, t10_tag_counts,
        t10_first_heading, t10_strip_tags, t11_block_roles, t12_scopes, l20_static_checks, l21_check_summary, l2_field_labels, f7_interactive,
    )
}
