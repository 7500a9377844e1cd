"""Text functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{00A0}\x{FEFF}\x{2028}\x{2029}\x{3000}\x{2000}-\x{200A}\x{202F}\x{205F}\x{1680}]"


def clean(text: Column) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "))


def label_key(text: Column) -> Column:
    """A label for matching: lower case, 0 as o, punctuation as spaces."""
    return clean(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "0", "o"), r"[.\-_:;/\\]+", " "))


def secret_key(text: Column) -> Column:
    """The same, digits kept."""
    return clean(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[.\-_:;/\\]+", " "))


def candidate_key(text: Column) -> Column:
    return F.lower(clean(text))


def flat(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", "")


def contained(a: Column, b: Column) -> Column:
    """Whether candidate a lies strictly in b, white space aside; equal after collapsing counts if
    the texts themselves differ."""
    x, y = candidate_key(a), candidate_key(b)
    return F.when((x == "") | (y == "") | (x == y), False).otherwise(y.contains(x) | flat(y).contains(flat(x)))


def strip_edges(text: Column) -> Column:
    return F.regexp_replace(text, r"^[.,:;]+|[.,:;]+$", "")


def match_key(text: Column) -> Column:
    """A text for comparison of findings: spoken dots and ats written out, a-z 0-9 @ . only."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, r"\s+dot\s+", "."), r"\s+at\s+", "@")
    return F.regexp_replace(t, r"[^a-z0-9@.]", "")


def text_match(a: Column, b: Column) -> Column:
    """Either key holds the other, and the shorter has three characters at least."""
    x, y = match_key(a), match_key(b)
    return (F.least(F.length(x), F.length(y)) >= 3) & (x.contains(y) | y.contains(x))


def value_pattern(value: Column) -> Column:
    """A regular expression for a value whatever its white space."""
    return F.array_join(F.transform(F.split(F.trim(value), r"\s+"), lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"\s*")


def strip_tags(html: Column) -> Column:
    """Text of a page: scripts, styles and tags as spaces, collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"\s+", " "))


def first_heading(html: Column) -> Column:
    """Text of the first h1; empty without one."""
    return strip_tags(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))


def count_tag(html: Column, tag: str) -> Column:
    return F.regexp_count(html, F.lit(rf"(?i)<{tag}[\s>]")).cast("long")


# What block a tag stands for.
BLOCK_ROLES = {**dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"), "li": "list_item", **dict.fromkeys(("td", "th"), "table_cell"), **dict.fromkeys(("p", "div", "section", "article", "blockquote", "pre"), "paragraph")}


def block_role(tag: Column) -> Column:
    roles = F.create_map(*[F.lit(x) for kv in BLOCK_ROLES.items() for x in kv])
    return F.coalesce(F.try_element_at(roles, F.lower(tag)), F.lit("inline"))


def scope_key(path: Column) -> Column:
    """A DOM path less its last two parts."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 2)), "/")


def tr_prefix(path: Column) -> Column:
    """A DOM path up to its last table row; empty outside of one."""
    return F.regexp_extract(path, r"^(.*/tr\[[0-9]+\])", 1)


def bio_label(label: Column) -> tuple[Column, Column]:
    """(B, I or O; entity) of a token label such as B-CITY; a bare entity counts as B."""
    tag = F.regexp_extract(F.upper(label), r"^([BI])[-_]", 1)
    outside = F.upper(F.coalesce(label, F.lit("O"))).isin("O", "")
    return F.when(outside, "O").when(tag == "", "B").otherwise(tag), F.when(outside, F.lit(None)).otherwise(F.regexp_replace(F.upper(label), r"^[BI][-_]", ""))


def softmax(logits: Column) -> Column:
    """Max-shifted softmax of an array."""
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def round1(x: Column) -> Column:
    """One decimal, halves upwards."""
    return F.floor(x * 10 + 0.5) / 10


def caption(counts: Column) -> Column:
    """A sentence of counts by type from map<string, long>, never of values."""
    parts = F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e.value.cast("string"), F.lit(" "), F.lower(F.translate(e.key, "_", " "))))
    return F.when(F.size(counts) == 0, "No sensitive values were found.").otherwise(F.concat(F.lit("Redacted "), F.array_join(parts, ", "), F.lit(".")))
