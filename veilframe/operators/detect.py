"""Detection and redaction of text: the detectors, overlaps, placeholders, a self-audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.patterns import EXTRA, MODEL_TYPES, TIER0, UNLABELED, Pattern
from ..functions.validators import example_email, placeholder_text
from ..functions.validators import digits as only_digits

#: A text without any of these has no match of a detector: a digit, an @ or a colon or sign after
#: a secret's label.
ANY = r"(?i)[0-9@]|[A-Z]{8}|passw|pwd|user|login|device|tax|tin|employee|customer|student|patient|policy|api"


def all_spans(text: Column, patterns: tuple[Pattern, ...] = TIER0, source: str = "tier0") -> Column:
    """All checked matches of all detectors, overlaps included; none for null texts."""
    found = S.matches(text, [(p, rank) for rank, p in enumerate(patterns)], source)
    return F.when(text.rlike(ANY), found).otherwise(S.none())


def detect(df: DataFrame, text: str = "text", name: str = "detections") -> DataFrame:
    """df with the disjoint detections of a text column (leftmost, longer, earlier detector)."""
    raw = S.once(df, "veil_raw", all_spans(F.col(text)))
    return S.once(raw, name, F.when(F.size("veil_raw") < 2, F.col("veil_raw")).otherwise(S.resolve_leftmost(F.col("veil_raw")))).drop("veil_raw")


def redact(df: DataFrame, text: str = "text", detections: str = "detections", name: str = "redacted") -> DataFrame:
    return S.once(df, name, S.redact(F.col(text), F.col(detections)))


def public(detections: Column) -> Column:
    """Detections without their values."""
    return F.transform(detections, lambda s: s.dropFields("value", "rank"))


def process(df: DataFrame, text: str = "text") -> DataFrame:
    """df with redacted text and value-free detections."""
    done = redact(detect(df, text), text)
    return done.withColumn("detections", public(F.col("detections")))


def extra_spans(text: Column) -> Column:
    """Spoken addresses (6 to 80 characters) and bare credentials (8 characters or more with a
    digit or sign)."""
    spoken = F.filter(S.matches(text, [(EXTRA[0], 100)], "dom"), lambda s: F.length(s.value).between(6, 80))
    credential = F.filter(S.matches(text, [(EXTRA[1], 101)], "dom"), lambda s: (F.length(s.value) >= 8) & s.value.rlike(r"[0-9#$%&*!?_]"))
    return F.concat(spoken, credential)


def unlabeled_ok(kind: Column, value: Column) -> Column:
    """Checks of formats that need no label."""
    n = F.length(only_digits(value))
    return (
        F.when(kind == "EMAIL", ~(example_email(value) | placeholder_text(value)))
        .when(kind == "PHONE", n.between(10, 15))
        .when(kind == "PASSWORD", (F.length(value) >= 8) & value.rlike(r"[0-9#$%&*!?_]"))
        .when(kind == "IFSC", F.regexp_replace(value, r"\s+", "").rlike("(?i)^[A-Z]{4}0[A-Z0-9]{6}$"))
        .otherwise(True)
    )


# The order of types that breaks exact ties; types missing here come first.
UNLABELED_ORDER = ("EMAIL", "PHONE", "TRACKING_NUMBER", "VAT_ID", "DATE", "CARD_NUMBER")


def unlabeled_spans(text: Column) -> Column:
    """Disjoint spans of the formats that need no label: longer, surer, then by type."""
    rank = lambda p: UNLABELED_ORDER.index(p.type) if p.type in UNLABELED_ORDER else -1
    found = S.matches(text, [(p, rank(p)) for p in UNLABELED], "format", check=False)
    return S.resolve_longest(F.filter(found, lambda s: unlabeled_ok(s.type, s.value)))


def normalized_value(kind: Column, value: Column) -> Column:
    return F.when(kind == "IFSC", F.regexp_replace(value, r"\s+", "")).otherwise(F.regexp_replace(F.trim(value), r"\s+", " "))


def self_audit(df: DataFrame, text: str = "text", model: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id",), passes: int = 2) -> DataFrame:
    """df with redacted, blocked and reason: fail-closed redaction.

    Detectors first; then model findings (keys, type, start, end on the redacted text, as a table)
    that touch no placeholder; then up to `passes` audits, each redacting what a new detection
    finds. A text that is still not clean is blocked: redacted is null, never empty. Null texts
    stay null and are not blocked.
    """
    out = redact(detect(df, text), text)
    if model is not None:
        known = F.col("type").isin(*MODEL_TYPES)
        span = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(0).alias("rank"), F.when(known, F.col("type")).otherwise("PII").alias("type"), F.lit("").alias("value"), F.col("score").cast("double").alias("confidence"), F.lit("ner").alias("source"))
        found = model.groupBy(*keys).agg(F.collect_list(span).alias("veil_model"))
        out = out.join(found, list(keys), "left")
        out = S.once(out, "veil_model", S.resolve_leftmost(S.without_holes(F.col("redacted"), F.coalesce("veil_model", S.none()))))
        out = S.once(out, "redacted", S.redact(F.col("redacted"), F.col("veil_model"))).drop("veil_model")
    # a text that the last step did not change has nothing new in it
    out = S.once(out, "veil_left", F.lit(True) if model is not None else F.size("detections") > 0)
    for step in range(passes + 1):
        out = S.once(out, "veil_again", F.when(F.col("veil_left"), all_spans(F.col("redacted"))).otherwise(S.none()))
        out = S.once(out, "veil_again", F.when(F.size("veil_again") > 0, S.resolve_leftmost(S.without_holes(F.col("redacted"), F.col("veil_again")))).otherwise(S.none()))
        out = S.once(out, "veil_left", F.coalesce(F.size("veil_again") > 0, F.lit(False)))
        if step < passes:
            out = S.once(out, "redacted", S.redact(F.col("redacted"), F.col("veil_again")))
    out = out.withColumnRenamed("veil_left", "blocked").drop("veil_again")
    return out.withColumn("redacted", F.when(~F.col("blocked"), F.col("redacted"))).withColumn("reason", F.when(F.col("blocked"), "residual-pii-after-audit"))
