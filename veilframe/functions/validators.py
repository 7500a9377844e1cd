"""Checks of values: checksums, shapes, plausibility, confidence. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import CONTEXT_WORDS, STRONG_TYPES

# The multiplication and permutation tables of the Verhoeff check.
VERHOEFF_D = ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 2, 3, 4, 0, 6, 7, 8, 9, 5), (2, 3, 4, 0, 1, 7, 8, 9, 5, 6), (3, 4, 0, 1, 2, 8, 9, 5, 6, 7), (4, 0, 1, 2, 3, 9, 5, 6, 7, 8), (5, 9, 8, 7, 6, 0, 4, 3, 2, 1), (6, 5, 9, 8, 7, 1, 0, 4, 3, 2), (7, 6, 5, 9, 8, 2, 1, 0, 4, 3), (8, 7, 6, 5, 9, 3, 2, 1, 0, 4), (9, 8, 7, 6, 5, 4, 3, 2, 1, 0))
VERHOEFF_P = ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), (5, 8, 0, 3, 7, 9, 6, 1, 4, 2), (8, 9, 1, 6, 0, 4, 3, 7, 2, 5), (9, 4, 5, 3, 1, 2, 6, 8, 7, 0), (4, 2, 8, 6, 5, 7, 3, 9, 0, 1), (2, 7, 9, 3, 8, 0, 6, 4, 1, 5), (7, 0, 4, 6, 9, 1, 3, 2, 5, 8))

# Texts and domains that stand for examples.
PLACEHOLDERS = (
    "name@example.com", "user@example.com", "test@example.com", "example@example.com", "your@email.com", "yourname@example.com", "example.com", "enter your email", "enter email",
    "your email", "email address", "enter username", "your username", "username", "enter password", "your password", "password", "phone number", "enter phone number", "123456",
    "000000", "xxxx", "xxxxx", "********",
)
EXAMPLE_DOMAINS = ("example.com", "example.org", "example.net")

#: Six characters of a line or more, with a letter and a digit among what follows. If that holds from
#: any place of a line, it does from its start: tried there only, so that time is linear.
_MIXED = r"(?m)^(?=.*[a-zA-Z])(?=.*[0-9]).{6,}"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(value: Column) -> Column:
    """13 to 19 digits (other characters aside) whose Luhn sum is right."""
    d = digits(value)
    return F.coalesce(F.length(d).between(13, 19) & F.call_function("luhn_check", d), F.lit(False))


def _table(rows: tuple) -> Column:
    return F.array(*[F.lit(x) for row in rows for x in row])


def verhoeff(value: Column) -> Column:
    """12 digits, the first not 0 or 1, whose Verhoeff sum is 0."""
    d = digits(value)
    signs = F.transform(F.split(F.reverse(d), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    steps = F.transform(signs, lambda x, i: F.struct(x.alias("x"), (i % 8).alias("i")))
    total = F.aggregate(steps, F.lit(0), lambda s, t: F.element_at(_table(VERHOEFF_D), s * 10 + F.element_at(_table(VERHOEFF_P), t.i * 10 + t.x + 1) + 1))
    return F.coalesce(d.rlike("^[2-9][0-9]{11}$") & F.when(d.rlike("^[2-9][0-9]{11}$"), total == 0), F.lit(False))


def iban(value: Column) -> Column:
    """Upper-cased without spaces, first four characters moved to the end, letters as 10 to 35:
    1 modulo 97."""
    v = F.upper(F.regexp_replace(value, r"\s", ""))
    turned = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))
    ok = v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")

    def step(s: Column, c: Column) -> Column:
        n = F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (s * F.when(n > 9, 100).otherwise(10) + n) % 97

    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(step(s, c)))
    return F.coalesce(ok & F.when(ok, rest == 1), F.lit(False))


def ipv4(value: Column) -> Column:
    """Four decimal parts up to 255 without leading zeros."""
    return F.coalesce(value.rlike(r"^(?:(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.(?!$)|$)){4}$"), F.lit(False))


def valid_match(kind: Column, value: Column) -> Column:
    """The check of a detector's type; true for types without one."""
    return F.when(kind == "CARD_NUMBER", luhn(value)).when(kind == "AADHAAR", verhoeff(value)).when(kind == "IBAN", iban(value)).when(kind == "IP_ADDRESS", ipv4(value)).otherwise(True)


def context(text: Column, start: Column, end: Column, radius: int = 80) -> Column:
    """Up to `radius` characters before and after a span, with a space between, lower-cased."""
    before = F.call_function("substring", text, F.greatest(F.lit(1), start - radius + 1), F.least(start, F.lit(radius)))
    after = F.call_function("substring", text, end + 1, F.lit(radius))
    return F.lower(F.concat(before, F.lit(" "), after))


def confidence(kind: Column, around: Column) -> Column:
    """0.5, and 0.25 for strong types, and 0.2 if a context word is near; at most 1."""
    near = around.rlike("|".join(CONTEXT_WORDS))
    score = F.lit(50) + F.when(kind.isin(*STRONG_TYPES), 25).otherwise(0) + F.when(near, 20).otherwise(0)
    return F.least(score, F.lit(100)) / 100


def field_value_passes(kind: Column, value: Column) -> Column:
    """Whether a value has the shape that a field type asks for; null where the type asks none."""
    v = F.coalesce(value, F.lit(""))
    return (
        F.when(kind == "EMAIL", v.contains("@"))
        .when(kind == "PHONE", F.length(digits(v)) >= 7)
        .when(kind == "CARD_NUMBER", v.rlike("[0-9]{4}"))
        .when(kind.isin("DATE_OF_BIRTH", "DATE"), v.rlike(r"[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{2,4}"))
        .when(kind == "IFSC", F.regexp_replace(F.trim(v), r"[.,;:]+$", "").rlike("(?i)^[A-Z]{4}0[A-Z0-9]{6}$"))
        .when(kind == "PASSWORD", v.contains("@") | v.rlike(_MIXED))
    )


def secret_value_passes(kind: Column, value: Column) -> Column:
    """The same for the labels of secrets."""
    v = F.coalesce(value, F.lit(""))
    return (
        F.when(kind == "PASSWORD", v.contains("@") | v.rlike(_MIXED))
        .when(kind == "EMAIL_ID", v.contains("@"))
        .when(kind == "PHONE_NUMBER", F.length(digits(v)) >= 7)
        .when(kind == "CARD_NUMBER", v.rlike("[0-9]{4}"))
        .when(kind == "IFSC_CODE", v.rlike("(?i)^[A-Z]{4}0[A-Z0-9]{6}$"))
    )


def _words(v: Column) -> Column:
    return F.size(F.filter(F.split(v, r"\s+"), lambda w: w != ""))


def plausible_value(value: Column) -> Column:
    """Whether a text may be a field's value: 2 to 80 characters with a letter or digit, at most
    eight words, and neither prose nor a numbered heading."""
    v = F.trim(F.coalesce(value, F.lit("")))
    bare = F.regexp_replace(v, r"(?i)^\s*[0-9]+[a-z]?[.)]\s*", "")
    prose = (_words(bare) > 4) & bare.rlike(r"(?i)^[a-z\s.,?()'\"]+$") & ~bare.rlike(r"[0-9\-_/]")
    heading = v.rlike(r"(?i)^\s*[0-9]+[a-z]?[.)]\s+") & (F.trim(bare) != "") & ~bare.rlike("[0-9@]") & F.trim(bare).rlike(r"(?i)^[a-z\s.,'()/\-]+$")
    return F.length(v).between(2, 80) & v.rlike("(?i)[a-z0-9]") & (F.size(F.split(v, r"\s+")) <= 8) & ~prose & ~heading


def plausible_value_dom(value: Column) -> Column:
    """The same for page text, where ordinals do not matter."""
    v = F.trim(F.coalesce(value, F.lit("")))
    prose = (_words(v) > 4) & v.rlike(r"(?i)^[a-z\s.,?()'\"]+$") & ~v.rlike(r"[0-9@/_-]")
    return F.length(v).between(2, 80) & v.rlike("(?i)[a-z0-9]") & (_words(v) <= 8) & ~prose


def example_email(value: Column) -> Column:
    """An address whose domain is exactly an example domain."""
    v = F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))
    return F.coalesce(F.regexp_extract(v, r"^[^\s@]+@([a-z0-9.-]+\.[a-z]{2,})$", 1).isin(*EXAMPLE_DOMAINS), F.lit(False))


def placeholder_text(value: Column) -> Column:
    """Empty, a usual placeholder, or an example address."""
    v = F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")))
    return (v == "") | v.isin(*PLACEHOLDERS) | example_email(value)
