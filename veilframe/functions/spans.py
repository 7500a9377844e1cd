"""Spans of pattern matches, overlaps and redaction, as column expressions.

A span is struct<start, end, rank, type, value, confidence, source>: code point offsets from 0, end
exclusive; rank is the detector's place in its catalogue and breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import Pattern
from .validators import confidence, context, valid_match

SPAN = "struct<start:int,end:int,rank:int,type:string,value:string,confidence:double,source:string>"
SPANS = f"array<{SPAN}>"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: a generator of one row keeps the optimiser from
    copying a large expression into every filter and projection above it."""
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def kept(df: DataFrame) -> DataFrame:
    """df computed once for several uses: a checkpoint where the session has a folder for them, else
    persisted (and computed anew where an executor that holds a part is lost)."""
    sc = df.sparkSession.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
        return df.checkpoint()
    return df.persist()


def none() -> Column:
    return F.array().cast(SPANS)


def located(text: Column, pattern: Pattern, rank: int, source: str = "tier0") -> Column:
    """Spans of all matches of a pattern, not yet checked or scored.

    The pieces between matches and the matches' lengths give the offsets. For a pattern with a
    group the span is that of the group's text, the last such text in the match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(0))
    pieces = F.split(text, pattern.regex, -1)
    values = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(pattern.group)) if pattern.group else found
    rows = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("match"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), none().alias("spans"))

    def add(s: Column, r: Column) -> Column:
        begin = s.at + F.length(r.piece)
        after = begin + F.length(r.match)
        first = after - F.length(r.value) if pattern.group else begin
        span = F.struct(first.alias("start"), (first + F.length(r.value)).alias("end"), F.lit(rank).alias("rank"), F.lit(pattern.type).alias("type"), r.value.alias("value"), F.lit(pattern.confidence).alias("confidence"), F.lit(source).alias("source"))
        return F.struct(after.alias("at"), F.concat(s.spans, F.array(span)).alias("spans"))

    return F.aggregate(rows, start, add, lambda s: s.spans)


def _may(text: Column, pattern: Pattern) -> Column:
    may = text.rlike(pattern.quick)
    return F.lower(text).contains(pattern.hint) & may if pattern.hint else may


def matches(text: Column, patterns: list[tuple[Pattern, int]], source: str = "tier0", check: bool = True) -> Column:
    """Checked (by the types' own checks, unless told not to) and scored spans of patterns with their ranks, in the patterns' order; none for
    null texts. Texts without a pattern's hint or any match are left after one scan; one check and
    one score expression serve all patterns."""
    found = [F.when(_may(text, p), located(text, p, rank, source)).otherwise(none()) for p, rank in patterns]
    ok = F.concat(*found) if len(found) > 1 else found[0]
    if check:
        ok = F.filter(ok, lambda s: valid_match(s.type, s.value))
    score = lambda s: F.when(s.confidence > 0, s.confidence).otherwise(confidence(s.type, context(text, s.start, s.end)))
    return F.transform(ok, lambda s: s.withField("confidence", score(s)))


def count(text: Column, pattern: Pattern) -> Column:
    """How many checked matches a text has."""
    found = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(pattern.group))
    n = F.size(F.filter(found, lambda v: valid_match(F.lit(pattern.type), v))).cast("long")
    return F.when(_may(text, pattern), n).otherwise(F.lit(0).cast("long"))


def overlap(a: Column, b: Column) -> Column:
    return (a.start < b.end) & (b.start < a.end)


def resolve_leftmost(spans: Column) -> Column:
    """Greedy choice of disjoint spans: by start, then longer, then rank. A span stays if it starts
    at or after the end of the last one that stayed."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("a"), (-(s.end - s.start)).alias("b"), s.rank.alias("c"), s.alias("s"))))
    start = F.struct(F.lit(0).alias("at"), none().alias("kept"))
    step = lambda k, x: F.when(x.s.start >= k.at, F.struct(x.s.end.alias("at"), F.concat(k.kept, F.array(x.s)).alias("kept"))).otherwise(k)
    return F.aggregate(order, start, step, lambda k: k.kept)


def resolve_longest(spans: Column) -> Column:
    """Greedy choice of disjoint spans: longer first, then higher confidence, then rank."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct((-(s.end - s.start)).alias("a"), (-s.confidence).alias("b"), s.rank.alias("c"), s.start.alias("d"), s.alias("s"))))
    step = lambda kept, x: F.when(F.exists(kept, lambda k: overlap(k, x.s)), kept).otherwise(F.concat(kept, F.array(x.s)))
    return F.array_sort(F.aggregate(order, none(), step))


def merge_free(spans: Column, extra: Column) -> Column:
    """spans and those of extra that overlap none of them (nor an earlier one of extra)."""
    return F.aggregate(extra, spans, lambda kept, x: F.when(F.exists(kept, lambda k: overlap(k, x)), kept).otherwise(F.concat(kept, F.array(x))))


HOLE = r"<[A-Z0-9_]+>"


def without_holes(text: Column, spans: Column) -> Column:
    """spans that touch no placeholder (<TYPE>) of the text."""
    holes = located(text, Pattern("F1", "HOLE", HOLE, HOLE), 0)
    return F.filter(spans, lambda s: ~F.exists(holes, lambda h: overlap(s, h)))


def redact(text: Column, spans: Column) -> Column:
    """The text with each of the disjoint spans replaced by <TYPE>; null stays null."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    put = lambda s, x: F.struct(x.end.alias("at"), F.concat(s.out, F.call_function("substring", text, s.at + 1, x.start - s.at), F.lit("<"), x.type, F.lit(">")).alias("out"))
    done = F.aggregate(F.array_sort(spans), start, put, lambda s: F.concat(s.out, F.call_function("substring", text, s.at + 1)))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def listed(spans: Column) -> Column:
    """"TYPE@start-end" of each span in order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(s.type, F.lit("@"), s.start.cast("string"), F.lit("-"), s.end.cast("string"))), ",")
