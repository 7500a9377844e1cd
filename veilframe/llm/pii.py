"""PII: pattern spans and terms that disclose them. DataFrame operations only.

Base spans are matches of fixed patterns with checks of their digits. Beside them, information
theory finds terms that reveal protected entities. An entity is what a base span stands for, at
four levels: any personal data, its kind, its part (the address's domain, the network, the card's
issuer, the phone's country and area), and its value. Over the whole corpus, n(e) documents hold
entity e, n(t) hold term t anywhere in their text, and n(e, t) hold both, out of N. With the
information content IC(e) = log2(N / n(e)) and, smoothed, PMI(e; t) = log2(P(e | t) N / n(e)),
P(e | t) = n(e, t) / (n(t) + SMOOTHING), a term discloses the share PMI / IC of what there is to know
about e. A pair that fewer than SUPPORT different texts have is no estimate. Terms whose share
exceeds GENERALISE for any entity are spans, too, wherever they stand; sanitising replaces them by a
general class, and removes them where the share exceeds REMOVE.

Documents count as often as they occur, for support equal texts count once.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, join_one, materialise, table

# The base patterns, each written so that a failing start is left at once (possessive
# loops; a start inside a run only where the last match ended) and long runs take no stack. Cards
# of fewer than 12 or more than 19 digits fail their check anyway, so the pattern skips them.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"

SUPPORT, SMOOTHING, GENERALISE, REMOVE = 3, 1, 0.85, 0.95
#: Up to so many disclosing terms are looked up in a set within the expression, without a join.
SET_TERMS = 10_000
#: Terms are lower-cased runs of letters or digits outside addresses, and not of ASCII digits only.
_GAP = r"[^\p{L}\p{N}]+"

_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike(_BYTE))
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _valid(kind: str, span: Column) -> Column:
    return _passes(kind, span.value)


def _located(text: Column, pattern: Column, kind: Column, rank: int) -> Column:
    """Spans of all matches: their lengths and those of the pieces between give the offsets."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.call_function("split", text, pattern, F.lit(-1))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_SPANS).alias("spans"))

    def add(state: Column, pair: Column) -> Column:
        begin = state.at + F.length(pair.piece)
        end = begin + F.length(pair.match)
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), kind.alias("kind"), end.alias("end"), pair.match.alias("value"))
        return F.struct(end.alias("at"), F.concat(F.coalesce(state.spans, F.array().cast(_SPANS)), F.array(span)).alias("spans"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    return F.coalesce(F.aggregate(pairs, start, add, lambda s: s.spans), F.array().cast(_SPANS))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind in a text (null: none); offsets in code points, from 0, end exclusive."""
    out = {}
    for rank, kind in enumerate(KINDS):
        pattern = F.lit(PATTERNS[kind])
        may = text.contains("@") if kind == "email" else text.contains("+") & text.rlike(PATTERNS[kind]) if kind == "phone" else text.rlike(PATTERNS[kind])
        spans = F.filter(_located(text, pattern, F.lit(kind), rank), partial(_valid, kind))
        out[kind] = F.when(may, spans).otherwise(F.array().cast(_SPANS))
    return out


def _entities(span: Column) -> Column:
    """The entities that a span stands for, as an array of names, from "any" to its value."""
    digits = _digits(span.value)
    value = F.when(span.kind.isin("card", "phone"), digits).otherwise(F.lower(span.value))
    part = F.when(span.kind == "email", F.substring_index(value, "@", -1)).when(span.kind == "ip", F.substring_index(value, ".", 2)).when(span.kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    return F.array(F.lit("any"), span.kind, F.concat(span.kind, F.lit(":"), part), F.concat(span.kind, F.lit("="), value))


def _terms(text: Column) -> Column:
    plain = F.when(text.contains("@"), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.filter(F.split(F.lower(plain), _GAP), lambda t: F.translate(t, "0123456789", "") != ""))


def _key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(text, F.lit(1)).alias("y"))


def disclosing_terms(docs: DataFrame, support: int = SUPPORT, share: float = GENERALISE) -> DataFrame:
    """(term, share): terms that disclose an entity, with the largest share."""
    texts = docs.where("text is not null and text <> ''").select("text")
    found = texts.select("text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    found = found.select("text", F.concat(*KINDS).alias("spans")).where(F.size("spans") > 0)
    found = found.select(_key(F.col("text")).alias("key"), F.array_distinct(F.flatten(F.transform("spans", _entities))).alias("entities"), _terms(F.col("text")).alias("terms"))
    near = found.groupBy("key").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"), F.count("*").alias("copies"))
    near = materialise(near, "contexts")
    total = float(texts.count())
    told_by = lambda n_et, n_t, n_e: F.log2(n_et * total / ((n_t + SMOOTHING) * n_e)) / F.log2(total / n_e)
    if total <= support:
        return near.select(F.lit("").alias("term"), F.lit(0.0).alias("share")).limit(0)
    # share > s means P(e | t) > (n(e) / N) ** (1 - s), and "any" holds every entity's documents
    bound = (support / total) ** (1 - share)
    n_t = texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    with_any = near.select("copies", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("copies").alias("n_any"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    able = with_any.join(n_t, "term").where(F.col("n_any") > (F.col("n_t") + SMOOTHING) * bound)
    able = materialise(able.select("term", "n_t", "texts"), "able")
    pairs = join_one(near.select("copies", "entities", F.explode("terms").alias("term")), able, ["term"], "texts").select("copies", "term", "n_t", F.explode("entities").alias("entity"))
    pairs = pairs.groupBy("entity", "term", "n_t").agg(F.sum("copies").alias("n_et"), F.count("*").alias("texts")).where(F.col("texts") >= support).drop("texts")
    pairs = materialise(pairs, "pairs")
    n_e = near.select("copies", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("copies").alias("n_e"))
    n_e = materialise(n_e.join(pairs.groupBy("entity").agg(F.count("*").alias("n")), "entity").where(F.col("n_e") < total), "entities")
    told = join_one(pairs, n_e, ["entity"], "n").withColumn("share", told_by(F.col("n_et"), F.col("n_t"), F.col("n_e")))
    told = materialise(told.groupBy("term").agg(F.max("share").alias("share")).where(F.col("share") > share), "told")
    for done in (near, able, pairs, n_e):
        discard(done)
    return told


def _with_terms(docs: DataFrame, told: DataFrame, name: str) -> DataFrame:
    """docs with the disclosing terms of its text: an array of (term, removed)."""
    made = lambda t, removed: F.struct(t.alias("term"), removed.alias("removed"))
    if told.limit(SET_TERMS + 1).count() <= SET_TERMS:
        rows = told.collect()
        all_of, gone = [r.term for r in rows], [r.term for r in rows if r.share > REMOVE]
        hits = F.transform(F.filter(_terms(F.col("text")), lambda t: t.isin(all_of)), lambda t: made(t, t.isin(gone)))
        return docs.withColumn(name, F.coalesce(hits, F.from_json(F.lit("[]"), "array<struct<term:string,removed:boolean>>")))
    x, y, n = (free_name(docs, c) for c in ("veil_x", "veil_y", "veil_n"))
    one = docs.where("text is not null").select(F.xxhash64("text").alias(x), F.xxhash64("text", F.lit(1)).alias(y), F.explode(_terms(F.col("text"))).alias("term"))
    counts = one.join(told.select("term"), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    hits = join_one(one, materialise(told.join(counts, "term"), "told"), ["term"], "n").groupBy(x, y, "term", "share").agg(F.count("*").alias(n))
    of = hits.groupBy(x, y).agg(F.max(n).alias(n), F.array_sort(F.collect_list(made(F.col("term"), F.col("share") > REMOVE))).alias(name))
    keyed = docs.select(*docs.columns, F.xxhash64("text").alias(x), F.xxhash64("text", F.lit(1)).alias(y))
    return join_one(keyed, materialise(of, "stands"), [x, y], n, "left").select(*docs.columns, F.coalesce(name, F.from_json(F.lit("[]"), "array<struct<term:string,removed:boolean>>")).alias(name))


def find(docs: DataFrame, support: int = SUPPORT, share: float = GENERALISE) -> DataFrame:
    """docs (with a column text) with email, ip, card, phone and term (arrays of spans) appended.

    Null and empty texts have no spans. A disclosing term's span is a whole word, wherever it
    stands in any text but inside a base span, of the kind "term", or "removed" where it discloses
    all but all. Equal texts have equal spans; repeated rows stay; an empty table stays empty. Other
    columns stay, but for those named like an output, which are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in (*KINDS, "term")]
    hits = free_name(docs, "veil_terms")
    found = _with_terms(docs.select(*kept), disclosing_terms(docs.select("text"), support, share), hits)
    found = found.select(*kept, hits, *[F.coalesce(c, F.array().cast(_SPANS)).alias(k) for k, c in base_spans(F.col("text")).items()])
    whole = lambda t: F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])\Q"), t, F.lit(r"\E(?![\p{L}\p{N}])"))  # noqa: E731  a term has letters and digits only
    kind = lambda t: F.when(t.removed, F.lit("removed")).otherwise(F.lit("term"))
    terms = F.flatten(F.transform(hits, lambda t: _located(F.col("text"), whole(t.term), kind(t), len(KINDS))))
    base = F.concat(*KINDS)
    free = F.filter(terms, lambda s: ~F.exists(base, lambda b: (s.start < b.end) & (b.start < s.end)))
    return found.select(*kept, *KINDS, F.when(F.size(hits) == 0, F.array().cast(_SPANS)).otherwise(F.array_sort(free)).alias("term"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def sanitised(text: Column) -> Column:
    """The text beside the columns of find(): base spans become <EMAIL>, <IP>, <CARD> or <PHONE>,
    disclosing terms <TERM>, or nothing where they are to be removed. Of base spans that overlap,
    the first one counts and the others' rest stays covered by it up to the farther end. Null stays
    null."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(state: Column, s: Column) -> Column:
        name = F.when(s.kind == "removed", "").otherwise(F.concat(F.lit("<"), F.upper(s.kind), F.lit(">")))
        between = F.call_function("substring", text, state.at + 1, F.greatest(F.lit(0), s.start - state.at))
        inside = s.start < state.at
        return F.struct(F.greatest(state.at, s.end).alias("at"), F.when(inside, state.out).otherwise(F.concat(state.out, between, name)).alias("out"))

    out = F.aggregate(F.array_sort(F.concat(*KINDS, "term")), start, put, lambda s: F.concat(s.out, F.call_function("substring", text, s.at + 1)))
    return F.when(text.isNotNull(), out)


def sanitise(docs: DataFrame, support: int = SUPPORT, share: float = GENERALISE) -> DataFrame:
    """docs with its text sanitised() by what find() finds. All other columns stay."""
    kept = docs.columns
    renamed = {c: free_name(docs, f"veil_kept_{c}") for c in kept if c.lower() in (*KINDS, "term")}
    found = find(docs.withColumnsRenamed(renamed), support, share)
    return found.select(*[sanitised(F.col("text")).alias("text") if c == "text" else F.col(renamed.get(c, c)).alias(c) for c in kept])


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document, the disclosing terms' among them, how many
    terms are generalised and removed, and the digest of the sanitised text (null counts as empty)."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*KINDS)
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.concat(base, "term")).alias("spans"),
        F.size(F.filter("term", lambda s: s.kind == "term")).cast("long").alias("n_generalised"),
        F.size(F.filter("term", lambda s: s.kind == "removed")).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(sanitised(F.col("text")), F.lit("")), 256).alias("sanitised_sha256"),
    )
