"""SimHash near-duplicates, candidates pruned by the pigeonring principle.

A 64-bit fingerprint is cut into m = radius + 2 ring segments. If two fingerprints differ in at
most `radius` bits, then two segments at least agree, and by the (strong) pigeonring principle
some segment starts a chain all of whose prefixes of length l differ in at most l * radius / m
bits. So fingerprints meet in the buckets of every two agreeing segments, a pair must show such a
chain, and only then the full Hamming distance is taken.

Distinct fingerprints only take part, whatever the number of copies. A bucket of more than
HOT_BUCKET distinct fingerprints is not paired up: its members are joined to the smallest
fingerprint with which they share a one-flip neighbour. For radius 2 two fingerprints share such
a neighbour exactly if they differ in at most two bits, so the components are the same, and a
bucket costs 33 rows a member instead of the square of its size.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, discard, free_name, join_one, map_struct, map_text, materialise, spread

HOT_BUCKET = 24


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    elif shingle == 1:
        grams = words
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, seed) for g in grams], dtype="<u8")
    n = len(hashes)
    ones = np.zeros(64, dtype=np.int64)
    for begin in range(0, n, 255 * 64):  # byte lanes of a 64-bit word hold up to 255
        lanes = np.unpackbits(hashes[begin : begin + 255 * 64].view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        for at in range(0, len(lanes), 255):
            ones += lanes[at : at + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = 3) -> DataFrame:
    """docs with a long column: null and empty texts have fingerprint 0."""

    def make():
        return lambda texts: [[fingerprint(t, shingle) for t in texts]]

    return map_text(docs, text, [T.StructField(name, T.LongType())], make)


def _cuts(m: int) -> list[tuple[int, int]]:
    """(first bit, width) of m segments of 64 bits."""
    at = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def _segment(fp: Column, cut: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, cut[0]).bitwiseAND(F.lit((1 << cut[1]) - 1))


def ring_chain(x: Column, radius: int, m: int) -> Column:
    """Whether the differing bits x have a segment all of whose chains keep to their budgets."""
    parts = [F.bit_count(_segment(x, c)) for c in _cuts(m)]
    starts = []
    for i in range(m):
        total, fits = None, None
        for length in range(1, m + 1):
            part = parts[(i + length - 1) % m]
            total = part if total is None else total + part
            ok = total <= length * radius // m
            fits = ok if fits is None else fits & ok
        starts.append(fits)
    found = starts[0]
    for s in starts[1:]:
        found = found | s
    return found


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (seed, a, b) between distinct fingerprints (columns seed and fp) of one seed that keep
    the components of "differ in at most `radius` bits". Every edge is such a pair; not every such
    pair is an edge."""
    m = radius + 2
    cuts = _cuts(m)
    agree = 2
    pairs = list(combinations(range(m), agree))
    keys = [F.struct(F.lit(k).cast("short").alias("t"), F.shiftleft(_segment(F.col("fp"), cuts[i]), cuts[j][1]).bitwiseOR(_segment(F.col("fp"), cuts[j])).alias("v")) for k, (i, j) in enumerate(pairs)]
    rows = fps.select("seed", "fp", F.explode(F.array(*keys)).alias("key")).select("seed", "fp", "key.t", "key.v")
    sizes = rows.groupBy("seed", "t", "v").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(rows.join(sizes, ["seed", "t", "v"]), "buckets")
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    cold = met.where(F.col("n") <= HOT_BUCKET)
    # an ordered pair once, in the first bucket that has it
    owner = F.coalesce(*[F.when((_segment(x, cuts[i]) == 0) & (_segment(x, cuts[j]) == 0), F.lit(k)) for k, (i, j) in enumerate(pairs)])
    near = (
        cold.alias("l")
        .join(cold.alias("r"), (F.col("l.seed") == F.col("r.seed")) & (F.col("l.t") == F.col("r.t")) & (F.col("l.v") == F.col("r.v")) & (F.col("l.fp") > F.col("r.fp")) & (owner == F.col("l.t")) & ring_chain(x, radius, m) & (F.bit_count(x) <= radius))
        .select("l.seed", F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    )
    return near.union(_hot_links(met.where(F.col("n") > HOT_BUCKET), radius))


def _hot_links(met: DataFrame, radius: int) -> DataFrame:
    """Stars around one-flip neighbours that fingerprints of large buckets share."""
    if radius > 2:
        raise ValueError("large buckets are linked for a radius of 1 or 2 only")
    fps = met.select("seed", "fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    near = fps.select("seed", "fp", F.explode(flips).alias("flip")).select("seed", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    if radius == 2:
        first = near.groupBy("seed", "at").agg(F.min("fp").alias("first"), F.max("fp").alias("last")).where("first <> last")
        return near.join(first, ["seed", "at"]).where("fp <> first").select("seed", F.col("fp").alias("a"), F.col("first").alias("b"))
    # radius 1: a fingerprint's neighbour is itself a fingerprint
    return near.join(fps.select("seed", F.col("fp").alias("at")), ["seed", "at"]).where("fp <> at").select("seed", F.col("fp").alias("a"), F.col("at").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest id reachable over links of at most `radius` differing bits, the
    row's own included. Null texts count as empty (fingerprint 0); repeated rows stay; null ids
    are ignored as names of a component, which is null if no other id is there. An empty table
    gives an empty result. Other columns of docs are not looked at.
    """
    marked = with_fingerprint(spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))), "text", "fp", shingle)
    return linked_groups(materialise(marked.select("doc_id", "fp"), "fingerprints"), radius)


def linked_groups(marked: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of a table (doc_id, fp), which is read more than once."""
    firsts = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "classes")
    parts = materialise(components(links(firsts.select(F.lit(0).alias("seed"), "fp"), radius).select("a", "b")), "components")
    named = parts.join(firsts, parts.node == firsts.fp).select("node", "component", "first")
    named = named.join(named.groupBy("component").agg(F.min("first").alias("component_id")), "component").select(F.col("node").alias("fp"), "component_id")
    of = firsts.join(named, "fp", "left").select("fp", "copies", F.coalesce("component_id", "first").alias("component_id"))
    return join_one(marked, materialise(of, "of"), ["fp"], "copies").select("doc_id", "fp", "component_id")


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of shingle_set(), in order of hash."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w, 42) for w in words], dtype=np.uint64)
    n = max(1, len(h) - shingle + 1)
    out = np.full(n, len(words) if n == 1 else shingle, dtype=np.uint64)
    for i in range(min(shingle, len(h))):
        out = (out ^ h[i : i + n]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0x94D049BB133111EB))


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first hashes of a text in the order (how common, hash): so many that two texts of
    `similarity` have one of them in common. common: hashes, sorted, and their counts."""
    if not len(hashes):
        return np.zeros(1, dtype=np.uint64)  # texts without words are all alike
    rank = np.zeros(len(hashes), dtype=np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
        rank = np.where(common[0][at] == hashes, common[1][at], 0)
    most = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    return hashes[np.argsort(rank, kind="stable")[:most]]


def shingle_set(text: str | None, shingle: int = 5) -> set[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


#: For one_of_each_group(): texts that share a shingle of their prefixes are all compared if they
#: are so few; of more, HEADS of them, the first among them, are compared with all. Both are four
#: times as many in each further round: first groups of copies shrink, then the rest is compared.
FEW, HEADS = 16, 4
#: Pairs of one text that go to one task.
SALT_PAIRS = 500
#: How common a shingle is, is counted on one text in SAMPLE, for COMMON shingles at most that
#: three texts of the sample have. It decides the order of prefixes: on speed, not on results.
SAMPLE, COMMON = 8, 1 << 18


def _common_shingles(keyed: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the commonest shingles of a sample, in order of hash."""

    def make():
        return lambda texts: [[shingle_hashes(t, shingle).view(np.int64) for t in texts]]

    some = map_text(keyed.where(F.pmod("k", F.lit(SAMPLE)) == 0), "text", [T.StructField("hashes", T.ArrayType(T.LongType()))], make)
    counts = some.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    rows = counts.orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    h, n = rows.h.to_numpy(np.int64).view(np.uint64), rows.n.to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _likeness(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """pairs (a, b) of names (c) of texts, with their likeness. A text with many pairs is given
    to as many tasks as it takes: SALT_PAIRS pairs each."""

    def compare():
        last: list = [None, None]

        def work(both):
            out = []
            for pair in both:
                if last[0] != pair["kept"]:
                    last[:] = [pair["kept"], shingle_set(pair["kept"], shingle)]
                out.append(jaccard(last[1], shingle_set(pair["text"], shingle)))
            return [out]

        return work

    of_a = materialise(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / SALT_PAIRS).cast("int")), "pair-counts")
    salted = join_one(pairs, of_a, ["a"], "n").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    kept = texts.join(of_a.select(F.col("a").alias("c"), "salts"), "c").select(F.col("c").alias("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("kept"))
    both = salted.join(texts.select(F.col("c").alias("b"), "text"), "b").join(kept, ["a", "salt"])
    return map_struct(both.select("a", "b", F.struct("text", "kept").alias("pair")), "pair", [T.StructField("likeness", T.DoubleType())], compare).drop("pair")


def _decided(posts: DataFrame, linked: DataFrame, fetch, similarity: float, shingle: int) -> DataFrame:
    """The names (c) of texts that go. posts: a row (c, n, pos, token) for each shingle of a text's
    prefix; names are numbers in the order of who stays, n is the text's number of shingles. linked:
    pairs (a, b) of names, a < b, that are compared before all others. fetch gives (c, text) for a
    table of names."""
    gone = posts.select("c").limit(0)
    similar = compared = texts = None
    few, heads = FEW, HEADS
    while True:
        before = materialise(posts, "posts")
        sizes = materialise(before.groupBy("token").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        posts = materialise(join_one(before, sizes, ["token"], "size"), "posts")
        discard(before)
        discard(sizes)
        if posts.isEmpty():
            return gone
        if texts is None:
            some = materialise(posts.select("c").distinct(), "some")
            texts = materialise(fetch(some), "texts")
            # a text that shares no shingle of its prefix is like no other
            linked = linked.join(some.withColumnRenamed("c", "a"), "a", "left_semi").join(some.withColumnRenamed("c", "b"), "b", "left_semi")
            judged = materialise(_likeness(materialise(linked.select("a", "b"), "linked"), texts, shingle), "judged")
            compared, similar = judged.select("a", "b"), judged.where(F.col("likeness") >= similarity).select("a", "b")
        # of a large group the least name of each of `heads` parts: a partial aggregation
        large = posts.where(F.col("size") > few)
        tops = large.groupBy("token", "size", F.pmod(F.xxhash64("c"), F.lit(heads)).alias("part")).agg(F.min(F.struct("c", "n", "pos")).alias("t"))
        tops = materialise(tops.select("token", "size", F.col("t.c").alias("tc"), F.col("t.n").alias("tn"), F.col("t.pos").alias("tpos")), "heads")
        alike = lambda n, pos, m, at: F.least(n - pos, m - at) * (1 + similarity) >= (n + m) * similarity - 1e-6  # noqa: E731  what two prefixes can share from here on bounds the likeness
        small = posts.where(F.col("size") <= few)
        left, right = small.alias("l"), small.alias("r")
        pairs = left.join(right, (F.col("l.token") == F.col("r.token")) & (F.col("l.c") < F.col("r.c")) & alike(F.col("l.n"), F.col("l.pos"), F.col("r.n"), F.col("r.pos"))).select(F.col("l.c").alias("a"), F.col("r.c").alias("b"))
        headed = join_one(large.drop("size"), tops, ["token"], "size", several=True).where((F.col("c") != F.col("tc")) & alike(F.col("n"), F.col("pos"), F.col("tn"), F.col("tpos")))
        pairs = pairs.union(headed.select(F.least("c", "tc"), F.greatest("c", "tc"))).distinct()
        pairs = pairs.join(compared, ["a", "b"], "left_anti")
        judged = materialise(_likeness(materialise(pairs, "pairs"), texts, shingle), "judged")
        compared = compared.union(judged.select("a", "b"))
        now = judged.where(F.col("likeness") >= similarity).select("a", "b")
        # only a text that was compared with all others of its shingles can be said to stay
        first = tops.groupBy(F.col("tc").alias("c")).agg(F.count("*").alias("m"))
        ready = posts.groupBy("c").agg(F.count_if(F.col("size") > few).alias("k")).join(first, "c", "left")
        ready = materialise(ready.select("c", (F.col("k") == F.coalesce("m", F.lit(0))).alias("ready")), "ready")
        similar = similar.drop("ready").union(now).join(ready.select(F.col("c").alias("a"), "ready"), "a")
        similar = materialise(similar, "similar")
        left_now = posts.select("c").limit(0)
        while True:
            stay = similar.where("ready").join(similar.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
            found = materialise(stay.select(F.col("b").alias("c")).distinct(), "gone")
            if found.isEmpty():
                break
            gone, left_now = gone.union(found), left_now.union(found)
            similar = materialise(similar.join(found, similar.a == found.c, "left_anti").join(found, F.col("b") == found.c, "left_anti"), "similar")
        open_ = similar.select(F.col("b").alias("c")).distinct()
        done = ready.where("ready").select("c").join(open_, "c", "left_anti").union(left_now)
        posts = posts.join(materialise(done, "done"), "c", "left_anti").drop("size")
        few, heads = 4 * few, 4 * heads


def one_of_each_group(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """docs (with doc_id and text) less near copies: texts of a Jaccard similarity of `similarity`
    or more over `shingle`-word shingles.

    The groups of near_duplicates() (SimHash, pigeonring) come first: each text of a group is
    compared with the group's first. Fingerprints lose pairs, so an exact check follows, a prefix
    filter: with all shingles in one order (rare ones first), texts of n shingles that are so similar
    have one in common among their first n - ceil(similarity * n) + 1. All candidates are compared,
    in the order of ids: a text stays if none before it that stays is as similar to it, and goes
    otherwise. So nothing goes that was not compared with a text that stays, and no two texts that
    stay are so similar. A shingle that many prefixes have is taken in rounds: some of its texts are
    compared with all the others, those decided leave, until none is left.

    Of equal texts (null counts as empty) the smallest id stays; null ids stay only where a text
    has no other; rows equal in id and text count once. Other columns stay. An empty table stays
    empty.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    keyed = spread(docs.select("doc_id", whole.alias("text"))).select("doc_id", "text", F.xxhash64("text").alias("k"), F.xxhash64("text", F.lit(1)).alias("l"))

    common = _common_shingles(keyed, shingle)

    def make():
        def work(texts):
            all_of = [shingle_hashes(t, shingle) for t in texts]
            return [[len(h) for h in all_of], [prefix(h, common, similarity).view(np.int64) for h in all_of], [fingerprint(t) for t in texts]]

        return work

    marked = map_text(keyed, "text", [T.StructField("n", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())], make).drop("text")
    # copies on the way to one task are added up first
    classes = marked.groupBy("k", "l").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("fp").alias("fp"), F.count("*").alias("copies"))
    classes = materialise(classes, "classes")
    # numbers in the order of ids, as names that are short and sort alike
    order = [F.col("first").isNull(), F.col("first"), F.col("k"), F.col("l")]
    names = materialise(classes.select("k", "l", "first", "copies", "fp").orderBy(*order).withColumn("c", F.monotonically_increasing_id()), "names")
    posts = classes.join(names.select("k", "l", "c"), ["k", "l"]).select("c", "n", F.posexplode("tokens").alias("pos", "token"))

    def fetch(wanted: DataFrame) -> DataFrame:
        some = materialise(names.join(wanted, "c", "left_semi"), "wanted")
        found = join_one(keyed, some, ["k", "l"], "copies").where(F.col("doc_id").eqNullSafe(F.col("first")))
        return found.select("c", "text")

    groups = linked_groups(names.select(F.col("c").alias("doc_id"), "fp"))
    linked = groups.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).where("a < b")
    gone = _decided(posts, linked, fetch, similarity, shingle)
    own = [free_name(docs, n) for n in ("veil_k", "veil_l", "veil_first", "veil_copies")]
    stays = names.join(gone, "c", "left_anti").select(*[F.col(x).alias(y) for x, y in zip(("k", "l", "first", "copies"), own, strict=True)])
    out = docs.select(*docs.columns, F.xxhash64(whole).alias(own[0]), F.xxhash64(whole, F.lit(1)).alias(own[1]))
    out = join_one(out, materialise(stays, "stays"), own[:2], own[3]).where(F.col("doc_id").eqNullSafe(F.col(own[2])))
    if not keyed.groupBy("doc_id", "k", "l").count().where("count > 1").isEmpty():  # rows equal in id and text
        out = out.dropDuplicates(["doc_id", *own[:2]])
    return out.select(docs.columns)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
