import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.llm import simhash as S
from veilframe.llm.common import components


def plain_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    counts = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(grams))


def plain_components(fps, radius):
    left, out = set(fps), {}
    while left:
        root = min(left)
        todo, group = [root], {root}
        left.discard(root)
        while todo:
            x = todo.pop()
            near = {y for y in left if bin((x ^ y) & (2**64 - 1)).count("1") <= radius}
            left -= near
            group |= near
            todo += near
        for x in group:
            out[x] = min(group)
    return out


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aB c\t\n\u00a0\u00e9", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def test_fingerprint_of_long_text():
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(40000))
    assert S.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_links_keep_components_in_small_and_large_buckets(spark):
    rng = random.Random(5)
    fps = set()
    for size in (3, 8, 120):  # the last makes buckets beyond HOT_BUCKET
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
            fps.add(signed(x))
    fps |= {signed(rng.getrandbits(64)) for _ in range(200)}
    df = spark.createDataFrame([(0, x) for x in fps], "seed int, fp long")
    edges = S.links(df, 2).select("a", "b")
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 2 for r in edges.collect())
    got = {r.node: r.component for r in components(edges).collect()}
    want = plain_components(fps, 2)
    sizes = {x: sum(c == want[x] for c in want.values()) for x in fps}
    assert {x: got[x] for x in got} == {x: want[x] for x in fps if sizes[x] > 1}


def test_ring_chain_never_loses_a_pair(spark):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        x = 0
        for b in rng.sample(range(64), k % 3):
            x ^= 1 << b
        rows.append((signed(x),))
    df = spark.createDataFrame(rows, "x long")
    assert df.where(~S.ring_chain(F.col("x"), 2, 4)).count() == 0


def test_query_result_and_odd_rows(spark, docs):
    table = docs((5, "A b c d"), (3, "a  B c\td"), (9, None), (7, ""), (None, ""), (4, "other text that is long enough"), (4, "other text that is long enough"))
    rows = sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in S.near_duplicates(table.withColumn("fp", F.lit("x"))).collect())
    assert [r[0] for r in rows] == ["3", "4", "4", "5", "7", "9", "None"]
    by = {r[0]: r for r in rows}
    assert by["3"][2] == by["5"][2] == "3" and by["7"][2] == by["9"][2] == by["None"][2] == "7" and by["7"][1] == 0
    assert S.near_duplicates(table.limit(0)).count() == 0


def test_one_of_each_group(spark, docs):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefghij" for b in range(60)]
    base = [rng.choice(words) for _ in range(300)]
    near = list(base)
    near[100] = "changed"
    other = [rng.choice(words) for _ in range(300)]
    half = base[:150] + other[150:]
    table = docs((10, " ".join(base)), (11, " ".join(near)), (12, " ".join(base)), (13, " ".join(other)), (14, " ".join(half)), (15, None), (16, ""), (13, " ".join(other)), (None, "alone with no id"))
    kept = S.one_of_each_group(table)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["10", "13", "14", "15", "None"]
    assert S.one_of_each_group(table.limit(0)).count() == 0


def test_no_near_copies_by_added_passages_stay(spark, docs):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "abcdefghij" for b in range(300)]
    texts = []
    for i in range(30):
        base = [rng.choice(words) for _ in range(200)]
        more = [rng.choice(words) for _ in range(20 + i)]
        at = rng.randint(0, 200)
        texts += [" ".join(base), " ".join(base[:at] + more + base[at:])]
    sets = [S.shingle_set(t) for t in texts]
    kept = {r.doc_id for r in S.one_of_each_group(docs(*texts)).collect()}
    assert all(S.jaccard(sets[i], sets[j]) < 0.8 for i in kept for j in kept if i < j)
    assert all(any(S.jaccard(sets[i], sets[j]) >= 0.8 for j in kept) for i in range(len(texts)) if i not in kept)


@pytest.mark.parametrize("few, heads", [(16, 4), (2, 1)])
def test_groups_that_share_words_lose_all_near_copies(spark, docs, monkeypatch, few, heads):
    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "HEADS", heads)
    rng = random.Random(12)
    words, texts = [f"w{i}" for i in range(150)], []
    shared = [f"s{i}" for i in range(12)]
    for _ in range(7):  # the same words in other orders
        base = rng.sample(words, len(words)) + shared
        texts += [" ".join(base)] + [" ".join(base[:i] + ["other"] + base[i:]) for i in (10, 60, 110)]
    chain = [f"c{i}" for i in range(120)]  # each near the next only
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 60, 5)]
    sets = [S.shingle_set(t) for t in texts]
    want = []
    for i, x in enumerate(sets):
        if not any(S.jaccard(x, sets[j]) >= 0.8 for j in want):
            want.append(i)
    assert sorted(r.doc_id for r in S.one_of_each_group(docs(*texts)).collect()) == want


def test_fingerprint_groups_are_compared_before_the_exact_check(spark, docs, monkeypatch):
    rng = random.Random(13)
    words, texts = [f"v{i}" for i in range(400)], []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(400)]
        texts += [" ".join(base)] + [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in (100, 200, 300)]
    want = plain_components([plain_fingerprint(t) for t in texts], 2)
    first = {}
    pairs = {(first.setdefault(want[plain_fingerprint(t)], i), i) for i, t in enumerate(texts)}
    seen, likeness = [], S._likeness
    monkeypatch.setattr(S, "_likeness", lambda p, t, n: seen.append({(r.a, r.b) for r in p.collect()}) or likeness(p, t, n))
    monkeypatch.setattr(F, "monotonically_increasing_id", lambda: F.col("first"))  # so that names are ids
    kept = {r.doc_id for r in S.one_of_each_group(docs(*texts)).collect()}
    assert kept == set(range(0, 24, 4))
    assert seen[0] == {(a, b) for a, b in pairs if a < b} and len(seen[0]) > 6
    assert not any(seen[0] & later for later in seen[1:])


def test_prefixes_of_similar_sets_meet():
    rng = random.Random(4)
    none = (S.np.empty(0, dtype=S.np.uint64), S.np.empty(0, dtype=S.np.int64))
    for _ in range(300):
        n = rng.randint(1, 60)
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), rng.randint(1, n))) | {rng.getrandbits(64) for _ in range(rng.randint(0, n // 5))}
        hashes = [S.np.array(sorted(x), dtype=S.np.uint64) for x in (a, b)]
        some = S.np.array(sorted(rng.sample(sorted(a | b), len(a | b) // 2)), dtype=S.np.uint64)
        for common in (none, (some, S.np.array([rng.randint(3, 9) for _ in some], dtype=S.np.int64))):
            p, q = (set(S.prefix(h, common, 0.8).tolist()) for h in hashes)
            assert S.jaccard(a, b) < 0.8 or p & q


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
