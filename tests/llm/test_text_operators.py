"""BPE, media, decontamination, classifiers: round trips, brute force and held-out accuracy."""

import hashlib
import io
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from veilframe.llm import bpe, decontam, media, quality, toxicity

PATH, SF = P.path("byte_bpe_50k.tiktoken"), "/root/testdata/sf0.01"
ODD = [None, "", " ", "a" * 3000, "x " * 5000, "\u00e9\u4e2d\U0001f600 it's 123 \n\n  end", "I'm I'M \t\u00a0\u2028x", "\x1c\x1f\x85"]


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_bpe_equals_the_library(spark, docs, encoding):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcde fghi\n'\u00e9\u00df0123.,") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    rows = bpe.with_ids(docs(*texts), PATH, P.PATTERN).collect()
    assert all(r.ids == encoding.encode_ordinary(r.text or "") for r in rows)
    digests = {r.doc_id: r for r in bpe.with_digests(docs(*texts).withColumn("n_tokens", F.lit("clash")), PATH, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        assert digests[i].n_tokens == len(ids) and digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_replay_where_a_merge_makes_a_lower_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 290, b"bc": 310, b"xyz": 256, b"xy": 400, b"zx": 401}
    words = [b"abc", b"ababc", b"xyzxyz", b"bcab", b"a", b"abcabc"]
    assert bpe.replay(words, ranks) == [bpe.encode_word(w, ranks) for w in words]


def test_media_round_trips():
    rng = np.random.default_rng(0)
    for shape in ((1, 1), (5, 7), (33, 64), (5, 7, 3)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode_netpbm(image)) == image).all() and (media.decode(media.encode_bmp(image)) == image).all()
    assert media.decode(b"P1\n# note\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4 3 2\n\xa0\x40").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 15\n0 15").tolist() == [[0, 255]] and media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    image = rng.integers(0, 256, (16, 18), dtype=np.uint8)
    assert np.allclose(media.area_resize(image, 8, 9), image.reshape(8, 2, 9, 2).mean((1, 3)))
    assert media.area_resize(np.full((5, 7), 9), 3, 4) == pytest.approx(9)
    assert np.load(io.BytesIO(media.npy_tile(image))).shape == (32, 32)


def test_stored_texts(spark, docs):
    rows = media.text_media_digests(docs(*ODD, ODD[5])).orderBy("doc_id").collect()
    for r in rows:
        raw = (r.text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
    same = [(r.media_sha256, r.feature) for r in rows if r.text == ODD[5]]
    assert len(same) == 2 and same[0] == same[1]
    stored = media.stored_texts(docs("abc", None))
    tiles = media.tiles(stored, "media").orderBy("doc_id").collect()
    assert [t.error for t in tiles] == [None, None] and tiles[0].dhash and tiles[0].height == 1
    bad = spark.createDataFrame([(b"P5 9 9 255\n1",), (b"junk",), (None,)], "image binary")
    assert all(r.error and r.tile is None for r in media.tiles(bad).collect())


def plain_contamination(text, items, width=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = cut(text), set(), set()
    for item, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            win = w[i : i + width]
            for k in range(len(words) - len(win) + 1):
                if words[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    found.add(item)
    return len(words), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_contamination_equals_brute_force(spark, docs, block):
    rng = random.Random(4)
    words = ["one", "TWO", "thr\u00e9e", "4", "five", "six"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((30, 14, 3, 10, 11))] + [(7, None), (8, ""), (9, "one one"), (2, "five six five six")]
    texts = [None, "", "one"] + [" ".join(rng.choice(words) + rng.choice(["", ",", ".\n"]) for _ in range(40)) + " " + rng.choice([t for _, t in items[:5]]).upper().replace("\u00c9", "\u00e9") for _ in range(25)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contamination(docs(*texts).withColumn("items", F.lit(1)), bench, block_bytes=block).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        assert (r.n_words, r.n_hit, r["items"]) == plain_contamination(t, items)
        inside = [decontam.words_of(t[s.start : s.end]) for s in r.spans]
        assert sum(map(len, inside)) == r.n_hit
    assert decontam.contamination(docs("one"), bench.limit(0)).first().n_hit == 0


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def accuracy(scored, labels, label):
    both = scored.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).join(labels, "doc_id")
    return both.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]


def test_quality_on_held_out_rows(spark):
    table, labels = tables(spark)
    model = quality.learn(table, labels)
    assert 0 < len(model[1]) < 200
    assert accuracy(quality.score(table, model), labels, "quality") > 0.9


def test_compiled_rules_equal_the_model(spark, docs):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality.STATS)))
    y = ((x[:, 1] > 0.5) & (x[:, 6] < 0.4)).astype(float)
    intercept, rules = quality.fit_rules(x, y)
    z = intercept + sum(w * quality._holds(x, r) for r, w in rules)
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], ", ".join(f"stat_{s} double" for s in quality.STATS))
    got = [r[0] for r in df.coalesce(1).select(quality.compile_rules(intercept, rules)).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and ((np.array(got) > 0.5) == y).mean() > 0.95


def test_scores_of_odd_rows(spark, docs):
    table, labels = tables(spark)
    odd = docs(*ODD, (None, "text")).withColumn("score", F.lit("clash"))
    scored = quality.score(odd, quality.learn(table, labels))
    assert scored.count() == len(ODD) + 1 and scored.where("score between 0 and 1").count() == len(ODD) + 1
    lexicon, curve = toxicity.learn(table.limit(0), labels.limit(0))
    assert toxicity.score(odd, lexicon, curve).where("predicted = 0").count() == len(ODD) + 1
    assert quality.learn(table.limit(0), labels.limit(0))[1] == []


def test_toxicity_learns_stems_and_sees_through_disguise(spark, docs):
    rng = random.Random(7)
    plain = lambda: " ".join(rng.choice(["the", "of", "weather", "river", "stone", "house"]) + rng.choice(["", "s", "ing"]) for _ in range(40))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, plain() + (f" grobul{rng.choice(['ik', 'an', 'o'])} {plain()}" if bad else "")))
        labels.append((i, 1, int(bad)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon, curve = toxicity.learn(docs(*rows), lab)
    test = docs("a river grobulex here", "a river GR0BULEX here", "a river gr\u043ebulex here", "a river here", "you 1D10T", "put it in the trash can now", None)
    got = [r.predicted for r in toxicity.score(test, lexicon, curve).orderBy("doc_id").collect()]
    assert got == [1, 1, 1, 0, 1, 0, 0]
    assert accuracy(toxicity.score(docs(*rows), lexicon, curve), lab, "toxic") == 1


def test_toxicity_on_held_out_rows(spark):
    table, labels = tables(spark)
    assert accuracy(toxicity.score(table, *toxicity.learn(table, labels)), labels, "toxic") > 0.85
    scored = toxicity.score(table, *toxicity.learn(table, labels)).where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).join(labels, "doc_id")
    hit, named, toxic = scored.agg(F.sum(F.col("toxic") * F.col("predicted")), F.sum("predicted"), F.sum("toxic")).first()
    assert hit >= 0.6 * toxic and hit >= 0.6 * named


def test_toxicity_folds_disguises_and_merges_exceptions():
    folded = lambda t: " ".join(toxicity.fold(t))
    assert folded("\uff49\uff44\uff49\uff4f\uff54") == folded("i.d.i.o.t") == folded("i d i o t") == folded("1D10T") == folded("idiot")
    assert folded("\ufb01lth") == folded("filth") and folded("a b in c.d") == "a b in c d".replace("l", "i")
    lexicon = toxicity.Lexicon({" trash ": 1.0, " idiot ": 2.0}, [" trash can ", " can trash "])
    assert [w for _, w in lexicon.hits(" trash can trash can idiot trash ")] == [2.0, 1.0]
    assert len(lexicon.hits(" trash can" * 20_000 + " idiot " * 20_000)) == 20_000
