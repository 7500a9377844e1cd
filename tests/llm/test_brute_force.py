"""Media digests, shards and text statistics against plain second computations."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
import xxhash

from veilframe.llm import media, quality, sharding

TEXTS = [None, "", "abc", "a" * 64, "a" * 65, "é中\U0001f600 end", "The quick  brown fox! Jumps | over 12 dogs.\n\nThe quick brown fox! Jumps | over 12 dogs.\n" * 9, "x " * 700]


def plain_resize(rows, height, width):
    """Means of the cells of a height x width grid laid over the samples, exactly."""
    h, w = len(rows), len(rows[0])

    def shares(i, n, size):
        a, b = Fraction(i * size, n), Fraction((i + 1) * size, n)
        return [(k, min(b, k + 1) - max(a, k)) for k in range(int(a), size) if k < b]

    cell = lambda i, j: sum(rows[y][x] * p * q for y, p in shares(i, height, h) for x, q in shares(j, width, w))
    return [[cell(i, j) * height * width / (h * w) for j in range(width)] for i in range(height)]


def test_media_digests(spark, docs):
    by = {r.doc_id: r for r in media.text_media_digests(docs(*TEXTS)).collect()}
    stored = {r.doc_id: bytes(r.media) for r in media.stored_texts(docs(*TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        padded = raw + b"\0" * ((64 - len(raw) % 64) % 64 or (0 if raw else 64))
        form, r = stored[i], by[i]
        width, height, most, payload = re.fullmatch(rb"P5\s(\d+)\s(\d+)\s(\d+)\s(.*)", form, re.DOTALL).groups()
        assert (int(width), int(height), int(most), payload) == (64, len(padded) // 64, 255, padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-64:]), len(form), hashlib.sha256(form).hexdigest())
        small = plain_resize([padded[k : k + 64] for k in range(0, len(padded), 64)], 8, 9)
        bits = "".join("1" if round(float(a), 6) < round(float(b), 6) else "0" for row in small for a, b in zip(row, row[1:], strict=False))
        assert r.feature == f"{int(bits, 2):016x}"


def plain_shards(rows, n=sharding.SHARDS):
    """(id, size, crc) in the order of shards, with shard and slot."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keyed = []
    for i, text in rows:
        raw = (text or "").encode()
        keyed.append((signed(xxhash.xxh64_intdigest(raw, 42)), i is not None, i or 0, len(raw) + 1, zlib.crc32(raw)))
    keyed.sort()
    total, at, starts, groups = sum(k[3] for k in keyed), 0, [], {}
    for k in keyed:
        starts.append(at)
        first, size, copies = groups.get(k[0], (at, 0, 0))
        groups[k[0]] = (first, size + k[3], copies + 1)
        at += k[3]
    out, slots = [], {}
    for k, start in zip(keyed, starts, strict=True):
        first, size, copies = groups[k[0]]
        whole = copies > 1 and size * n * sharding.GROUP_PART <= total
        shard = min(n - 1, ((2 * first + size) if whole else (2 * start + k[3])) * n // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        out.append((k[2] if k[1] else None, k[3], k[4], shard, slots[shard]))
    return out


def test_shards(spark, docs):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 90))) for _ in range(5000)]
    rows = list(enumerate([*texts, *["hot " * 20] * 2500, *["two"] * 2, None, ""])) + [(None, "x"), (3, texts[3])]
    got = sorted(map(tuple, sharding.shards(docs(*rows)).collect()), key=str)
    assert got == sorted(plain_shards(rows), key=str)


def plain_statistics(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return dict.fromkeys(quality.STATS, 0.0)
    share = lambda pattern: len(re.findall(pattern, raw)) / len(raw)
    lines = [x for x in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    pairs = [(words[i], words[i + 1]) for i in range(len(words) - 1)]
    n = len(words)
    return {
        "n_words": n, "mean_word": len(re.findall(rb"[^ \n]", raw)) / n, "long_words": len([w for w in words if len(w) > 20]) / n, "upper": share(rb"[A-Z]"), "symbols": share(rb"[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]"),
        "digits": share(rb"[0-9]"), "pipes": raw.count(b"|") / n, "distinct_words": len(set(words)) / n, "top_word": max(words.count(w) for w in set(words)) / n, "repeated_words": len([1 for a, b in pairs if a == b]) / n,
        "distinct_pairs": len(set(pairs)) / max(1, n - 1), "n_lines": len(lines), "words_a_line": n / len(lines), "repeated_lines": 1 - len(set(lines)) / len(lines),
        "ends_in_sign": len([w for w in words if re.search(rb"[!#$%&*|]\Z", w)]) / n, "sentence_ends": raw.count(b".") / n, "non_ascii": share(rb"[\x80-\xff]"),
    }


def test_statistics(spark, docs):
    for i, row in enumerate(quality.with_statistics(docs(*TEXTS)).orderBy("doc_id").collect()):
        want = plain_statistics(TEXTS[i])
        assert {s: row[f"stat_{s}"] for s in quality.STATS} == pytest.approx(want)
