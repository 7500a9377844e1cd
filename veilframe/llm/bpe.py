"""Byte-level BPE by merge replay over the distinct words of a slice of the corpus.

A slice's texts are split by the pattern, and its distinct words that are not yet known are laid
end to end in flat arrays. An inverted index maps each rank to the positions of the token pairs
that merge into it. The ranks are replayed in rising order: one merge is applied to all words that
hold its pair, and only the two neighbours of each merged position are looked up and indexed anew.

Words are independent, so the replay equals the usual "lowest rank first" of each word as long as
a merge never makes a pair of a lower rank. Where one does, that word is encoded by itself.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import CACHE, map_text, spread, table

#: Words whose ids a Python worker remembers. Only speed depends on it.
REMEMBERED = 1_000_000
#: Bytes of distinct words that one replay lays out (about 90 bytes of memory for each).
REPLAY_BYTES = 1 << 20
#: Longer words are not remembered.
LONG_WORD = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: merge the leftmost pair of the lowest rank, again and again."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    stop, start, heap = list(range(1, n + 1)), list(range(-1, n)), []
    for i in range(n - 1):
        if (r := ranks.get(word[i : i + 2])) is not None:
            heappush(heap, (r, i, i + 2))
    alive = bytearray(b"\1") * n
    while heap:
        r, i, end = heappop(heap)
        j = stop[i] if alive[i] else n
        if j >= n or stop[j] != end:
            continue
        stop[i] = end
        alive[j] = 0
        if end < n:
            start[end] = i
            if (x := ranks.get(word[i : stop[end]])) is not None:
                heappush(heap, (x, i, stop[end]))
        if (p := start[i]) >= 0 and (x := ranks.get(word[p:end])) is not None:
            heappush(heap, (x, p, end))
    return [ranks[word[i : stop[i]]] for i in range(n) if alive[i]]


def byte_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """Rank of every two bytes, -1 where they don't merge."""
    pair = np.full(1 << 16, -1, dtype=np.int64)
    for token, r in ranks.items():
        if len(token) == 2:
            pair[token[0] << 8 | token[1]] = r
    return pair


def replay(words: list[bytes], ranks: dict[bytes, int], pair: np.ndarray | None = None) -> list[list[int]]:
    """Ids of each word by replaying the merges over all words at once."""
    data = b"".join(words)
    get = ranks.get
    raw = np.frombuffer(data, dtype=np.uint8)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    upto = np.cumsum(lengths)
    firsts, stop, prev = (upto - lengths).tolist(), list(range(1, len(data) + 1)), list(range(-1, len(data) - 1))
    ends = np.repeat(upto, lengths).tolist()
    for first in firsts:
        if first < len(data):
            prev[first] = -1
    # the inverted index: positions of each pair of bytes that merges, by rank, in rising order
    if pair is None:
        pair = byte_pairs(ranks)
    index: dict[int, list[int]] = {}
    if len(data) > 1:
        of = pair[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        of[upto[(upto > 0) & (upto < len(data))] - 1] = -1  # not across words
        places = np.flatnonzero(of >= 0)
        places = places[np.argsort(of[places], kind="stable")]
        found, begins = np.unique(of[places], return_index=True)
        for r, at in zip(found.tolist(), np.split(places, begins[1:]), strict=False):
            index[r] = at.tolist()
    alive = bytearray(b"\1") * len(data)
    odd: set[int] = set()
    queue = sorted(index)  # a sorted list is a heap
    while queue:
        rank = heappop(queue)
        for i in sorted(index.pop(rank)):
            end = ends[i]
            j = stop[i]
            if not alive[i] or j >= end:
                continue
            k = stop[j]
            if get(data[i:k]) != rank:
                continue
            stop[i] = k
            alive[j] = 0
            if k < end:
                prev[k] = i
                if (r := get(data[i : stop[k]])) is not None:
                    if r < rank:
                        odd.add(end)
                    if (to := index.get(r)) is None:
                        index[r] = [i]
                        heappush(queue, r)
                    else:
                        to.append(i)
            p = prev[i]
            if p >= 0 and (r := get(data[p:k])) is not None:
                if r < rank:
                    odd.add(end)
                if (to := index.get(r)) is None:
                    index[r] = [p]
                    heappush(queue, r)
                else:
                    to.append(p)
    out = []
    for first, word in zip(firsts, words, strict=True):
        end = first + len(word)
        if end in odd:
            out.append(encode_word(word, ranks))
            continue
        ids, i = [], first
        while i < end:
            k = stop[i]
            ids.append(ranks[data[i:k]])
            i = k
        out.append(ids)
    return out


class Codec:
    """Encodes slices of texts and decodes ids. Remembers words between slices."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}  # ids as 32-bit words
        self.pair = byte_pairs(ranks)
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of, self.name_of = [b""] * size, [str(i) for i in range(size)]
        for token, i in ranks.items():
            self.bytes_of[i] = token

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.find(t) if t else [] for t in texts]
        new = {w for words in cut for w in words}.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = {w for words in cut for w in words}
        known, rest = self.known, []
        for w in new:
            raw = w.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is None:
                rest.append((w, raw))
            else:
                known[w] = whole.to_bytes(4, "little")
        begin = size = 0
        for end, (_, raw) in enumerate(rest, 1):
            size += len(raw)
            if size >= REPLAY_BYTES or end == len(rest):
                part = rest[begin:end]
                for (w, _), ids in zip(part, replay([raw for _, raw in part], self.ranks, self.pair), strict=True):
                    known[w] = np.array(ids, dtype="<u4").tobytes() if len(ids) > 99 else struct.pack(f"<{len(ids)}I", *ids)
                begin, size = end, 0
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u4").tolist() for words in cut]
        for w, _ in rest:
            if len(w) > LONG_WORD:
                del known[w]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process for all tasks of this operator."""
    known = CACHE.setdefault("bpe", {})
    if (path, pattern) not in known:
        known[path, pattern] = Codec(load_ranks(path), pattern)
    return known[path, pattern]


def with_ids(docs: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """docs with an array<int> of token ids. Null and empty texts have none; other columns stay,
    but for one named like the output, which it replaces. The rank file lies at `path` on every
    executor."""

    def make():
        c = codec(path, pattern)
        return lambda texts: [c.encode(texts)]

    return map_text(docs, text, [T.StructField(name, T.ArrayType(T.IntegerType()))], make, "bpe")


def with_digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256: encoded, then decoded from the ids."""

    def make():
        c = codec(path, pattern)

        def work(texts):
            n, ids_sha, decoded_sha = [], [], []
            for ids in c.encode(texts):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(c.name_of.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            return [n, ids_sha, decoded_sha]

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_text(docs, text, fields, make, "bpe")


def with_round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids and round_trip: whether the ids decode to the text's bytes."""

    def make():
        c = codec(path, pattern)

        def work(texts):
            ids = c.encode(texts)
            return [list(map(len, ids)), ids, [c.decode(x) == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)]]

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]
    return map_text(docs, text, fields, make, "bpe")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    import public_tokenizers

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = with_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
