"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps compatibility forms, homoglyphs and digits to the letters they stand for,
closes up words whose letters stand apart and merges l with i, so that "1D10T", "idiot" and a Cyrillic look-alike are one word. Lexicon entries are words or word
beginnings. Their weights are log odds learned from labelled rows (document frequencies over at
most TRAIN_ROWS rows of either class), beside a short general list. Matches inside an exception
phrase don't count; phrases are given or learned as contexts seen in clean rows only. The sum of
weights, normalised by the text's length, goes through a logistic curve fitted on the same rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, held_out, map_text, materialise, spread, table, train_rows

#: Labelled rows of either class that the lexicon and the curve are fitted on, at most.
TRAIN_ROWS = 6000
#: The least evidence (G squared) of an entry, and the least rows that it or an exception is in.
LEAST_EVIDENCE, LEAST_ROWS = 15.0, 3
#: An entry has to be in this part of the toxic rows, or in toxic rows that no better entry is in.
COMMON_PART = 0.03
#: Lengths of word beginnings that are tried as entries.
STEM = range(3, 9)
#: Terms that a task counts before it passes them on.
FLUSH = 200_000

GENERAL = {w: 2.0 for w in ("idiot", "moron", "stupid", "imbecile", "scum", "loser", "pathetic", "worthless", "disgusting", "clown", "trash", "vermin", "bastard", "asshole", "retard", "degenerate")}
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash collection", "clown fish", "rodeo clown", "circus clown", "pathetic fallacy", "sore loser rule")

# Letters that look like Latin ones, and digits and signs written for letters.
_LOOKS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԝ": "w", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
}
_DIGITS = dict(zip("013456789l", "oieasbtbgi", strict=True))
_FOLD = {ord(k): v for k, v in (_LOOKS | _DIGITS | {"ı": "i", "ł": "i", "​": "", "‌": "", "‍": "", "­": "", "﻿": ""}).items()}
_SIGNS = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")
_SIGN = {"@": "a", "$": "s", "!": "i", "|": "i"}
_WORD = re.compile(r"[^\W\d_]+")
_APART = re.compile(r"(?<![^\W_])[^\W_](?:([.\-_*~ ])[^\W_])(?:\1[^\W_]){2,}(?![^\W_])")
_APART_SIGN = re.compile(r"[.\-_*~ ]")


def fold(text: str | None) -> list[str]:
    """The folded words of a text: also of compatibility forms (full width, ligatures) and of words
    whose letters stand apart, by one sign or space each."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _APART.sub(lambda m: _APART_SIGN.sub("", m[0]), text.lower())
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _SIGNS.sub(lambda m: _SIGN[m[0]], text)
    return _WORD.findall(text.translate(_FOLD))


class Lexicon:
    """Entries " stem" (word beginning) or " word "; exception phrases " w1 w2 "."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        self.weights, self.exceptions = weights, exceptions
        self.auto = ahocorasick.Automaton()
        for entry, w in weights.items():
            self.auto.add_word(entry, (len(entry), w))
        for phrase in exceptions:
            self.auto.add_word(phrase, (len(phrase), None))
        if len(self.auto):
            self.auto.make_automaton()

    def hits(self, line: str) -> list[tuple[int, float]]:
        """(place, weight) of entries outside exception phrases; the best entry of a word."""
        if not len(self.auto):
            return []
        found, free = {}, []
        for end, (n, w) in self.auto.iter(line):
            if w is None:
                free.append((end - n + 1, end))
            elif w > found.get(end - n + 1, 0):
                found[end - n + 1] = w
        if not free:
            return list(found.items())
        starts, stops = [], []  # the phrases' places, merged
        for a, b in sorted(free):
            if stops and a < stops[-1]:
                stops[-1] = max(stops[-1], b)
            else:
                starts.append(a)
                stops.append(b)
        inside = lambda at: (k := bisect_right(starts, at)) and at < stops[k - 1]
        return [(at, w) for at, w in found.items() if not inside(at)]

    def features(self, text: str | None) -> tuple[float, float, int]:
        words = fold(text)
        hits = self.hits(f" {' '.join(words)} ") if words else []
        total = sum(w for _, w in hits)
        return total / math.sqrt(len(words) + 1), math.log1p(total), len(hits)


def _terms(words: set[str]) -> set[str]:
    out = {f" {w} " for w in words}
    for w in words:
        out.update(f" {w[:n]}" for n in STEM if n <= len(w))
    return out


def _counted(rows: DataFrame, of) -> DataFrame:
    """(term, toxic, clean): in how many rows of either label of(text) has a term."""

    def run(batches):
        counts = [Counter(), Counter()]

        def out():
            terms = list(counts[0].keys() | counts[1].keys())
            made = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])
            counts[0].clear(), counts[1].clear()
            return made

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[y].update(of(text))
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield out()
        yield out()

    return rows.select("text", "y").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _cover(toxic: DataFrame, best: list, n: dict[int, int]) -> dict[str, float]:
    """Weights of the entries that are taken, best evidence first.

    An entry is left out if a better one begins like it, or if it is rare and tells nothing of
    toxic rows that no better entry is in: such words stand beside the telling ones by chance. The
    toxic training rows come to the driver as places in `best`; both are bounded by parameters.
    """
    clean = {r.term: r.clean for r in best}
    order: dict[str, int] = {}
    shorter: set[str] = set()
    for r in best:
        if r.term not in shorter and not any(r.term[:k] in order for k in range(2, len(r.term) + 1)):
            order[r.term] = len(order)
            shorter.update(r.term[:k] for k in range(2, len(r.term)))
    found = F.udf(lambda t: sorted(order[x] for x in _terms(set(fold(t))) if x in order), "array<int>")
    rows_of: dict[int, list[int]] = {}
    for i, r in enumerate(toxic.select(found("text").alias("at")).toLocalIterator()):
        for k in r["at"]:
            rows_of.setdefault(k, []).append(i)
    covered, taken = set(), {}
    share = n[1] / (n[0] + n[1])
    for term, k in order.items():
        rows = rows_of.get(k, [])
        a, b = sum(i not in covered for i in rows), clean[term]
        new = a >= LEAST_ROWS and 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0)) >= LEAST_EVIDENCE
        if new or len(rows) >= max(LEAST_ROWS, COMMON_PART * n[1]):
            taken[term] = math.log((len(rows) + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))
            covered.update(rows)
    return taken


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the curve's coefficients, from labelled rows that are not held out."""
    # copies are no further evidence
    rows = materialise(train_rows(docs, labels, "toxic", most).groupBy("text").agg(F.max("y").alias("y")), "toxic-train")
    n = dict.fromkeys((0, 1), 0) | {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    weights = {f" {''.join(fold(w))} ": x for w, x in GENERAL.items()}
    exceptions = [f" {' '.join(fold(p))} " for p in EXCEPTIONS]
    if n[0] and n[1]:
        a, b, both = F.col("toxic"), F.col("clean"), F.col("toxic") + F.col("clean")
        share = n[1] / (n[0] + n[1])
        evidence = 2 * (a * F.log((a + 1e-9) / (both * share)) + b * F.log((b + 1e-9) / (both * (1 - share))))
        best = (
            _counted(rows, lambda t: _terms(set(fold(t))))
            .where((a >= LEAST_ROWS) & (a * n[0] > 4.0 * b * n[1]))
            .withColumn("g", evidence)
            .where(F.col("g") >= LEAST_EVIDENCE)
            .orderBy(F.desc("g"), F.col("term").endswith(" "), F.desc(F.length("term")), "term")
            .collect()
        )
        taken = _cover(rows.where("y = 1"), best, n)
        weights |= taken
        lexicon = Lexicon(weights, exceptions)

        def contexts(text):
            words = fold(text)
            line = f" {' '.join(words)} "
            out = set()
            for at, _ in lexicon.hits(line):
                k = line.count(" ", 0, at)
                out.update(f" {words[i]} {words[i + 1]} " for i in (k - 1, k) if 0 <= i < len(words) - 1)
            return out

        learned = _counted(rows, contexts).where((F.col("clean") >= LEAST_ROWS) & (F.col("toxic") == 0)).orderBy(F.desc("clean"), "term")
        exceptions += [r.term for r in learned.collect()]
    lexicon = Lexicon(weights, exceptions)
    curve = np.array([-3.0, 1.0, 1.0])
    if n[0] and n[1]:
        seen = _with_features(rows, lexicon).select("x1", "x2", "y").toPandas().sort_values(["y", "x1", "x2"]).to_numpy(dtype=float)
        curve = fit_logistic(seen[:, :2], seen[:, 2])
    discard(rows)
    return lexicon, curve


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method, both classes of equal weight."""
    x = np.column_stack([np.ones(len(x)), x])
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + ridge * len(y) * np.r_[0, w[1:]]
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.diag([1e-6, *[1] * (len(w) - 1)])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


_FEATURES = [T.StructField("x1", T.DoubleType()), T.StructField("x2", T.DoubleType()), T.StructField("n_toxic_terms", T.IntegerType())]


def _with_features(rows: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    weights, exceptions = lexicon.weights, lexicon.exceptions

    def make():
        own = Lexicon(weights, exceptions)

        def work(texts):
            return [list(x) for x in zip(*map(own.features, texts), strict=True)] or [[], [], []]

        return work

    return map_text(rows, text, _FEATURES, make)


def score(docs: DataFrame, lexicon: Lexicon, curve: np.ndarray, text: str = "text") -> DataFrame:
    """docs with n_toxic_terms, score (0 to 1) and predicted appended.

    Null and empty texts have no terms and the curve's lowest score. Other columns stay, but for
    those named like an output (or x1, x2), which are replaced.
    """
    z = F.lit(float(curve[0])) + F.col("x1") * float(curve[1]) + F.col("x2") * float(curve[2])
    found = _with_features(docs, lexicon, text).withColumn("score", 1 / (1 + F.exp(-z)))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("x1", "x2")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_toxic_terms) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon, curve = learn(docs, table(spark, sf_dir, "labels"))
    return score(spread(docs), lexicon, curve).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_toxic_terms")
