"""Quality: a sparse rule ensemble over text statistics.

Shallow boosted trees are grown on the statistics of labelled rows; every path from a root to a
node is a conjunction of thresholds, a rule. A lasso logistic regression keeps few of the rules
and weighs them. The model is a list of rules, compiled into one Spark column expression.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, map_text, spread, table, train_rows

#: Labelled rows of either class that the rules are fitted on, at most.
TRAIN_ROWS = 8000
#: Trees, their depth, candidate thresholds of a statistic, and the lasso's penalty.
TREES, DEPTH, BINS, PENALTY = 30, 3, 24, 2e-3
THRESHOLD = 0.3

STATS = (
    "n_words", "mean_word", "long_words", "upper", "symbols", "digits", "pipes", "distinct_words", "top_word", "repeated_words",
    "distinct_pairs", "n_lines", "words_a_line", "repeated_lines", "ends_in_sign", "sentence_ends", "non_ascii",
)

_UPPER = bytes(range(0x41, 0x5B))
_LETTER_DIGIT_SPACE = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), 0x20, *range(9, 14)])
_DIGIT = bytes(range(0x30, 0x3A))
_HIGH = bytes(range(0x80, 0x100))
_SIGNS = (b"!", b"#", b"$", b"%", b"&", b"*", b"|")


def statistics(text: str | None) -> tuple[float, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0.0,) * len(STATS)
    n, size = len(words), len(raw)
    count = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = size - sum(map(raw.count, (b" ", b"\n")))
    return (
        float(n),
        letters / n,
        sum(len(w) > 20 for w in words) / n,
        (size - len(raw.translate(None, _UPPER))) / size,
        len(raw.translate(None, _LETTER_DIGIT_SPACE)) / size,
        (size - len(raw.translate(None, _DIGIT))) / size,
        raw.count(b"|") / n,
        len(count) / n,
        max(count.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        float(len(lines)),
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        sum(w.endswith(_SIGNS) for w in words) / n,
        raw.count(b".") / n,
        (size - len(raw.translate(None, _HIGH))) / size,
    )


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a double column for each of STATS; null and empty texts have zeros."""

    def make():
        return lambda texts: [list(x) for x in zip(*map(statistics, texts), strict=True)]

    return map_text(docs, text, [T.StructField(f"stat_{s}", T.DoubleType()) for s in STATS], make)


#: A rule: conditions (statistic, is at most or above, threshold), all to hold.
Rule = tuple[tuple[int, bool, float], ...]


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: Rule, depth: int, rules: list[Rule], step: np.ndarray) -> None:
    """One node of a tree of second-order boosting; leaves add to step."""
    least = max(5, len(g) // 500)
    best = (1e-6, None, None)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    if depth:
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            sums = [np.cumsum(np.bincount(bins[rows, f], weights=w, minlength=len(c) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows)))]
            gl, hl, nl = sums
            gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
            gain[(nl < least) | (len(rows) - nl < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, k)
    if best[1] is None:
        step[rows] += -total_g / (total_h + 1)
        return
    _, f, k = best
    left = bins[rows, f] <= k
    for part, low in ((rows[left], True), (rows[~left], False)):
        longer = (*path, (f, low, float(cuts[f][k])))
        rules.append(longer)
        _grow(x, bins, cuts, g, h, part, longer, depth - 1, rules, step)


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, low, at in rule:
        out &= (x[:, f] <= at) == low
    return out


def _canonical(rule: Rule) -> Rule:
    """The tightest condition of each statistic and direction, in order."""
    tight: dict[tuple[int, bool], float] = {}
    for f, low, at in rule:
        k = (f, low)
        tight[k] = at if k not in tight else (min if low else max)(tight[k], at)
    return tuple((f, low, at) for (f, low), at in sorted(tight.items()))


def fit_rules(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, rules with weights) of a lasso logistic regression over tree paths."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    if len(y) < 20 or y.min() == y.max():
        return float(np.log(share / (1 - share))), []
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 2)[1:-1])) for c in x.T]
    bins = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    rules: list[Rule] = []
    rng, f = np.random.default_rng(7), np.full(len(y), np.log(share / (1 - share)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(len(y))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        some = [c if rng.random() < 0.7 else c[:0] for c in cuts]  # a part of the statistics, for variety
        _grow(x, bins, some, p - y, p * (1 - p), rows, (), DEPTH, rules, step)
        f = f + 0.3 * step
    rules = sorted({_canonical(r) for r in rules})
    held = np.column_stack([_holds(x, r) for r in rules]).astype(np.float64)
    mean, scale = held.mean(0), held.std(0)
    keep = scale > 1e-6
    rules, held, mean, scale = [r for r, k in zip(rules, keep, strict=True) if k], held[:, keep], mean[keep], scale[keep]
    held = (held - mean) / scale
    w = np.zeros(held.shape[1] + 1)
    w[0] = np.log(share / (1 - share))
    z, t = w.copy(), 1.0
    size = 4 / np.linalg.norm(np.column_stack([np.ones(len(y)), held]), 2) ** 2 * len(y)
    for _ in range(400):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-np.clip(z[0] + held @ z[1:], -30, 30)))
        grad = np.r_[(p - y).mean(), held.T @ (p - y) / len(y)]
        new = z - size * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - size * PENALTY, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z = new + (old - 1) / t * (new - w)
        w = new
    weights = w[1:] / scale
    return float(w[0] - mean @ weights), [(r, float(v)) for r, v in zip(rules, weights, strict=True) if v]


def compile_rules(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The score of a row of statistics as a column expression."""
    z = F.lit(intercept)
    for rule, weight in rules:
        held = None
        for f, low, at in rule:
            stat = F.col(f"stat_{STATS[f]}")
            one = stat <= at if low else stat > at
            held = one if held is None else held & one
        z = z + F.when(held, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[float, list[tuple[Rule, float]]]:
    """The rules, from labelled rows that are not held out (at most `most` of either class).

    If the rarer class has fewer rows, the other one is still taken up to `most`.
    """
    seen = with_statistics(train_rows(docs, labels, "quality", most)).select("y", *[f"stat_{s}" for s in STATS]).toPandas()
    seen = seen.sort_values(list(seen.columns)).to_numpy(dtype=float)
    return fit_rules(seen[:, 1:], seen[:, 0])


def score(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on) appended.

    Null and empty texts are scored by zero statistics. Other columns stay, but for those named
    score, predicted or stat_*, which are replaced.
    """
    found = with_statistics(docs, text).withColumn("score", compile_rules(*model))
    found = found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return found.drop(*[f"stat_{s}" for s in STATS])


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(spread(docs), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
