"""Quality classifier: a generalised additive model with pairwise interactions, fitted by cyclic boosting.

A text becomes a row of features; each feature is cut into at most ``BINS`` bins at quantiles of the
training rows. Boosting goes round the features in turn: a shallow tree on one feature's bins
(``LEAVES`` leaves) fits the gradient of the log loss, and its leaf values times the rate are added
to that feature's lookup table. After the single features, the pairs that explain most of what is
left get tables of their own, over coarser bins, by the same rounds. A score is the sigmoid of the
intercept plus one table entry for each feature and pair: vectorised additions.

Training collects at most ``TRAIN_ROWS`` labelled rows outside the held-out fold; every document is
scored over its whole text. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null, empty and blank texts have features of zero and a score like any other;
without labelled rows of both kinds every score is 0.5; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import labelled_sample, slices
from tagloom.llm.lines import DIGITS, LOWER, STOPS, SYMBOLS, UPPER, count, lines_with_words

TRAIN_ROWS = 8000
SLICE = 4_000_000
BINS = 32
PAIR_BINS = 8
LEAVES = 3
PAIRS = 6
FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "bangs", "stops", "bars", "distinct_words", "distinct_lines", "closed_lines", "line_length", "longest_word", "short_words", "common_word")


def features(text: bytes) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), max(1, sum(map(len, words)))
    lines = lines_with_words(text)
    upper, lower = count(text, UPPER), count(text, LOWER)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = list(map(len, words))
    return [
        math.log1p(n),
        size / n,
        count(text, SYMBOLS) / size,
        upper / (upper + lower + 1),
        count(text, DIGITS) / size,
        text.count(b"!") / n,
        count(text, STOPS) / n,
        text.count(b"|") / n,
        len(counts) / n,
        sum(not again for _, again in lines) / len(lines),
        sum(x.rstrip()[-1:] in (b".", b"?", b"!") for x, _ in lines) / len(lines),
        math.log1p(n / len(lines)),
        math.log1p(max(lengths)),
        sum(k <= 3 for k in lengths) / n,
        max(counts.values()) / n,
    ]


@dataclass
class Gam:
    """Cut points and lookup tables. tables[j][b]: what bin b of feature j adds; pairs: (i, j, table over coarse bins)."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cuts, x[:, j], side="right")]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cut_points(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
    """Leaf values by bin of the best tree of contiguous bins, split greedily; gradient and weight are sums by bin."""
    parts = [(0, len(gradient))]
    value = lambda a, b: gradient[a:b].sum() / (weight[a:b].sum() + ridge)
    worth = lambda a, b: gradient[a:b].sum() ** 2 / (weight[a:b].sum() + ridge)
    while len(parts) < leaves:
        best = max(((worth(a, k) + worth(k, b) - worth(a, b), a, k, b) for a, b in parts for k in range(a + 1, b)), default=None)
        if best is None or best[0] <= 1e-12:
            break
        parts.remove((best[1], best[3]))
        parts += [(best[1], best[2]), (best[2], best[3])]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = value(a, b)
    return out


def _first_cut(gradient: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> int:
    """The row cut of the best depth-two tree: each cut is judged with the best column cut on either side of it.

    Judged alone, a cut shows nothing of a pure interaction, where both halves have the same sums.
    """
    def side(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge)  # the last column: no cut
        return gain.max(1)

    g, h = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    return int(np.argmax(side(g[:-1], h[:-1]) + side(g[-1] - g[:-1], h[-1] - h[:-1]))) + 1


def fit_rows(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 20, rate: float = 0.15) -> Gam:
    if len(y) == 0 or y.min() == y.max():
        return Gam()
    n, k = x.shape
    rate_of_ones = y.mean()
    m = Gam(float(np.log(rate_of_ones / (1 - rate_of_ones))))
    m.cuts = [_cut_points(x[:, j], BINS) for j in range(k)]
    m.coarse = [_cut_points(x[:, j], PAIR_BINS) for j in range(k)]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    bins = [np.searchsorted(m.cuts[j], x[:, j], side="right") for j in range(k)]
    wide = [np.searchsorted(m.coarse[j], x[:, j], side="right") for j in range(k)]
    margin = np.full(n, m.intercept)
    slope = lambda: 1.0 / (1.0 + np.exp(-margin))
    for _ in range(rounds):
        for j in range(k):
            p = slope()
            size = len(m.tables[j])
            step = rate * _tree(np.bincount(bins[j], y - p, size), np.bincount(bins[j], p * (1 - p), size), LEAVES)
            m.tables[j] += step
            margin += step[bins[j]]
    p = slope()
    worth = []
    for i in range(k):
        for j in range(i + 1, k):
            size = (len(m.coarse[i]) + 1) * (len(m.coarse[j]) + 1)
            cell = wide[i] * (len(m.coarse[j]) + 1) + wide[j]
            worth.append(((np.bincount(cell, y - p, size) ** 2 / (np.bincount(cell, p * (1 - p), size) + 1)).sum(), i, j))
    chosen = [(i, j) for _, i, j in sorted(worth, reverse=True)[:PAIRS]]
    tables = {ij: np.zeros((len(m.coarse[ij[0]]) + 1, len(m.coarse[ij[1]]) + 1)) for ij in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            p = slope()
            rows, cols = tables[i, j].shape
            g = np.zeros((rows, cols))
            h = np.zeros((rows, cols))
            np.add.at(g, (wide[i], wide[j]), y - p)
            np.add.at(h, (wide[i], wide[j]), p * (1 - p))
            # depth two: the first feature is cut once, then each side by the second
            cut = _first_cut(g, h) if rows > 1 else rows
            step = np.zeros((rows, cols))
            step[:cut] = _tree(g[:cut].sum(0), h[:cut].sum(0), 2)
            if cut < rows:
                step[cut:] = _tree(g[cut:].sum(0), h[cut:].sum(0), 2)
            tables[i, j] += rate * step
            margin += rate * step[wide[i], wide[j]]
    m.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return m


def _feature_batches(batches):
    for batch in batches:
        rows = [features(t or b"") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Gam:
    """Learn ``labels.quality`` from at most ``rows`` documents; their features, not their texts, come to the driver."""
    sample = labelled_sample(docs, labels, "quality", rows).select("doc_id", F.col("label").cast("int"), F.col("text").cast("binary"))
    got = sample.drop("doc_id").mapInArrow(_feature_batches, "label int, x array<double>").toArrow()
    if not got.num_rows:
        return Gam()
    x, y = np.array(got.column("x").to_pylist()), np.array(got.column("label").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the same sums at any order of rows
    return fit_rows(x[order], y[order])


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id and score of each document."""

    def each(batches):
        for batch in (part for b in batches for part in slices(b, 1, SLICE)):
            texts = batch.column(1).to_pylist()
            x = np.array([features(t or b"") for t in texts]) if texts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(each, "doc_id bigint, score double")
