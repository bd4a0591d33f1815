"""Quality by a generalised additive model with pairwise interactions.

Features of a text are binned at quantiles. Boosting cycles through them: each
turn fits a tree of at most four leaves to the gradient over one feature's
bins and adds it, damped, to that feature's lookup table. Then the pairs whose
coarse grids explain most of what is left are boosted the same way into
two-way tables. A score is the sum of a text's table entries.

Training is numpy on the driver, on the features (not the texts) of a bounded
sample of labelled rows; features are computed where the texts lie, and
scoring is one lookup an entry for a whole batch. Nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stratified

FEATURES = ("log_words", "word_length", "upper", "digits", "marks", "bangs", "bars", "distinct", "commonest", "repeated_pairs", "repeated_lines", "line_words", "marked_words", "short_words", "longest_word", "stops")
SAMPLE = 6000  # labelled rows of each class, about
BINS = 48
PAIR_BINS = 12
PAIRS = 6
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.1
LEAST = 8  # rows in a leaf
RIDGE = 1.0

MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def features(text: str | None) -> list[float]:
    """The ``FEATURES`` of a whole text; an empty one has zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = len(data)
    letters = int(count[65:91].sum() + count[97:123].sum()) or 1
    marks = int(sum(count[b] for b in MARKS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    tally = Counter(words)
    pairs = set(zip(words, words[1:]))
    lengths = list(map(len, words))
    bare = [w for w in words if not w[-1:].isalnum() and w[-1] < 128 and w[-1] not in b".,"]
    return [
        float(np.log1p(n)),
        (size - n) / n,
        int(count[65:91].sum()) / letters,
        int(count[48:58].sum()) / size,
        marks / size,
        int(count[33]) / n,
        int(count[124]) / n,
        len(tally) / n,
        max(tally.values()) / n,
        1 - len(pairs) / max(1, n - 1) if n > 1 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        len(bare) / n,
        sum(1 for x in lengths if x <= 3) / n,
        float(np.log1p(max(lengths))),
        int(count[46]) / n,
    ]


def _tree(g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values over ordered bins: splits where the gain is largest, ``depth`` times at most."""
    gs, hs, ns = g.cumsum(), h.cumsum(), rows.cumsum()
    out = np.full(len(g), -gs[-1] / (hs[-1] + RIDGE))
    if depth == 0 or len(g) < 2:
        return out
    left, right = (ns[:-1] >= LEAST), (ns[-1] - ns[:-1] >= LEAST)
    gain = np.where(left & right, gs[:-1] ** 2 / (hs[:-1] + RIDGE) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + RIDGE), -np.inf)
    at = int(gain.argmax())
    if gain[at] <= gs[-1] ** 2 / (hs[-1] + RIDGE) + 1e-9:
        return out
    return np.concatenate([_tree(g[: at + 1], h[: at + 1], rows[: at + 1], depth - 1), _tree(g[at + 1 :], h[at + 1 :], rows[at + 1 :], depth - 1)])


def _grid(g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values over a grid: the best cut of one axis, each side cut best on the other; and the gain."""
    best, found = -np.inf, None
    for turn in (False, True):
        a, b, c = (x.T if turn else x for x in (g, h, rows))
        for cut in range(1, len(a)):
            value, gain = np.empty_like(a), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                leaf = _tree(a[part].sum(axis=0), b[part].sum(axis=0), c[part].sum(axis=0), 1)
                value[part] = leaf
                gain += float(-(a[part].sum(axis=0) * leaf).sum())
            if gain > best:
                best, found = gain, value.T if turn else value
    return found, best


@dataclass
class Model:
    """``edges`` and ``tables`` by feature; ``pairs`` of feature numbers with coarse edges and two-way tables; ``bias``."""

    edges: list
    tables: list
    pairs: list
    pair_edges: list
    pair_tables: list
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features, 0 to 1."""
        z = np.full(len(x), self.bias)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables)):
            z += values[np.searchsorted(edges, x[:, k], side="right")]
        for (i, j), values in zip(self.pairs, self.pair_tables):
            z += values[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost main effects in turn, then pairs. One class only, or no rows: a constant score."""
    count = len(FEATURES)
    none = [np.zeros(0) for _ in range(count)]
    if len(y) == 0 or y.min() == y.max():
        return Model(none, [np.zeros(1)] * count, [], none, [], 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0))
    edges = [_edges(x[:, k], BINS) for k in range(count)]
    binned = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(binned, tables)]
    bias = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(len(y), bias)
    for _ in range(ROUNDS):
        for k in range(count):
            p = 1 / (1 + np.exp(-z))
            g, h = np.bincount(binned[k], p - y, len(tables[k])), np.bincount(binned[k], p * (1 - p), len(tables[k]))
            step = RATE * _tree(g, h, rows[k])
            tables[k] += step
            z += step[binned[k]]
    coarse = [_edges(x[:, k], PAIR_BINS) for k in range(count)]
    small = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]

    def cells(i: int, j: int):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at = small[i] * shape[1] + small[j]
        return shape, at, np.bincount(at, minlength=shape[0] * shape[1]).reshape(shape)

    def sums(at, shape):
        p = 1 / (1 + np.exp(-z))
        return tuple(np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (p - y, p * (1 - p)))

    ranked = []
    for i in range(count):
        for j in range(i + 1, count):
            shape, at, n = cells(i, j)
            if min(shape) > 1:
                ranked.append((_grid(*sums(at, shape), n)[1], i, j))
    pairs = [(i, j) for _, i, j in sorted(ranked, key=lambda r: (-r[0], r[1:]))[:PAIRS]]
    held = [cells(i, j) for i, j in pairs]
    pair_tables = [np.zeros(shape) for shape, _, _ in held]
    for _ in range(PAIR_ROUNDS):
        for k, (shape, at, n) in enumerate(held):
            step = RATE * _grid(*sums(at, shape), n)[0]
            pair_tables[k] += step
            z += step.ravel()[at]
    return Model(edges, tables, pairs, coarse, pair_tables, bias)


FEATURE_ARRAY = T.ArrayType(T.DoubleType())


@F.pandas_udf(FEATURE_ARRAY)
def features_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Train on a bounded sample of the rows of ``labels`` that ``learnable`` (over the key) admits.

    Rows without a label or key are left out; of a repeated key one row is
    taken. The sample is broadcast to the texts, of which only its rows are
    shuffled; the bias is then set to the classes' shares among all labels.
    Without labels of both classes scores are constant.
    """
    rows = labels.filter(learnable).filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("key"), (F.col(label) > 0).cast("int").alias("label"))
    shares = dict(rows.groupBy("label").count().collect())
    # one row a key, of several the better label and the text with the least hash
    rows = stratified(rows, "key", "label", SAMPLE, classes=2).groupBy("key").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(key).alias("t_key"), F.col(text).alias("text"))
    found = texts.join(F.broadcast(rows), F.col("key") == F.col("t_key")).groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = sorted((k, v, list(x)) for k, v, x in found.select("key", "label", features_udf("text").alias("x")).collect())
    y = np.array([v for _, v, _ in got], int)
    model = train(np.array([x for _, _, x in got]).reshape(-1, len(FEATURES)), y)
    if 0 < y.sum() < len(y):
        model.bias += float(np.log(shares[1] / shares[0]) - np.log(y.mean() / (1 - y.mean())))
    return model


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "quality_score") -> DataFrame:
    """Add ``out``, 0 to 1. Null, empty and blank texts are scored as texts whose features are all zero."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(Model(**sent.value).score(np.array([features(t) for t in texts])))

    return docs.withColumn(out, score(F.col(text)))
