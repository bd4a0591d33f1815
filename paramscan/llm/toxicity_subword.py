"""Toxicity by averaged subword embeddings and a linear softmax.

A text is the bag of its words' character n-grams (bytes of the lower-cased
text, word edges included), each hashed to a bucket with an embedding. The
bag's mean feeds a linear softmax; embeddings and softmax are trained jointly
in numpy on a bounded sample of labelled rows, on the driver. A misspelling
never seen shares most of its n-grams with the word.

Because the mean and the softmax are both linear, scoring needs one number a
bucket: the margin of the two classes. A few words in a long text hardly move
its mean, so the mean is also taken of each short passage, and the highest of
them is pooled with that of the whole text; the two weights are learned from
a part of the sample kept aside for that. Texts are scored whole where they lie,
in blocks of bounded size; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stratified

BUCKETS = 1 << 19
DIM = 8
LENGTHS = (4, 5, 6, 7)
BLOCK = 1 << 20  # bytes of a text whose n-grams are hashed at once
SAMPLE = {1: 2500, 0: 6500}  # labelled rows of each class, about
SAMPLE_CHARS = 20_000  # longer texts of the sample are sent to the driver as counts of their buckets
ASIDE = 5  # one labelled row in so many weighs the two means
ASIDE_ROWS = 8  # of each class, at least; with fewer the text's mean alone counts
CELL = 16  # bytes; a passage is two cells, and each cell is in two passages
PASSAGE_SMOOTH = 30  # as SMOOTH, for passages
EPOCHS = 8
STEPS = 600  # at least; a small sample is gone through more often
BATCH = 64
SMOOTH = 200  # n-grams without meaning that each mean includes, so that few n-grams give no certainty
RATE = 0.05
DECAY = 0.15  # pull of embeddings to zero, against odds read from few rows
SPREAD = 16.0  # of the embeddings' steps: larger is slower

#: Letters to lower case, other ASCII to spaces; bytes of longer characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))


def placed(text: str | None):
    """Arrays of the bucket numbers of all n-grams of ``text``, of their places in the block, and the block's places in all; an n-gram holds spaces at its ends only."""
    data = b" " + b" ".join((text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()) + b" "
    most = max(LENGTHS)
    for at in range(0, max(1, len(data) - 2), BLOCK):
        piece = np.frombuffer(data, np.uint8, min(BLOCK + most - 1, len(data) - at), at)
        space = piece == 32
        value = piece.astype(np.uint32) + np.uint32(1)
        rolled, inner = value, np.zeros(len(piece), bool)
        found, places = [], []
        for n in range(2, most + 1):
            count = len(piece) - n + 1
            if count <= 0:
                break
            rolled = rolled[:count] * np.uint32(0x01000193) ^ value[n - 1 :]
            if n > 2:
                inner = inner[:count] | space[n - 2 : n - 2 + count]
            else:
                inner = inner[:count]
            if n in LENGTHS:
                here = min(count, BLOCK)
                places.append(np.flatnonzero(~inner[:here]))
                keys = rolled[places[-1]] * np.uint32(0x9E3779B1)
                found.append(((keys >> np.uint32(7)) ^ (keys >> np.uint32(19))) & np.uint32(BUCKETS - 1))
        room = max(0, min(BLOCK, len(data) - 2 - at))
        yield (np.concatenate(found), np.concatenate(places), room) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64), room)


def blocks(text: str | None):
    """The bucket numbers of ``placed`` alone."""
    return (keys for keys, _, _ in placed(text))


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text, ascending, and how many of its n-grams are in each; at most ``BUCKETS`` whatever the text's length."""
    at, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for keys in blocks(text):
        at, place = np.unique(np.concatenate([at, keys]), return_inverse=True)
        n = np.bincount(place, np.concatenate([n, np.ones(len(keys))]), len(at))
    return at.astype(np.uint32), n.astype(np.uint32)


def packed(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps from one bucket to the next, and counts, each in the narrowest type: some 3 bytes a bucket, as the driver holds all bags of a sample."""
    steps = np.diff(at.astype(np.int64), prepend=0)
    return tuple(x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (steps, n))


def shares(steps: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a packed bag and the shares of the n-grams in them."""
    return np.cumsum(steps, dtype=np.int64), (n / (n.sum(dtype=np.int64) + SMOOTH)).astype(np.float32)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The packed bag of a text."""
    return packed(*counts(text))


@dataclass
class Model:
    """``margin`` of each bucket; both classes' scores differ by ``bias`` and, weighted, the margins' mean over the text and the highest over a passage."""

    margin: np.ndarray
    bias: float
    mean: float = 1.0
    peak: float = 0.0

    def means(self, text: str | None) -> tuple[float, float]:
        """The mean of the text and the highest of its passages."""
        total, count, peak = 0.0, 0, -np.inf
        last = np.zeros((2, 1))  # the cell before the block
        for keys, places, room in placed(text):
            cells, size = places // CELL, -(-room // CELL)
            both = np.concatenate([last, [np.bincount(cells, self.margin[keys], size), np.bincount(cells, minlength=size)]], axis=1)
            total += float(both[0, 1:].sum())
            count += len(keys)
            passages = both[:, 1:] + both[:, :-1]
            passages = passages[:, passages[1] > 0]
            peak = max(peak, float((passages[0] / (passages[1] + PASSAGE_SMOOTH)).max(initial=-np.inf)))
            last = both[:, -1:]
        return total / (count + SMOOTH), peak if count else 0.0

    def score(self, text: str | None) -> float:
        mean, peak = self.means(text)
        z = self.bias + self.mean * mean + self.peak * peak
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    def weighed(self, means: list, labels: list[int]) -> Model:
        """This model with bias and weights of the two means fitted by Newton's method to texts it has not seen; itself if they are too few."""
        y = np.asarray(labels, float)
        if min(y.sum(), (1 - y).sum()) < ASIDE_ROWS or not self.margin.any():
            return self
        x = np.asarray(means, float)
        middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = np.column_stack([(x - middle) / spread, np.ones(len(x))])
        pull, w = np.array([0.01, 0.01, 0.01]), np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
            w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        mean, peak = w[:2] / spread
        return Model(self.margin, float(w[2] - middle @ (mean, peak)), float(mean), float(peak))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """A model of texts in memory; one text in ``ASIDE`` weighs the two means."""
    aside = np.random.default_rng(seed).permutation(len(texts)) % ASIDE == 1
    model = learn([bag(t) for t, a in zip(texts, aside) if not a], [v for v, a in zip(labels, aside) if not a], epochs, seed)
    return model.weighed([model.means(t) for t, a in zip(texts, aside) if a], [v for v, a in zip(labels, aside) if a])


def learn(bags: list, labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Joint training by Adam on log loss. With one class only, or no rows, scores are constant."""
    y = np.asarray(labels, int)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0))
    rng = np.random.default_rng(seed)
    prior = y.mean()
    weights = {"e": rng.standard_normal((BUCKETS, DIM), np.float32) * np.float32(0.05), "w": rng.normal(0, 0.05, (DIM, 2)).astype(np.float32), "b": np.log(np.array([1 - prior, prior], np.float32))}
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros((() if k == "e" else v.shape), np.float32) for k, v in weights.items()}
    step = 0
    epochs = max(epochs, -(-STEPS * BATCH // len(y)))
    scale = np.float32(200)  # word shares are small numbers
    seen, column = np.zeros(BUCKETS, bool), np.zeros(BUCKETS, np.int32)  # the buckets of a batch and their columns
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            parts = [shares(*bags[r]) for r in rows]
            held = np.concatenate([at for at, _ in parts])
            seen[held] = True
            used = np.flatnonzero(seen)
            column[used] = np.arange(len(used))
            place = column[held]
            seen[used] = False
            x = np.zeros((len(rows), len(used)), np.float32)
            x[np.repeat(np.arange(len(rows)), [len(at) for at, _ in parts]), place] = np.concatenate([share for _, share in parts]) * scale
            embedded = weights["e"].take(used, axis=0)
            mean = x @ embedded
            z = mean @ weights["w"] + weights["b"]
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            step += 1
            rate = np.float32(RATE * (1 - 0.9 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step))
            for name, grad, at, old in (("w", mean.T @ p, slice(None), weights["w"]), ("b", p.sum(axis=0), slice(None), weights["b"]), ("e", x.T @ (p @ weights["w"].T), used, embedded)):
                # one second moment for all embeddings: a rare n-gram must not move as far as a telling one
                size = np.float32((grad * grad).sum() / weights["e"].size * SPREAD) if name == "e" else grad * grad
                moment = np.float32(0.9) * first[name][at] + np.float32(0.1) * grad
                first[name][at] = moment
                second[name] = (0.999 * second[name] + 0.001 * size).astype(np.float32)
                new = old - moment * (rate / (np.sqrt(second[name]) + np.float32(1e-8)))
                weights[name][at] = new * np.float32(1 - rate * DECAY) if name == "e" else new
    diff = weights["w"][:, 1] - weights["w"][:, 0]
    return Model((weights["e"] @ diff * scale).astype(np.float32), float(weights["b"][1] - weights["b"][0]))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train on a bounded sample of the rows of ``labels`` that ``learnable`` (over the key) admits.

    Rows without a label, key or text are left out, long texts are not: those
    over ``SAMPLE_CHARS`` are counted where they lie and take the driver no more
    than a number a bucket. The sample is broadcast to the texts, of which only its rows are shuffled.
    Of a repeated key one row is taken.
    The bias stays that of the sample, in which toxic rows are more frequent:
    fewer of them are missed, and hardly more clean ones flagged.
    """
    rows = labels.filter(learnable).filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), (F.col(label) > 0).cast("int").alias("label"))
    # one row a key, of several the toxic label and the text with the least hash
    rows = stratified(rows, "key", "label", SAMPLE, classes=2).groupBy("key").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(key).alias("t_key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    found = texts.join(F.broadcast(rows), F.col("key") == F.col("t_key")).groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    aside = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("aside")), F.lit(ASIDE)) == 0

    @F.pandas_udf(T.BinaryType())
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else np.concatenate(counts(t)).tobytes() for t in texts], dtype=object)

    long = F.length("text") > SAMPLE_CHARS
    sent = found.filter(~aside).select("key", "label", F.when(~long, F.col("text")).alias("text"), counted(F.when(long, F.col("text"))).alias("bag"))
    # a partition at a time, so that the driver never holds the texts of all
    got = [(k, v, bag(text) if data is None else packed(*np.split(np.frombuffer(data, np.uint32), 2))) for k, v, text, data in sent.toLocalIterator()]
    got.sort(key=lambda row: row[:2])
    model = learn([b for _, _, b in got], [v for _, v, _ in got])
    got = found.filter(aside).select("key", "label", _means(docs.sparkSession, model)("text").alias("m")).collect()
    got = sorted((key, v, m.mean, m.peak) for key, v, m in got)
    return model.weighed([(mean, peak) for _, _, mean, peak in got], [v for _, v, _, _ in got])


def _means(spark, model: Model):
    sent = spark.sparkContext.broadcast((model.margin, model.bias))

    @F.pandas_udf("mean double, peak double")
    def means(texts: pd.Series) -> pd.DataFrame:
        own = Model(*sent.value)
        return pd.DataFrame([own.means(t) for t in texts], columns=["mean", "peak"], dtype="float64")

    return means


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add ``out``, 0 to 1. Null, empty and blank texts, and those of one-byte words alone, get the score of the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast((model.margin, model.bias, model.mean, model.peak))

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        own = Model(*sent.value)
        return pd.Series([own.score(t) for t in texts], dtype="float64")

    return docs.withColumn(out, score(F.col(text)))
