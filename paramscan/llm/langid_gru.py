"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrences, one from each end, read the UTF-8 bytes of a lower-cased text,
words, spaces, digits and marks alike; a softmax over both states labels every
position. A document's probabilities are the mean over all its positions. The
network is trained in numpy by backpropagation through time on a bounded
sample, on the driver.

Texts are read whole where they lie, without a shuffle. So that a long text
takes no more steps than a short one, it is read in windows whose recurrences
begin ``LEAD`` bytes outside of them, on either side. Zero bytes, with which
what lies beyond a text's ends is filled, clear the states. Windows of all texts
of a batch are run together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stratified

HIDDEN = 12
SPAN = 512  # positions of a window, at most
STEP = 64  # windows are as long as the next multiple of this
LEAD = 24  # bytes before and behind a window with which its recurrences begin
CELLS = 1 << 21  # positions times languages that are run together, about
SAMPLE = 250  # documents of each language, about
SAMPLE_CHARS = 4_000  # characters of each document that the sample holds, from a place set by its hash
LANGUAGES = 400  # learned at most, the most frequent ones
STEPS = 300
BATCH = 256
TRAIN_SPAN = 32
RATE = 0.015
UNKNOWN = "und"

LETTER = regex.compile(r"\p{L}")


def windows(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """``(positions, bytes)`` of each window of a text: ``LEAD`` bytes, the window's, filled to a multiple of ``STEP``, and ``LEAD`` more."""
    zeros = b"\0" * LEAD
    for at in range(0, len(data), SPAN):
        count = min(SPAN, len(data) - at)
        size = -(-count // STEP) * STEP
        before = data[max(0, at - LEAD) : at]
        piece = zeros[len(before) :] + before + data[at : at + size + LEAD]
        yield count, np.frombuffer(piece.ljust(size + 2 * LEAD, b"\0"), np.uint8)


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * a)


def _softmax(logits: np.ndarray, axis: int) -> np.ndarray:
    logits -= logits.max(axis=axis, keepdims=True)
    p = np.exp(logits, out=logits)
    p /= p.sum(axis=axis, keepdims=True)
    return p


@dataclass
class Network:
    """Weights by name: ``x`` (256 x 3H), ``u`` (H x 3H) of each direction, ``v`` (2H x C), ``c``."""

    languages: list[str]
    weights: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        h, n = HIDDEN, len(languages)
        shapes = {"fx": (256, 3 * h), "fu": (h, 3 * h), "bx": (256, 3 * h), "bu": (h, 3 * h), "v": (2 * h, n), "c": (n,)}
        return cls(languages, {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in shapes.items()})

    def run(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States after each step, (steps x lanes x H). ``keep`` gets what the way back needs."""
        wx, wu, h = self.weights[way + "x"], self.weights[way + "u"], HIDDEN
        state = np.zeros((x.shape[1], h), wx.dtype)
        out = np.empty((*x.shape, h), wx.dtype)
        for t in range(len(x)):
            a, u = wx[x[t]], state @ wu
            zr = _sigmoid(a[:, : 2 * h] + u[:, : 2 * h])
            z, r, un = zr[:, :h], zr[:, h:], u[:, 2 * h :]
            n = np.tanh(a[:, 2 * h :] + r * un)
            if keep is not None:
                keep.append((state, z, r, un, n))
            state = (n + z * (state - n)) * (x[t] > 0)[:, None]
            out[t] = state
        return out

    def back(self, x: np.ndarray, way: str, kept: list, d_out: np.ndarray) -> dict:
        wu, h = self.weights[way + "u"], HIDDEN
        d_state = np.zeros_like(kept[0][0])
        d_pre = np.empty((*x.shape, 3 * h), wu.dtype)
        d_u = np.zeros_like(wu)
        for t in range(len(x) - 1, -1, -1):
            state, z, r, un, n = kept[t]
            d = (d_out[t] + d_state) * (x[t] > 0)[:, None]
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (state - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            d_pre[t] = np.concatenate([dz, dr, dn], axis=1)
            du = np.concatenate([dz, dr, dn * r], axis=1)
            d_u += state.T @ du
            d_state = d * z + du @ wu.T
        flat, rows = x.ravel(), d_pre.reshape(-1, 3 * h)
        order = np.argsort(flat, kind="stable")
        used, first = np.unique(flat[order], return_index=True)
        d_x = np.zeros_like(self.weights[way + "x"])
        d_x[used] = np.add.reduceat(rows[order], first, axis=0)
        return {way + "x": d_x, way + "u": d_u}

    def positions(self, x: np.ndarray, keep: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Both directions' states and the class probabilities of every position of (steps x lanes) bytes."""
        forward = self.run(x, "f", keep[0] if keep else None)
        backward = self.run(x[::-1], "b", keep[1] if keep else None)[::-1]
        both = np.concatenate([forward, backward], axis=2)
        return both, _softmax(both @ self.weights["v"] + self.weights["c"], 2)

    def gradients(self, x: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> dict:
        """Gradients of the log loss of (lanes) classes, each position of each lane by its weight."""
        keep: tuple = ([], [])
        both, p = self.positions(x, keep)
        p[:, np.arange(len(wanted)), wanted] -= 1
        p *= weight[..., None]
        d_both = p @ self.weights["v"].T
        grads = {"v": np.tensordot(both, p, ((0, 1), (0, 1))), "c": p.sum(axis=(0, 1))}
        grads |= self.back(x, "f", keep[0], d_both[..., :HIDDEN])
        return grads | self.back(x[::-1], "b", keep[1], d_both[::-1, :, HIDDEN:])

    def one_way(self, x: np.ndarray, way: str, out: np.ndarray) -> None:
        """Add one direction's share of the logits of a window's positions to ``out``, (positions x classes x lanes).

        As ``run``, but with lanes last and without the steps behind the window; sigmoids are tanh of half the argument.
        """
        h = HIDDEN
        half = np.repeat(np.array([0.5, 0.5, 1], np.float32), h)
        wx, wu = (self.weights[way + "x"] * half).T.copy(), (self.weights[way + "u"] * half).T.copy()
        v = (self.weights["v"][:h] if way == "f" else self.weights["v"][h:]).T.copy()
        state = np.zeros((h, x.shape[1]), np.float32)
        u = np.empty((3 * h, x.shape[1]), np.float32)
        live = x > 0
        whole = live.all(axis=1)
        for t in range(len(x) - LEAD):
            a = np.take(wx, x[t], axis=1)
            np.dot(wu, state, out=u)
            zr, n = a[: 2 * h], a[2 * h :]
            zr += u[: 2 * h]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            u[2 * h :] *= zr[h:]
            n += u[2 * h :]
            np.tanh(n, out=n)
            state -= n
            state *= zr[:h]
            state += n
            if not whole[t]:
                state *= live[t]
            if t >= LEAD:
                out[t - LEAD] += v @ state

    def sums(self, lanes: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """(windows x classes): probabilities summed over the positions of windows of one size."""
        x = np.array([data for _, data in lanes]).T.copy()
        out = np.empty((len(x) - 2 * LEAD, len(self.languages), len(lanes)), np.float32)
        out[:] = self.weights["c"][:, None]
        self.one_way(x, "f", out)
        self.one_way(x[::-1], "b", out[::-1])
        p = _softmax(out, 1)
        real = np.arange(len(p))[:, None] < np.array([count for count, _ in lanes])
        return np.einsum("tcl,tl->lc", p, real.astype(np.float32), dtype=np.float64)

    def read(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """The best language of each text and its mean probability over all positions."""
        waiting: dict[int, list] = {}
        totals, lengths = [], []

        def flush(size: int) -> None:
            lanes = waiting.pop(size)
            np.add.at(sums, [owner for owner, _ in lanes], self.sums([lane for _, lane in lanes]))

        texts = list(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        for owner, text in enumerate(texts):
            known = text is not None and LETTER.search(text) is not None
            data = text.lower().encode("utf-8", "surrogatepass") if known else b""
            lengths.append(len(data))
            for lane in windows(data):
                size = len(lane[1])
                waiting.setdefault(size, []).append((owner, lane))
                if len(waiting[size]) * size * len(self.languages) >= CELLS:
                    flush(size)
        for size in list(waiting):
            flush(size)
        for p, length in zip(sums, lengths):
            best = int(p.argmax())
            totals.append((self.languages[best], round(float(p[best] / length), 6)) if length else (UNKNOWN, 0.0))
        return totals


def train(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = 5) -> Network:
    """Adam on the mean log loss of the positions of windows drawn from anywhere in the texts; each language is drawn equally often."""
    languages = sorted(set(labels))
    net = Network.fresh(languages)
    data = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    pools = [[d for d, v in zip(data, labels) if v == language and d] for language in languages]
    usable = [k for k, pool in enumerate(pools) if pool]
    if len(languages) < 2 or not usable:
        return net
    rng = np.random.default_rng(seed)
    zeros = b"\0" * LEAD
    pools = [[zeros + d.ljust(TRAIN_SPAN, b"\0") + zeros for d in pool] for pool in pools]
    size = TRAIN_SPAN + 2 * LEAD
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        classes = rng.choice(usable, BATCH)
        drawn = [pools[k][rng.integers(len(pools[k]))] for k in classes]
        starts = [rng.integers(len(d) - size + 1) for d in drawn]
        x = np.frombuffer(b"".join(d[s : s + size] for d, s in zip(drawn, starts)), np.uint8).reshape(BATCH, size).T
        weight = (x > 0).astype(np.float32)
        weight[:LEAD] = weight[-LEAD:] = 0
        grads = net.gradients(x, classes, weight / max(1.0, weight.sum()))
        rate = RATE * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            net.weights[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """Train on ``SAMPLE_CHARS`` of each of a bounded sample of the rows that ``learnable`` (over the key) admits. None without a language.

    Rows without a language or text are left out; of rows alike in key, text and language one is taken.
    """
    rows = docs.filter(learnable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    start = F.pmod(F.col("th"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    drawn = stratified(rows, ["key", "th"], "lang", SAMPLE, LANGUAGES).select("key", "lang", "th", F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text"))
    got = sorted(map(tuple, drawn.groupBy("key", "lang", "th").agg(F.min("text")).collect()), key=repr)
    return train([t for *_, t in got], [v for _, v, _, _ in got]) if got else None


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def with_language(docs: DataFrame, net: Network | None, text: str = "text", out: str = "language") -> DataFrame:
    """Add ``out``: a struct of ``lang_pred`` and ``score``, the mean probability of that language over all positions.

    Null texts and texts without a letter get ``und`` with score 0, and so do
    all texts if nothing could be learned. An empty table gives no rows, repeated
    rows have each its own. A column named ``out`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net and (net.languages, net.weights))

    @F.pandas_udf(RESULT)
    def language(texts: pd.Series) -> pd.DataFrame:
        found = Network(*sent.value).read(texts) if sent.value else [(UNKNOWN, 0.0)] * len(texts)
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    return docs.withColumn(out, language(F.col(text)))
