"""Token counts under a unigram model by dynamic programming shared over a trie.

The vocabulary is a public tokenizer's byte pieces with their ranks; by Zipf's
law a piece of rank r has log probability -ln(r + 1) up to a constant, and a
pre-token's tokens are its most probable split.

The distinct pre-tokens of a batch of texts make a trie, walked depth first:
taken in byte order, each goes on from where it leaves the path of the one
before. So each node's forward score, the best split of the prefix it stands
for, is computed once, however many pre-tokens share the prefix and however
long they are, and only one path is ever in memory. Terminal counts are stored
by pre-token.

Texts are counted whole where they lie, without a shuffle. A worker keeps
terminal counts from batch to batch, up to a fixed number; beyond it only those
of the batch at hand stay, so frequent pre-tokens are hardly ever counted anew.
"""

from __future__ import annotations

import base64
import math
from array import array
from itertools import islice

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's public pre-token pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT = 400_000  # pre-tokens whose counts a worker keeps
BATCH = 1 << 21  # characters of texts whose distinct pre-tokens make one trie; a longer text is a batch of its own
NEAR = 64  # places of the path, from the root, whose begun pieces are kept
SLICE = 1 << 19  # pre-tokens of one text that are held at once


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, float]:
    """Log probability of each piece of a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): -math.log(int(b) + 1) for a, b in (line.split() for line in lines if line.strip())}


class Counter:
    """Numbers of tokens of pre-tokens."""

    def __init__(self, vocabulary: dict[bytes, float]):
        # vocabulary trie: a state holds the states behind its bytes, and under -1 the log probability of the piece that ends there
        self.root: dict = {}
        for piece, value in vocabulary.items():
            state = self.root
            for byte in piece:
                state = state.setdefault(byte, {})
            state[-1] = value
        self.longest = max(map(len, vocabulary), default=0)
        self.known: dict[str, int] = {}

    def learn(self, wanted: set[str]) -> None:
        """Make the counts of ``wanted`` known."""
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > KEPT:
            self.known = {token: self.known[token] for token in wanted.difference(new)}
        self.known.update(self.walk({token.encode("utf-8", "surrogatepass"): token for token in new}))

    def walk(self, tokens: dict[bytes, str]):
        """``(pre-token, count)`` of each, in byte order; only what is not shared with the one before is computed.

        A place of the path has the best split up to it, as score and number of
        pieces, and the pieces begun but not ended there. The latter are large:
        far from the root they are found again where a pre-token branches off.
        """
        root, last = self.root, b""
        scores, counts, begun = array("d", [0.0]), array("q", [0]), [[(root, 0.0, 0)]]
        for data in sorted(tokens):
            shared = _shared(last, data)
            del scores[shared + 1 :], counts[shared + 1 :], begun[shared + 1 :]
            at = begun[shared] if shared < len(begun) else self.begun_at(data, shared, scores, counts)
            for byte in data[shared:]:
                best, pieces, still = -math.inf, 0, []
                for state, score, count in at:
                    state = state.get(byte)
                    if state is None:
                        continue
                    still.append((state, score, count))
                    value = state.get(-1)
                    if value is not None:
                        value += score
                        if value > best or value == best and count < pieces - 1:
                            best, pieces = value, count + 1
                if best > -math.inf:
                    still.append((root, best, pieces))
                if len(begun) == len(scores) < NEAR:
                    begun.append(still)
                scores.append(best)
                counts.append(pieces)
                at = still
            last = data
            yield tokens[data], counts[-1]

    def begun_at(self, data: bytes, place: int, scores: array, counts: array) -> list[tuple]:
        """The pieces begun before ``place`` and not ended there."""
        out = []
        for start in range(max(0, place - self.longest), place + 1):
            state = self.root if scores[start] > -math.inf else None
            for byte in data[start:place]:
                state = state.get(byte) if state is not None else None
            if state is not None:
                out.append((state, scores[start], counts[start]))
        return out

    def count(self, texts: list[str | None], pattern: regex.Pattern) -> list[tuple[int, int]]:
        """Numbers of pre-tokens and of tokens of each text."""
        out, batch, size = [], [], 0
        for text in texts:
            if text and len(text) > BATCH:
                out += [*self.batch(batch), self.large(m[0] for m in pattern.finditer(text))]
                batch, size = [], 0
                continue
            batch.append(pattern.findall(text) if text else [])
            size += len(text or "")
            if size > BATCH:
                out += self.batch(batch)
                batch, size = [], 0
        return out + self.batch(batch)

    def batch(self, lists: list[list[str]]) -> list[tuple[int, int]]:
        self.learn(set().union(*lists))
        return [(len(tokens), sum(map(self.known.__getitem__, tokens))) for tokens in lists]

    def large(self, tokens) -> tuple[int, int]:
        """Of one text, a slice of its pre-tokens at a time."""
        words = total = 0
        while some := list(islice(tokens, SLICE)):
            (n, count), = self.batch([some])
            words, total = words + n, total + count
        return words, total


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


RESULT = T.StructType([T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])


def with_token_counts(docs: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Add ``out``: a struct of ``n_pretokens`` and ``n_tokens``. Null and empty texts have 0 of both.

    Bytes that no piece holds would leave a pre-token without a split, with
    count 0; vocabularies with all single bytes, like the default, have none.
    """
    sent = docs.sparkSession.sparkContext.broadcast({"vocabulary": read_vocabulary(vocabulary)})

    @F.pandas_udf(RESULT)
    def count(texts: pd.Series) -> pd.DataFrame:
        # a worker process keeps the broadcast value, and so the counts, for all its tasks
        counter = sent.value.get("counter")
        if counter is None:
            counter = sent.value["counter"] = Counter(sent.value["vocabulary"])
        rows = counter.count(list(texts), regex.compile(pattern))
        return pd.DataFrame(rows, columns=["n_pretokens", "n_tokens"])

    return docs.withColumn(out, count(F.col(text)))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: ``key``, ``n_pretokens``, ``n_tokens``. Null and empty texts have 0 of both; repeated rows have each its own; an empty table gives none."""
    rows = with_token_counts(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "tokens", vocabulary)
    return rows.select(F.col("key").alias(key), "tokens.n_pretokens", "tokens.n_tokens")
