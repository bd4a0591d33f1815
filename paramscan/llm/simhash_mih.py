"""SimHash near-duplicate groups by multi-index hashing.

Fingerprints have 64 bits. Two fingerprints that differ in at most 3 bits have
a 32-bit half in which they differ in at most 1 bit, so a table keyed by
``(half, value)`` is probed with each value's Hamming ball of radius 1. A pair
whose half differs in one bit is fetched once: only the member with that bit
set enumerates the ball point. Every fetched candidate's complete distance is
checked inside the join.

Scale: equal fingerprints collapse before candidates are made, so a group of
exact copies costs one entry. Tables hold 8-byte fingerprints and ids, never
texts. A half that more than ``HOT`` fingerprints share is indexed once more:
of the other half, at most 3 bits of which differ, one 16-bit quarter differs in
at most 1 bit, so entries and probes of hot halves go by half and quarter, 48
bits together. All entries under such a key differ in the other 16 bits only.
So neither a key's entries nor a fingerprint's links (those within 3 bits, some
43,000 at most, whatever the corpus) grow with the corpus without bound.

Components are contracted by alternating large-star and small-star rounds, each
written to the shared checkpoint folder; hub vertices are joined against one
pre-aggregated row, which adaptive execution can split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, discard

SHINGLE = 3
SEED = 42
MAX_BITS = 3
HOT = 512  # fingerprints with one half before it is indexed by quarters
BROADCAST_HOT = 1 << 18  # hot halves that are broadcast, 16 bytes each
BLOCK = 1 << 16  # shingles whose bits are unpacked at once


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every ``width``-word shingle of ``text``, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    last = ends[width - 1 :].tolist()
    first = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(first))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned fingerprint: a bit is 1 if it is set in over half of the shingle hashes."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the signed 64-bit fingerprint. Null, empty and blank texts get zero."""
    return docs.withColumn(out, fingerprint_udf(F.col(text)))


def _ball(value: str, bits: int, flip: bool) -> Column:
    """Points of the ball of radius 1 about a value, one a row, as ``(flip, point)`` structs.

    A pair that differs in one bit is to be fetched once, so only the member with
    that bit set goes there.
    """
    flips = [0] + ([1 << i for i in range(bits)] if flip else [])
    points = F.filter(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: (x == 0) | (F.col(value).bitwiseAND(x) != 0))
    return F.explode(F.transform(points, lambda x: F.struct(x.alias("flip"), F.col(value).bitwiseXOR(x).alias("point"))))


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(u, v)`` of distinct fingerprints (column ``fp``) that differ in 1 to ``max_bits`` bits.

    ``max_bits`` is at most 3: each half's ball has radius ``max_bits // 2``.
    A pair may come more than once, from each half and quarter.
    """
    if not 1 <= max_bits <= 3:
        raise ValueError("max_bits must be 1, 2 or 3")
    low = F.col("fp").bitwiseAND(F.lit((1 << 32) - 1))
    high = F.shiftrightunsigned("fp", 32)
    halves = F.array(*[F.struct(F.lit(n).alias("half"), a.alias("value"), b.alias("other")) for n, (a, b) in enumerate([(low, high), (high, low)])])
    entries = fingerprints.select("fp", F.explode(halves).alias("e")).select("fp", "e.*")
    probes = entries.withColumn("b", _ball("value", 32, max_bits > 1)).select(F.col("fp").alias("p"), "half", F.col("b.point").alias("value"), (F.col("b.flip") == 0).alias("same"), F.col("other").alias("p_other"))
    hot = checkpoint(entries.groupBy("half", "value").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("half", "value"))
    many = hot.count()
    if not many:
        return _close(probes.drop("p_other").join(entries.drop("other"), ["half", "value"]), max_bits)
    hot = F.broadcast(hot) if many <= BROADCAST_HOT else hot
    cold = _close(probes.join(entries.join(hot, ["half", "value"], "left_anti"), ["half", "value"]), max_bits)
    quarter = lambda other: F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.shiftrightunsigned(other, 16 * q).bitwiseAND(F.lit(0xFFFF)).alias("qv")) for q in range(2)]))
    fine = entries.join(hot, ["half", "value"], "left_semi").withColumn("e", quarter("other")).select("fp", "half", "value", "e.q", F.col("e.qv").alias("qv"))
    # within a half both members of a pair meet in the ball of either, so here all points are needed
    flips = F.explode(F.array(*[F.lit(x).cast("long") for x in [0] + [1 << i for i in range(16)]]))
    seek = probes.join(hot, ["half", "value"], "left_semi").withColumn("e", quarter("p_other")).withColumn("x", flips)
    seek = seek.select("p", "half", "value", "same", F.col("e.q").alias("q"), F.col("e.qv").bitwiseXOR(F.col("x")).alias("qv"))
    return cold.union(_close(seek.join(fine, ["half", "value", "q", "qv"]), max_bits))


def _close(pairs: DataFrame, max_bits: int) -> DataFrame:
    """Of candidates ``p`` and ``fp``, those whose whole distance is small; of pairs in one bucket each once."""
    near = F.bit_count(F.col("p").bitwiseXOR(F.col("fp"))) <= max_bits
    return pairs.filter(near & F.when(F.col("same"), F.col("p") < F.col("fp")).otherwise(True)).select(F.greatest("p", "fp").alias("u"), F.least("p", "fp").alias("v"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` of every vertex of ``edges(u, v)`` with ``u > v``; the root is the least vertex."""
    edges = checkpoint(edges.select("u", "v").distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        old, edges = edges, checkpoint(small.filter("u != v").distinct())
        discard(old)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def _grouped(docs: DataFrame, key: str, text: str, max_bits: int) -> DataFrame:
    """``(key, fp, root, component_id)`` of each row; the root is the least fingerprint of its component."""
    marked = checkpoint(with_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), out="fp").select("key", "fp"))
    distinct = checkpoint(marked.groupBy("fp").agg(F.min("key").alias("least")))
    linked = components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: ``key``, ``fingerprint`` (16 lowercase hex digits), ``component_id``.

    ``component_id`` is the least non-null key reachable over links of at most
    ``max_bits`` differing bits, the row itself included. Null, empty and blank
    texts share fingerprint zero. A key that repeats with different texts
    belongs to each text's group on its own row. An empty table gives no rows.
    """
    grouped = _grouped(docs, key, text, max_bits)
    return grouped.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the least key.

    Of several rows with that key in the group, the first by the hash of all
    columns stays. A group whose keys are all null keeps one of its rows.
    """
    found = checkpoint(_grouped(docs, key, text, max_bits))
    chosen = found.filter(F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key").alias("c_key"), "fp", "root")
    if found.groupBy("key").count().filter("count > 1 or key is null").isEmpty():
        return docs.join(chosen, docs[key] == chosen["c_key"], "left_semi")
    # rows are carried whole in one column, so that no name of theirs clashes
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).alias("key"), fingerprint_udf(F.col(text)).alias("print"))
    near = rows.join(chosen.distinct(), rows["key"].eqNullSafe(chosen["c_key"]) & (rows["print"] == chosen["fp"]))
    # the least hash of each group, then one of the rows that have it; groups of equal rows are reduced before they are shuffled
    least = near.select("root", "row", F.xxhash64("row").alias("h")).groupBy("root").agg(F.min_by("row", "h").alias("row"))
    return least.select("row.*")
