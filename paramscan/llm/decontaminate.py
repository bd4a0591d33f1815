"""Benchmark decontamination by spaced-seed hashing.

Fixed masks of kept word positions hash every place of a document and of a
benchmark item; masks that skip positions still meet where words were
substituted. A meeting proposes a diagonal, and around it windows of 13 words
are compared word by word: one with a similarity of 0.8 or more confirms the
overlap. The two masks together meet in every 13-word window with at most two
substitutions, which is every window of that similarity. Items of 5 to 12
words have shorter masks by length, which do the same for whole items.
Documents are hashed by these only if the benchmark has such items.

Only DataFrame operations are used. Scale: the benchmark's table of seeds is
broadcast while its words are counted to be few enough, so that documents are
streamed past it in one pass without a shuffle, their word hashes expanded
inside generated code; only confirmed rows are shuffled. A larger benchmark
is joined by shuffled seeds of a few numbers each. There a seed's documents are
spread over ``SALTS`` tasks, each of which gets the benchmark's entries, so that
a passage of a third of all documents is no task of its own; what is still
uneven adaptive execution splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii import let

MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 6, 7))
#: Masks of shorter items, and the numbers of words for which they are needed.
SHORT_MASKS = {(0, 1, 2, 3): tuple(range(5, 13)), (0, 1, 4, 5): (6, 7, 10, 11), (0, 1, 4): (5,), (0, 3, 4): (5,)}
WINDOW = 13
SIMILARITY = 0.8
SHORTEST = 5  # words; shorter items are too common to be evidence
SALTS = 16  # tasks over which the documents of one seed are spread
BROADCAST_WORDS = 400_000  # words of a benchmark whose seeds are broadcast, about 60 MB


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words: runs of letters and digits, in lower case. Null: none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, masks: tuple, items: bool, *carried: str) -> DataFrame:
    """Rows ``(carried, at, seed)``: for each word place and mask that fits there; of items, only the masks for their number of words.

    Masks are looked up by number, so that the generated code stays small enough to be compiled, however many there are.
    """
    n = F.size("h")
    count = len(masks)
    span = min(mask[-1] for mask in masks) + 1
    places = F.when(n >= span, F.sequence(F.lit(0), (n - span + 1) * count - 1))
    rows = df.select(*carried, "h", F.explode(places).alias("_i"))
    rows = rows.withColumns({"_at": F.expr(f"_i div {count}").cast("int"), "_mask": F.col("_i") % count})
    of_mask = lambda values: F.get(F.lit(values), F.col("_mask"))
    rows = rows.filter(F.col("_at") + of_mask([mask[-1] for mask in masks]) < n)
    if items:
        lengths = F.array(*[F.lit(list(SHORT_MASKS.get(mask, (WINDOW,)))) for mask in masks])
        rows = rows.filter(F.array_contains(F.get(lengths, F.col("_mask")), F.least(n, F.lit(WINDOW))))
    # a place before the text is null, which a hash passes over
    kept = [of_mask([mask[k] if k < len(mask) else -(1 << 30) for mask in masks]) for k in range(SHORTEST)]
    seed = F.xxhash64("_mask", *[F.get("h", F.col("_at") + place) for place in kept])
    return rows.select(*carried, "h", F.col("_at").alias("at"), seed.alias("seed"))


def _best(doc: Column, item: Column, shift: Column, first: Column, last: Column) -> Column:
    """The most equal words in a window of the item around its words ``first`` to ``last``, aligned at ``shift`` more; and the window's start."""
    n = F.size(item)
    length = F.least(n, F.lit(WINDOW))
    low = F.greatest(F.lit(0), first - WINDOW + SHORTEST)
    high = F.least(n, last + WINDOW)

    def windows(equal: Column) -> Column:
        def score(s: Column) -> Column:
            return F.struct(F.aggregate(F.slice(equal, s + 1, length), F.lit(0), lambda a, x: a + x).alias("same"), (-(s + low)).alias("start"))

        return F.array_max(F.transform(F.sequence(F.lit(0), high - low - length), score))

    low = F.least(low, n - length)
    equal = F.transform(F.sequence(low, high - 1), lambda p: F.coalesce((F.get(item, p) == F.get(doc, p + shift)).cast("int"), F.lit(0)))
    return let(equal, windows)


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per contaminated document and item: ``key``, ``item``, ``matched``, ``window``, ``similarity``, ``at``.

    ``matched`` of the ``window`` words (13, or the item if it is shorter) are
    equal in the best window, which starts at word ``at`` of the document.
    Documents without an overlap have no row; nor has a null text or an item
    of fewer than five words. Items of equal words each have their row; rows
    with equal key and text share one. Empty tables give no rows.
    """
    items = benchmark.select(F.col(item).alias("item"), word_hashes(F.col(item_text)).alias("h")).filter(F.size("h") >= SHORTEST)
    items = items.withColumn("ikey", F.xxhash64("h"))
    unique = items.groupBy("ikey").agg(F.first("h").alias("h"))
    total, short = items.agg(F.sum(F.size("h")), F.collect_set(F.when(F.size("h") < WINDOW, F.size("h")))).first()
    masks = MASKS + tuple(mask for mask, lengths in SHORT_MASKS.items() if set(lengths) & set(short))
    few = (total or 0) <= broadcast_words
    held = F.broadcast if few else lambda df: df
    seeds = _seeds(unique, masks, True, "ikey").select(F.col("ikey").alias("s_ikey"), F.col("at").alias("iat"), F.col("seed").alias("s_seed"))
    words = unique.select("ikey", F.col("h").alias("ih"))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), word_hashes(F.col(text)).alias("h"))
    if few:
        hits = _seeds(rows, masks, False, "key", "th").join(held(seeds), F.col("seed") == F.col("s_seed"))
        hits = hits.join(held(words), F.col("s_ikey") == F.col("ikey")).withColumns({"shift": F.col("at") - F.col("iat"), "last": F.col("iat")})
    else:
        salted = seeds.withColumn("s_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = _seeds(rows, masks, False, "key", "th").select("key", "th", "at", "seed", F.pmod(F.xxhash64("th", "at"), F.lit(SALTS)).cast("int").alias("salt"))
        found = found.join(salted, (F.col("seed") == F.col("s_seed")) & (F.col("salt") == F.col("s_salt")))
        found = found.select(F.col("key").alias("f_key"), F.col("th").alias("f_th"), "s_ikey", "iat", (F.col("at") - F.col("iat")).alias("shift"))
        found = found.groupBy("f_key", "f_th", "s_ikey", "shift", F.floor(F.col("iat") / SHORTEST)).agg(F.min("iat").alias("iat"), F.max("iat").alias("last"))
        texts = rows.dropDuplicates(["key", "th"])
        hits = found.join(texts, F.col("f_key").eqNullSafe(F.col("key")) & (F.col("f_th") == F.col("th")))
        hits = hits.join(words, F.col("s_ikey") == F.col("ikey"))
    least = F.ceil(F.least(F.size("ih"), F.lit(WINDOW)) * SIMILARITY - 1e-9)
    scored = hits.select("key", "th", "ikey", "shift", F.least(F.size("ih"), F.lit(WINDOW)).alias("window"), least.alias("least"), _best(F.col("h"), F.col("ih"), F.col("shift"), F.col("iat"), F.col("last")).alias("best"))
    good = scored.filter(F.col("best.same") >= F.col("least"))
    # most equal words, then the earliest place, in one number
    code = F.shiftleft(F.col("best.same").cast("long"), 32) + F.lit((1 << 31) - 1) + F.col("best.start") - F.col("shift")
    best = good.groupBy("key", "th", "ikey", "window").agg(F.max(code).alias("code"))
    named = items.select("item", F.col("ikey").alias("n_ikey"))
    named = best.join(held(named), F.col("ikey") == F.col("n_ikey"))
    same = F.shiftright("code", 32).cast("int")
    at = (F.lit((1 << 31) - 1) - F.col("code").bitwiseAND(F.lit((1 << 32) - 1))).cast("int")
    return named.select(F.col("key").alias(key), F.col("item").alias(item), same.alias("matched"), "window", (same / F.col("window")).alias("similarity"), at.alias("at"), "th")


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", **options) -> DataFrame:
    """``overlaps`` by key alone: of equal keys with different texts the better match."""
    found = overlaps(docs, benchmark, key=key, item=item, **options)
    return found.groupBy(key, item, "window").agg(F.max("matched").alias("matched")).withColumn("similarity", F.col("matched") / F.col("window"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item."""
    bad = overlaps(docs, benchmark, key, text).select(F.col(key).alias("__key"), F.col("th").alias("__th")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["__key"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == bad["__th"]), "left_anti")


assert all(len(mask) == SHORTEST for mask in MASKS) and math.ceil(WINDOW * SIMILARITY) == WINDOW - 2

#: DuckDB SQL for ``report`` over ``documents`` and ``benchmark``: all equal words, then windows on each diagonal.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM documents),
dw AS (SELECT doc_id, t[i] AS w, i FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM d)),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM benchmark),
bw AS (SELECT item_id, t[j] AS w, j FROM (SELECT item_id, t, unnest(range(1, len(t) + 1)) AS j FROM b WHERE len(t) >= 5)),
m AS (SELECT doc_id, item_id, i - j AS shift, j FROM dw JOIN bw USING (w)),
c AS (
  SELECT doc_id, item_id, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS same
  FROM m QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, shift) >= 4)
SELECT doc_id, item_id, CAST(least(13, len(b.t)) AS INTEGER) AS "window", CAST(max(same) AS INTEGER) AS matched, max(same) / least(13, len(b.t)) AS similarity
FROM c JOIN b USING (item_id) GROUP BY doc_id, item_id, b.t HAVING max(same) >= ceil(least(13, len(b.t)) * 0.8 - 1e-9)
"""
