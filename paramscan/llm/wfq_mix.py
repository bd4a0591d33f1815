"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash. Every copy of a document gets
a virtual finish time, the source's cumulative words up to and including it
divided by the source's target, later copies following after a whole pass.
Copies are range-sorted by that time over the whole corpus and truncated at the
total budget; what is before the cut is the mix.

Only DataFrame operations are used. Scale: after one scan the work is on rows
of a few numbers. Both orders, that in each source and that of all copies, are
cut into ranges of some ten thousand rows: sums are taken in each range and
shifted by those of the ranges before it, so no source, key or group of copies,
however large, meets in one task. Of the ranges of copies only the one in which
the budget ends is put in order, since those below it are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, discard

WEIGHTS = (5, 2, 1)
REPEATS = 3
RANGE_ROWS = 20_000  # of an order that one task sums up, about
RANGES = 20_000  # of an order at most; with more rows than that, ranges are larger
SMALL = 20_000  # rows of a table by source or range that are broadcast, or ordered by one task


def words(text: Column) -> Column:
    """Number of runs of characters other than space and the controls 9 to 13; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def ranges_of(rows: int) -> int:
    return max(1, min(RANGES, -(-rows // RANGE_ROWS)))


def _placed(df: DataFrame, order: list[Column], ranges: int, written: list) -> DataFrame:
    """``df`` range-sorted into ``ranges``, numbered by ``_range``; written, so that the numbers stay."""
    written.append(checkpoint(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())))
    return written[-1]


def _running(df: DataFrame, order: list[Column], value: str, out: str, ranges: int, written: list, by: str | None = None, groups: int = 0) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows up to each in ``order``, which ``by``, one of at most ``groups`` values, comes first in.

    Checkpoints that the result reads are added to ``written``.
    """
    to_row = (Window.unboundedPreceding, Window.currentRow)
    by = [by] if by else []
    if ranges == 1:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(*by or [F.lit(0)]).orderBy(*order).rowsBetween(*to_row)))
    placed = _placed(df, order, ranges, written)
    sums = placed.groupBy("_range", *by).agg(F.sum(value).alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*by or [F.lit(0)]).orderBy("_range").rowsBetween(*to_row)) - F.col("_s")
    sums = sums.select(F.col("_range").alias("_r"), *[F.col(c).alias("_by") for c in by], before.alias("_before"))
    same = placed["_range"] == sums["_r"]
    for c in by:
        same = same & placed[c].eqNullSafe(sums["_by"])
    joined = placed.join(F.broadcast(sums) if ranges + groups <= SMALL else sums, same)
    within = F.sum(value).over(Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(*to_row))
    return joined.withColumn(out, within + F.col("_before")).select(*df.columns, out)


def targets(sources: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS, written: list | None = None) -> DataFrame:
    """Add ``target`` to one row per source ``(source, source_size, ...)``.

    Weights repeat over the sources by code point, null last. Sources share
    the sum of all sizes by weight; none gets more than ``repeats`` times its
    size, and what is over goes to the others by weight until all fit. Taken
    in order of cap to weight, the common level is the largest share per
    weight that the first source not held by its cap allows. Checkpoints that
    the result reads are added to ``written``.
    """
    written = [] if written is None else written
    count, total = sources.agg(F.count("*"), F.sum("source_size")).first()
    ranges = 1 if count <= SMALL else ranges_of(count)
    named = F.col("source").asc_nulls_last()
    ranked = _running(sources.withColumn("one", F.lit(1)), [named], "one", "rank", ranges, written)
    cycle = F.array(*[F.lit(w).cast("double") for w in weights])
    weighed = ranked.withColumns({"weight": F.get(cycle, ((F.col("rank") - 1) % len(weights)).cast("int")), "cap": F.lit(repeats) * F.col("source_size")})
    weighed = weighed.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = [F.col("ratio"), named]
    weighed = _running(_running(weighed, by_ratio, "cap", "caps", ranges, written), by_ratio, "weight", "weights", ranges, written)
    all_weight = F.lit(weighed.agg(F.sum("weight")).first()[0])
    level = (F.lit(total) - (F.col("caps") - F.col("cap"))) / (all_weight - (F.col("weights") - F.col("weight")))
    level = weighed.select(level.alias("level"), "ratio").filter("level <= ratio").agg(F.max("level")).first()[0]
    return weighed.select(*sources.columns, F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def _cut(copies: DataFrame, order: list[Column], ranges: int, budget: int):
    """The copy in which the budget ends, with the words it still gives as ``part``; None if all fit."""
    written: list = []
    placed = _placed(copies, order, ranges, written)
    to_row = (Window.unboundedPreceding, Window.currentRow)
    sums = placed.groupBy("_range").agg(F.sum("size").alias("s"))
    sums = sums.withColumn("upto_range", F.sum("s").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(*to_row)))
    hit = sums.filter(F.col("upto_range") >= budget).orderBy("_range").first()
    if hit is None:
        discard(*written)
        return None
    left = F.lit(budget - (hit["upto_range"] - hit["s"]))
    within = placed.filter(F.col("_range") == hit["_range"])
    within = within.withColumn("reach", F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(*to_row)))
    last = within.filter(F.col("reach") >= left).withColumn("part", left - (F.col("reach") - F.col("size"))).orderBy("reach").first()
    discard(*written)
    return last


def mix(docs: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, ``size``, ``source_size``, ``target``, ``taken``.

    ``taken`` counts the words the mix takes from the row over all passes, at
    most ``repeats`` times its size; the document in which the budget ends
    gives a part. Null and blank texts have size 0 and give nothing; a null
    source is a source of its own; rows alike in every column are separate
    documents. Null and repeated keys are told apart by their texts. An empty
    table gives no rows. Other columns are not read.
    """
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    th = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    # rows alike in every column may be taken in any order; numbers keep them from being one range
    alike = F.xxhash64(F.monotonically_increasing_id())
    rows = checkpoint(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words(F.col(text)).alias("size"), h.alias("h"), th.alias("th"), alike.alias("alike")))
    written = [rows, checkpoint(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))]
    sources = checkpoint(targets(written[1], weights, repeats, written))
    written.append(sources)
    groups, count, budget = sources.agg(F.count("*"), F.sum("n"), F.sum("source_size")).first()
    ranges = ranges_of(count or 0)
    shuffled = [F.col("source").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("h", "th", "key", "size", "alike")]]
    rows = _running(rows, shuffled, "size", "upto", ranges, written, "source", groups)
    plan = sources.select(F.col("source").alias("t_source"), "source_size", "target")
    rows = rows.join(F.broadcast(plan) if groups <= SMALL else plan, F.col("source").eqNullSafe(F.col("t_source")))
    rows = checkpoint(rows.select("key", "source", "size", "source_size", "target", "upto"))
    discard(*written)

    def finish(copy: Column) -> Column:
        """Virtual finish time of a copy; null where the copy starts at or after the target."""
        start = copy * F.col("source_size") + F.col("upto") - F.col("size")
        return F.when((F.col("size") > 0) & (start < F.col("target")), (start + F.col("size")) / F.col("target"))

    copies = rows.select("source", "size", "source_size", "target", "upto", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy"))
    copies = copies.withColumn("finish", finish(F.col("copy"))).filter("finish is not null").select("finish", "source", "upto", "size")
    # within a source a document's words so far tell it apart, and times are never equal
    cut = _cut(copies, [F.col("finish"), F.col("source").asc_nulls_last(), F.col("upto")], ranges, budget or 0)
    taken = F.lit(0).cast("long")
    for copy in range(repeats):
        at = finish(F.lit(copy))
        gives = F.when(at.isNotNull(), F.col("size"))
        if cut is not None:
            of_cut = F.col("source").eqNullSafe(F.lit(cut["source"]))
            first = F.col("source").isNotNull() if cut["source"] is None else F.coalesce(F.col("source") < F.lit(cut["source"]), F.lit(False))
            tie = at == F.lit(cut["finish"])
            gives = F.when(tie & of_cut & (F.col("upto") == cut["upto"]), F.lit(cut["part"])).when((at < F.lit(cut["finish"])) | tie & (first | of_cut & (F.col("upto") < cut["upto"])), F.col("size"))
        taken = taken + F.coalesce(gives, F.lit(0)).cast("long")
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", taken.alias("taken"))


#: DuckDB SQL for ``mix`` over ``documents`` with the default parameters; the sort runs over all copies there.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h, md5(coalesce(text, '')) AS th
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size AS cap,
         (CAST(sum(source_size) OVER () AS BIGINT)
          - (CAST(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) - 3 * source_size))
         / CAST(sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM s),
l AS (SELECT max(level) AS level FROM r WHERE level <= cap / w),
t AS (SELECT r.source, r.source_size, least(CAST(r.cap AS DOUBLE), r.w * l.level) AS target FROM r, l),
c AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, d.h, d.th,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(d.h, 1, 15), d.th, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto,
         row_number() OVER () AS rid
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT c.*, k, (k * source_size + upto) / target AS finish
  FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE size > 0 AND k * source_size + upto - size < target),
f AS (
  SELECT rid, size, CAST(sum(size) OVER (ORDER BY finish, source NULLS LAST, substr(h, 1, 15), th, doc_id NULLS LAST, k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto,
         (SELECT CAST(sum(size) AS BIGINT) FROM d) AS budget
  FROM e),
g AS (SELECT rid, CAST(sum(greatest(0, least(size, budget - (upto - size)))) AS BIGINT) AS taken FROM f GROUP BY rid)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(g.taken, 0) AS taken FROM c LEFT JOIN g USING (rid)
"""
