"""Manifests: rows of checksum and parameters, upserted, replaced, and rendered back to paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import safe_text
from ..plans.cut import checkpoint
from ..plans.spec import FormatSpec


def manifest(frame: DataFrame, fmt: str) -> DataFrame:
    """``sha1`` and the format's fields as text; a field that is not there is null."""
    fields = FormatSpec.compile(fmt).fields
    kinds = {f.name: f.dataType for f in frame.schema}
    if "sha1" not in kinds:
        raise ValueError("a manifest needs a sha1 column")
    return frame.select("sha1", *[(safe_text(F.col(f"`{c}`"), kinds[c]) if c in kinds else F.lit(None).cast("string")).alias(c) for c in fields])


def normalised(frame: DataFrame) -> DataFrame:
    """``sha1`` first, ``path`` dropped, all text, nulls empty."""
    if "sha1" not in frame.columns:
        raise ValueError("data needs a sha1 column")
    names = ["sha1", *[c for c in frame.columns if c not in ("sha1", "path")]]
    return frame.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in names])


def keep_last(rows: DataFrame, keys: list[str], order: str, *ties: str) -> DataFrame:
    """The last row by ``order`` of each group of equal ``keys``, nulls equal; without keys the last row of all."""
    columns = rows.columns
    packed = F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.struct(F.col(order), *[F.col(t) for t in ties]))
    grouped = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(packed.alias("_last")) if keys else rows.agg(packed.alias("_last")).filter("_last is not null")
    return grouped.select("_last.*")


def upsert(state: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Union by name, then the last row of each parameter combination; both carry ``seq``, incoming ones after the state's.

    The combination is every column but ``sha1``. Columns that one side lacks
    are empty there. The result keeps ``seq``, whose order is the table's.
    """
    last = F.coalesce(F.max(seq), F.lit(0))
    offset = state.agg(last.alias("_offset"))
    moved = incoming.crossJoin(F.broadcast(offset)).withColumn(seq, F.col(seq) + F.col("_offset") + 1).drop("_offset")
    both = state.unionByName(moved, allowMissingColumns=True)
    both = both.select(seq, *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in both.columns if c != seq])
    return keep_last(both, [c for c in both.columns if c not in (seq, "sha1")], seq)


def numbered(rows: DataFrame, order: str = "path", seq: str = "seq") -> DataFrame:
    """Add ``seq``, 1 and up in the order of ``order``. Ranges are numbered apart and then shifted, so no task sees all rows.

    The ranges are written: bounds are drawn from a sample, so a second
    evaluation could part them elsewhere.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(rows.repartitionByRange(ranges, F.col(order)).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    shifts = counts.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_shift"))
    placed = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return placed.join(F.broadcast(shifts), F.col("_part") == F.col("_p")).withColumn(seq, (F.col("_at") + F.col("_shift")).cast("bigint")).drop("_part", "_at", "_p", "_shift")


def entries(state: DataFrame, fmt: str) -> DataFrame:
    """``(path, sha1)`` of each manifest row."""
    return state.select(FormatSpec.compile(fmt).render().alias("path"), "sha1")
