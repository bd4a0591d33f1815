"""Selecting files from manifests: one checksum for each path, contradictions found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SelectionError
from ..functions.checksums import cleaned, is_valid


def identified(rows: DataFrame) -> DataFrame:
    """``(ord, path, algorithm, checksum)`` of rows with optional ``sha1``, or ``checksum`` and ``checksum_algorithm``."""
    none = F.lit(None).cast("string")
    sha1 = cleaned(F.col("sha1")) if "sha1" in rows.columns else none
    value = cleaned(F.col("checksum")) if "checksum" in rows.columns else none
    algorithm = F.lower(cleaned(F.col("checksum_algorithm"))) if "checksum_algorithm" in rows.columns else none
    algorithm = F.when(sha1.isNotNull(), "sha1").when(value.isNotNull(), F.coalesce(algorithm, F.lit("sha1")))
    return rows.select("ord", "path", algorithm.alias("algorithm"), F.coalesce(sha1, value).alias("checksum"))


def merged(selection: DataFrame) -> DataFrame:
    """One row per path: first place, its checksum if any names one, and how many different ones there are."""
    identity = F.when(F.col("checksum").isNotNull(), F.struct(F.lower("algorithm").alias("algorithm"), F.lower("checksum").alias("checksum")))
    rows = selection.select("ord", "path", identity.alias("id"))
    grouped = rows.groupBy("path").agg(F.min("ord").alias("ord"), F.min("id").alias("id"), F.max("id").alias("other"))
    differs = F.col("id").isNotNull() & (F.col("id") != F.col("other"))
    return grouped.select("ord", "path", "id.algorithm", "id.checksum", F.coalesce(differs, F.lit(False)).alias("conflict"))


def conflicts(selection: DataFrame) -> DataFrame:
    return merged(selection).filter("conflict").select("path")


def select_files(selection: DataFrame) -> DataFrame:
    """``merged`` in order; raises if a path has two checksums, or one that is no digest of its algorithm."""
    rows = merged(selection)
    bad = rows.filter(F.col("conflict") | F.col("checksum").isNotNull() & ~is_valid(F.col("algorithm"), F.col("checksum"))).orderBy("path").select("path", "conflict").first()
    if bad:
        raise SelectionError(f"{bad.path}: " + ("conflicting checksums" if bad.conflict else "invalid checksum"))
    return rows.drop("conflict").orderBy("ord")


def outcome_summary(outcomes: DataFrame, errors: int = 10) -> DataFrame:
    """One row over ``(ord, path, ok, bytes, error)``: counts, total bytes, and the first errors as text."""
    totals = outcomes.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("bytes"))), F.lit(0)).cast("bigint").alias("total_bytes"))
    listed = outcomes.filter(~F.col("ok")).orderBy("ord").limit(errors).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path", "error"))), lambda e: F.concat_ws(": ", e["path"], e["error"])), "\n").alias("errors"))
    return totals.crossJoin(listed)
