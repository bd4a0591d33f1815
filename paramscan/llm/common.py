"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import checkpoint as checkpoint  # cut in the shared folder of spark.checkpoint.dir
from ..plans.cut import discard as discard


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables below ``sf_dir``, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_mod(key: Column, modulus: int) -> Column:
    """crc32 of a key's decimal text modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it, in letters of either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def stratified(df: DataFrame, key: str | list[str], by: str, rows: int | dict, classes: int | None = None) -> DataFrame:
    """About ``rows`` rows (or those of a mapping) of each value of ``by``, chosen by the hash of ``key``: the same ones on every run.

    Values are counted first; one with fewer rows gives all of them. Null
    values give none. If ``classes`` is given, only so many values, the most
    frequent ones, are taken. Rows with equal keys come together.
    """
    counts = df.filter(F.col(by).isNotNull()).groupBy(by).count().orderBy(F.desc("count"), by)
    counts = (counts.limit(classes) if classes else counts).collect()
    if not counts:
        return df.limit(0)
    shares = [(value, min(1.0, (rows[value] if isinstance(rows, dict) else rows) / count)) for value, count in counts]
    keys = [F.col(key)] if isinstance(key, str) else [F.col(k) for k in key]
    drawn = F.pmod(F.xxhash64(*[k.cast("string") for k in keys], F.lit("sample")), F.lit(1_000_000)) / F.lit(1e6)
    of_value = F.create_map(*[F.lit(x) for pair in shares for x in pair])
    return df.filter(drawn < F.coalesce(of_value[F.col(by)], F.lit(-1.0)))
