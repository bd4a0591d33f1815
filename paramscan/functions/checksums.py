"""Checksums: digests of contents, validity, strength, cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of each algorithm, strongest first; texts that mean no checksum.
DIGITS = {"sha512": 128, "sha256": 64, "sha1": 40, "md5": 32}
SENTINELS = ("", "none", "nan", "unknown", "<na>")


def digest(content: Column, algorithm: str) -> Column:
    if algorithm not in DIGITS:
        raise ValueError(f"unsupported checksum algorithm: {algorithm!r}")
    return F.md5(content) if algorithm == "md5" else F.sha1(content) if algorithm == "sha1" else F.sha2(content, int(algorithm[3:]))


def is_valid(algorithm: Column, value: Column, allow_unknown: bool = False) -> Column:
    """Hex of the algorithm's length; with ``allow_unknown`` any hex passes for an algorithm that is not known."""
    size = reduce(lambda c, kv: c.when(F.lower(algorithm) == kv[0], kv[1]), list(DIGITS.items())[1:], F.when(F.lower(algorithm) == "sha512", 128))
    fits = F.length(value) == size
    if allow_unknown:
        fits = F.coalesce(fits, F.lit(True))
    return F.coalesce(value.rlike("^[0-9a-fA-F]+$") & fits, F.lit(False))


def cleaned(value: Column) -> Column:
    """Null for the texts that mean no checksum."""
    trimmed = F.trim(value)
    return F.when(~F.lower(trimmed).isin(*SENTINELS), trimmed)


def strongest(columns: dict[str, Column]) -> Column:
    """Struct ``(algorithm, checksum)`` of the strongest algorithm that has a value, or null."""
    found = [F.when(cleaned(columns[a]).isNotNull(), F.struct(F.lit(a).alias("algorithm"), cleaned(columns[a]).alias("checksum"))) for a in DIGITS if a in columns]
    return F.coalesce(*found)


def object_path(sha1: Column) -> Column:
    """Where a content-addressed store keeps an object."""
    return F.concat(F.lit("objects/"), F.substring(F.lower(sha1), 1, 2), F.lit("/"), F.substring(F.lower(sha1), 3, 38))
