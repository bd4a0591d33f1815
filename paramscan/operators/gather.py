"""Which files to download: named paths, manifest tables, files the configuration lists."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import entry_checksum, section
from ..errors import SelectionError
from ..functions.checksums import cleaned
from ..functions.paths import checked_relative, is_safe_relative
from ..plans.spec import FormatSpec
from ..sources.tables import has_malformed_lines, read_tsv
from .select import identified, select_files

SCHEMA = "ord long, path string, algorithm string, checksum string"
STEP = 1 << 40  # places of one source's rows


def remote_paths(rows: DataFrame, formats: list[str]) -> DataFrame:
    """Add ``path`` where it is not known: the first of ``formats`` whose fields the row has all."""
    known = cleaned(F.col("path")) if "path" in rows.columns else F.lit(None).cast("string")
    options = [known]
    for fmt in formats:
        spec = FormatSpec.compile(fmt)
        if set(spec.fields) <= set(rows.columns):
            filled = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in spec.fields], F.lit(True))
            options.append(F.when(filled, spec.render()))
    path = F.coalesce(*options)
    return rows.withColumn("path", F.when(is_safe_relative(path), path).otherwise(F.raise_error(F.concat(F.lit("no safe path for a row: "), F.coalesce(path, F.lit("none"))))))


def gather(spark: SparkSession, folder: str, config: dict, paths: list[str] | None = None, tables: list[str] | None = None, everything: bool = False, data: DataFrame | None = None) -> DataFrame:
    """``(ord, path, algorithm, checksum)`` of a selection, each path once, contradictions raised.

    Named ``paths`` come first, then ``tables`` (all configured ones with
    ``everything``) below ``folder``, then files of the data and meta
    sections. With no request at all, or ``everything`` without tables,
    ``data``, a manifest without paths, is selected.
    """
    parts = []
    if paths:
        rows = [(n, checked_relative(p), None, None) for n, p in enumerate(dict.fromkeys(paths))]
        parts.append(spark.createDataFrame(rows, SCHEMA))
    entries = [e for e in section(config, "data") if e.get("fmt")]
    configured = list(dict.fromkeys(e["db"] for e in entries if e.get("db")))
    wanted = list(dict.fromkeys([*(t if t.lower().endswith(".tsv") else t + ".tsv" for t in tables or []), *(configured if everything else [])]))
    for k, name in enumerate(wanted, 1):
        if name not in configured:
            raise SelectionError(f"{name} is not a table of this dataset")
        full = os.path.join(folder, name)
        if not os.path.isfile(full):
            raise SelectionError(f"{name} does not exist")
        rows = read_tsv(spark, "file://" + full)
        if has_malformed_lines(spark, "file://" + full):
            raise SelectionError(f"{name} cannot be read: a line has more values than the table has columns")
        if len(rows.columns):
            rows = remote_paths(rows, [e["fmt"] for e in entries if e.get("db") == name])
            parts.append(identified(rows.withColumn("ord", F.lit(k * STEP) + F.monotonically_increasing_id() % STEP)))
    if everything:
        listed = [e for part in ("data", "meta") for e in section(config, part) if e.get("file")]
        rows = [((len(wanted) + 1) * STEP + n, checked_relative(e["file"]), *(entry_checksum(e) or (None, None))) for n, e in enumerate(listed)]
        if rows:
            parts.append(spark.createDataFrame(rows, SCHEMA))
    if data is not None and (not parts and not paths and not tables or everything and not wanted):
        parts.append(identified(remote_paths(data, [e["fmt"] for e in entries]).withColumn("ord", F.lit((len(wanted) + 2) * STEP) + F.monotonically_increasing_id() % STEP)))
    return select_files(reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA))
