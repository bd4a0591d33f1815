"""Datasets built from a remote inventory: crawl, match, write one table per target."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import build_entries, remotes
from .operators.detect import STATIC_STEMS, detect_formats
from .operators.match import match_formats
from .plans.spec import FormatSpec
from .sources.remote import crawl, http_get, small_digests
from .sources.tables import dump_yaml, write_tsv


def matched_tables(files: DataFrame, entries: list[dict]) -> tuple[dict[str, DataFrame], DataFrame]:
    """By table name: ``path, checksum_algorithm, checksum`` and the union of its formats' fields; and the files without a format.

    ``files`` is ``(path, algorithm, checksum)``.
    """
    fmts = [e["fmt"] for e in entries]
    found = match_formats(files, fmts).join(files, "path", "left").persist()
    tables: dict[str, DataFrame] = {}
    for db in dict.fromkeys(e["db"] for e in entries):
        numbers = [n for n, e in enumerate(entries) if e["db"] == db]
        fields = list(dict.fromkeys(f for n in numbers for f in FormatSpec.compile(fmts[n]).fields))
        rows = found.filter(F.col("format").isin(numbers)).orderBy("format", "path")
        tables[db] = rows.select("path", F.col("algorithm").alias("checksum_algorithm"), "checksum", *[F.col("values")[f].alias(f) for f in fields if f not in ("path", "checksum", "checksum_algorithm")])
    return tables, found.filter("format is null").select("path", "algorithm", "checksum")


def classify_unmatched(files: DataFrame, digests: DataFrame) -> DataFrame:
    """``(section, name, path, algorithm, checksum)``: ``meta`` where a piece of the stem says so, else static files, named if well known."""
    name = F.element_at(F.split("path", "/"), -1)
    pieces = F.split(F.lower(F.regexp_extract(name, r"^(.+?)(?:\.[^.]*)?$", 1)), r"[._\-]")
    known = F.filter(pieces, lambda x: x.isin(*STATIC_STEMS))
    both = files.join(digests.select("path", F.col("algorithm").alias("a"), F.col("checksum").alias("c")), "path", "left")
    section = F.when(F.array_contains(pieces, "meta"), "meta").otherwise("data")
    return both.select(section.alias("section"), F.get(known, F.lit(0)).alias("name"), "path", F.coalesce("algorithm", "a", F.lit("unknown")).alias("algorithm"), F.coalesce("checksum", "c", F.lit("unknown")).alias("checksum"))


def build(spark: SparkSession, folder: str, remote, entries: list[dict] | None = None, fetch=http_get, overwrite: bool = False) -> dict:
    """Write ``config.yml`` and the tables of a remote dataset into ``folder``; formats are detected if none are given."""
    target = os.path.join(folder, "config.yml")
    if os.path.exists(target) and not overwrite:
        raise FileExistsError(target)
    os.makedirs(folder, exist_ok=True)
    places = remotes(remote)
    files = crawl(spark, places[0]["url"], fetch)
    if entries is None:
        entries = [{"fmt": f, "db": "data"} for f in detect_formats(files.select("path"))]
    entries = build_entries(entries)
    tables, unmatched = matched_tables(files, entries) if entries else ({}, files)
    bare = unmatched.filter("checksum is null").select("path")
    rest = classify_unmatched(unmatched, small_digests(bare, places[0]["url"], None if fetch is http_get else fetch)).orderBy("path")
    for db, rows in tables.items():
        write_tsv(rows, os.path.join(folder, db), null="None")
    static, meta = [], []
    for r in rest.toLocalIterator():
        entry = {"file": r.path, **({"name": r.name} if r.name else {}), r.algorithm if r.algorithm != "unknown" else "checksum": r.checksum}
        (meta if r.section == "meta" else static).append(entry)
    out = {"data": [*static, *entries], "remote": places, "meta": meta}
    dump_yaml(out, target)
    return out
