"""Differences of two path tables: what was added, changed, deleted, is missing or must move.

Both sides are ``(path, sha1)``. Every join is on the path, so sides that are
bucketed or partitioned by it are joined where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def staged_changes(head: DataFrame, staged: DataFrame) -> DataFrame:
    """``(label, path)``: added, deleted or modified between head and staged."""
    a, b = head.select("path", F.col("sha1").alias("a")), staged.select("path", F.col("sha1").alias("b"))
    label = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return a.join(b, "path", "full_outer").select(label.alias("label"), "path").filter("label is not null")


def untracked(files: DataFrame, staged: DataFrame) -> DataFrame:
    return files.select("path").join(staged.select("path"), "path", "left_anti")


def missing_objects(needed: DataFrame, stored: DataFrame, key: str = "sha1") -> DataFrame:
    return needed.select(key).filter(F.col(key).isNotNull()).distinct().join(stored.select(key), key, "left_anti")


def worktree_changes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``(label, path)``: deleted where there is no file, modified where its digest differs in any case of letters."""
    a, b = expected.select("path", F.lower("sha1").alias("a")), actual.select("path", F.lower("sha1").alias("b"))
    label = F.when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return a.join(b, "path", "left").select(label.alias("label"), "path").filter("label is not null")


def files_to_store(staged: DataFrame, head: DataFrame, stored: DataFrame) -> DataFrame:
    """Staged rows that head lacks, by path and digest, or whose object is not in the store."""
    new = staged.select("path", F.lower("sha1").alias("sha1"))
    known = head.select("path", F.lower("sha1").alias("sha1")).distinct().withColumn("_known", F.lit(True))
    there = stored.select(F.lower("sha1").alias("sha1")).distinct().withColumn("_there", F.lit(True))
    return new.join(known, ["path", "sha1"], "left").join(there, "sha1", "left").filter("_known is null or _there is null").select("path", "sha1")


def checkout_plan(current: DataFrame, target: DataFrame, present: DataFrame) -> DataFrame:
    """``(action, path, sha1)`` of an incremental checkout.

    ``install`` where the target differs from the current row or has none,
    ``remove`` where the target lacks a current path, ``conflict`` where a
    target path is not tracked now but a file with another digest is there.
    """
    c, t = current.select("path", F.lower("sha1").alias("c")), target.select("path", F.lower("sha1").alias("t"))
    p = present.select("path", F.lower("sha1").alias("p"))
    both = c.join(t, "path", "full_outer").join(p, "path", "left")
    action = (
        F.when(F.col("t").isNull(), "remove")
        .when(F.col("c").isNull() & F.col("p").isNotNull() & (F.col("p") != F.col("t")), "conflict")
        .when(F.col("c").isNull() | (F.col("c") != F.col("t")), "install")
    )
    return both.select(action.alias("action"), "path", F.coalesce("t", "c").alias("sha1")).filter("action is not null")


def deepest_first(paths: DataFrame) -> DataFrame:
    """Paths so that children come before their parents."""
    return paths.orderBy(F.desc(F.size(F.split("path", "/"))), F.desc("path"))
