"""Manifests kept up to date from a stream of path rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.manifest import keep_last


def upsert_stream(rows: DataFrame, table_path: str, keys: list[str], order: str, checkpoint_dir: str, available_now: bool = True) -> StreamingQuery:
    """Keep in ``table_path`` the last row by ``order`` of each combination of ``keys``.

    Each micro-batch is merged with the current version into a new one, named
    by the batch; a batch that runs again writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = current(spark, table_path, below=number)
        both = batch if before is None else before.unionByName(batch, allowMissingColumns=True)
        keep_last(both, keys, order).write.mode("overwrite").parquet(f"{table_path}/version={number:09d}")

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def versions(spark: SparkSession, table_path: str) -> list[int]:
    """Numbers of the finished versions, through the file system Spark uses for the path."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, table_path: str, below: int | None = None) -> DataFrame | None:
    """The newest finished version (older than ``below``), or None."""
    numbers = [n for n in versions(spark, table_path) if below is None or n < below]
    return spark.read.parquet(f"{table_path}/version={numbers[-1]:09d}") if numbers else None


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and value of ``by``; works on streams and tables."""
    stamped = events.withColumn("_at", F.col(time).cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("_at", late)
    counts = stamped.groupBy(F.window("_at", width).alias("w"), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), by, "n")
