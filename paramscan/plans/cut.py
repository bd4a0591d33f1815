"""Lineage cut in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that the session names in ``spark.checkpoint.dir``.

    Where none is named, a temporary folder, removed when the driver ends,
    serves a local session; on a cluster, whose executors would each write to a disk of their own, it is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not folder:
            folder = tempfile.mkdtemp(prefix="paramscan-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def discard(*frames: DataFrame) -> None:
    """Delete the files of checkpointed frames that nothing reads any more."""
    for df in frames:
        written = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if written.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(written.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
