import os

import pytest
from pyspark.sql import functions as F

from paramscan.plans import cut


def test_checkpoint_and_discard(spark):
    kept, gone = cut.checkpoint(spark.range(10)), cut.checkpoint(spark.range(5).withColumn("x", F.lit("é")))
    assert gone.count() == 5 and "é" in str(gone.first())
    folder = gone._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(folder)
    cut.discard(gone)
    assert not os.path.exists(folder) and kept.count() == 10


class Context:
    master = "spark://host:7077"
    getCheckpointDir = staticmethod(lambda: None)


class Frame:
    class sparkSession:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda name, other: other)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        cut.checkpoint(Frame)
