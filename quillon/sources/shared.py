"""A folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only where it is unset, as in tests on one machine."""
    jsc = spark.sparkContext._jsc.sc()
    set_ = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_:
        return set_.rstrip("/")
    found = jsc.getCheckpointDir()
    if not found.isDefined():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        found = jsc.getCheckpointDir()
    return found.get().rstrip("/")


def fresh_root(spark: SparkSession) -> str:
    """A new path there, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/dataset-{uuid.uuid4().hex}"
    path = path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
