"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _made:
        _made[context.applicationId] = tempfile.mkdtemp(prefix="graphweft-")
        context.setCheckpointDir(_made[context.applicationId])
    return _made[context.applicationId]


def delete_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new name in the shared folder, deleted when the process ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"

    def clear() -> None:
        try:
            if spark.sparkContext._jsc is not None:
                delete_folder(spark, path)
        except Exception:  # the session may be gone at exit
            return

    atexit.register(clear)
    return path
