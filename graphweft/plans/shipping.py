"""Sends this package to executors that cannot import it from a path of their own."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Bytes of an Arrow batch, unless the session has set its own; wide rows would make batches of 64 MB.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def ship_package(spark: SparkSession) -> None:
    """Once per application: Spark's file server hands the zipped sources to every Python worker."""
    context = spark.sparkContext
    if context.getConf().get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="graphweft-")) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, source.relative_to(top.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
