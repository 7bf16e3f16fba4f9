"""Shared pieces: table reads, tables in the cluster's shared folder, Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.plans.folders import delete_folder, own_folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """The planner's size of the input; where it has none, the bytes of the texts."""
    known = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if known < 1 << 45:
        return known
    return int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


#: With this on, Spark deletes the shuffle files of a query when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class SharedTables:
    """Parquet tables of one run in the shared folder. They cut lineage and outlive lost executors.

    A table stands for the shuffles that made it, so their files go as soon as it is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = own_folder(spark, "graphweft")

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            writer.parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        delete_folder(self.spark, f"{self.root}/{name}")


@functools.cache
def _libc():
    try:
        return ctypes.CDLL(None)
    except OSError:
        return None


def give_back() -> None:
    """Returns freed memory to the system; a Python worker outlives its task and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that leaves its worker small."""

    @functools.wraps(run)
    def task(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


#: glibc's numbers of what mallopt sets, while a task reuses memory and afterwards (the most that glibc itself goes to).
_TRIM, _PAD, _MMAP = -1, -2, -3
_REUSING = ((_MMAP, 32 << 20), (_TRIM, 1 << 30), (_PAD, 64 << 20))
_AFTER = ((_TRIM, 64 << 20), (_PAD, 128 << 10))


def reusing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A lean function for mapInArrow that keeps freed memory until it ends: fresh pages for each array cost as much as the work on it."""

    def allow(values):
        change = getattr(_libc(), "mallopt", None)
        if change is not None:
            for what, value in values:
                change(what, value)

    @functools.wraps(run)
    def task(batches):
        allow(_REUSING)
        try:
            yield from run(batches)
        finally:
            allow(_AFTER)

    return lean(task)


def utf8_values(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each string of an Arrow array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).to_pylist()


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the UTF-8 bytes of all strings, bounds of each); a null has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def byte_slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20):
    """Cuts a batch so that each part holds about `limit` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    column = batch.column(text)
    sizes = column.cast(pa.large_binary())
    lengths = np.asarray(pc.fill_null(pc.binary_length(sizes), 0), dtype=np.int64)
    part = np.cumsum(lengths) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    start = 0
    for end in [*cuts.tolist(), batch.num_rows]:
        yield batch.slice(start, end - start)
        start = end
