"""Byte-balanced contiguous shards.

Plan: the sizes are written once as a narrow table, dealt out by ranges of the id, and each range
gets its total. The prefix sum over these few totals (one row per range) places every range in the
whole; a running sum inside each range places its rows. Cuts lie at equal multiples of the total.

Defined results: a null text has 0 bytes and the crc32 of an empty text; a null id sorts first;
repeated rows and ties on the id are all kept, each with its own slot; an empty table gives no
rows; other columns are ignored unless named in ``keep``, where a name of a result column is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedTables, shuffle_partitions


def assign_shards(
    docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Every row with ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``shard`` (0 to n_shards - 1) and ``slot``.

    Shards are contiguous in (id, input order). A row goes to the shard its middle byte falls in, so
    each shard differs from total / n_shards by one row's size at most.
    """
    if clash := {"size", "text_crc32", "shard", "slot"} & set(keep):
        raise ValueError(f"columns of the result cannot be kept too: {sorted(clash)}")
    spark = docs.sparkSession
    tables, parts = SharedTables(spark), shuffle_partitions(spark)
    sized = tables.save(
        docs.select(
            F.col(id_col),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text_col), F.lit(0)).cast("long").alias("text_crc32"),
            *keep,
        ),
        "sized",
    )
    dealt = tables.save(
        sized.withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, id_col, "__tie")
        .withColumn("__range", F.spark_partition_id()),
        "dealt",
    )
    # One row per range: their number is the number of shuffle partitions, whatever the input.
    order = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__range").agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
    before = totals.select(
        "__range",
        F.coalesce(F.sum("__bytes").over(order), F.lit(0)).alias("__bytes_before"),
        F.coalesce(F.sum("__rows").over(order), F.lit(0)).alias("__rows_before"),
    )
    whole = totals.agg(F.sum("__bytes").alias("__total"))
    within = Window.partitionBy("__range").orderBy(id_col, "__tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        dealt.withColumn("__sum", F.sum("size").over(within))
        .withColumn("__n", F.count(F.lit(1)).over(within))
        .join(F.broadcast(before), "__range")
        .join(F.broadcast(whole))
        .withColumn("__twice_mid", 2 * (F.col("__bytes_before") + F.col("__sum")) - F.col("size"))
        .withColumn(
            "shard",
            F.least(F.lit(n_shards - 1), F.expr(f"(__twice_mid * {n_shards}) div (2 * __total)")).cast("int"),
        )
        .withColumn("__rank", F.col("__rows_before") + F.col("__n"))
    )
    first = placed.groupBy("shard").agg(F.min("__rank").alias("__first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        id_col, "size", "text_crc32", "shard", (F.col("__rank") - F.col("__first")).alias("slot"), *keep
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> None:
    """Writes whole rows, all columns kept, one folder per shard, each in slot order within its files.

    ``shard_col`` names the folders; a column of ``docs`` with that name is an error.
    """
    if shard_col in docs.columns:
        raise ValueError(f"the documents have a column {shard_col}; name the shards otherwise")
    boxed = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__box"))
    out = assign_shards(boxed, n_shards, "__id", "__text", ("__box",))
    out.sortWithinPartitions("shard", "slot").select("__box.*", F.col("shard").alias(shard_col)).write.partitionBy(shard_col).parquet(path)
