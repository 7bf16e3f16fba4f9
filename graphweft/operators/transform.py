"""Contraction, compaction, offsets, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.plans.folders import own_folder, shared_folder


def quotient(arcs: DataFrame, labels: DataFrame, column: str = "c") -> DataFrame:
    """(a, b, w): arc weight between the clusters of both ends, inner weight on the diagonal.

    Two joins and one aggregation; everything structural follows from this small table.
    """
    own = labels.select(F.col("id").alias("src"), F.col(column).alias("a"))
    other = labels.select(F.col("id").alias("dst"), F.col(column).alias("b"))
    return arcs.join(own, "src").join(other, "dst").groupBy("a", "b").agg(F.sum("w").alias("w"))


def contract(arcs: DataFrame, labels: DataFrame, column: str = "c") -> tuple[DataFrame, DataFrame]:
    """Cluster weights (id, vw: inner arc weight, each inner edge twice) and the arcs between clusters."""
    table = quotient(arcs, labels, column)
    inner = table.where("a = b").select(F.col("a").alias("id"), F.col("w").alias("vw"))
    members = labels.select(F.col(column).alias("id")).distinct()
    weights = members.join(inner, "id", "left").select("id", F.coalesce("vw", F.lit(0)).alias("vw"))
    return weights, table.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")


def contract_keep_diagonal(arcs: DataFrame, labels: DataFrame, column: str = "c") -> DataFrame:
    """(src, dst, w) of the contracted graph with diagonal arcs, zero weights dropped."""
    return quotient(arcs, labels, column).where("w <> 0").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")


def compact_labels(labels: DataFrame, column: str = "c") -> DataFrame:
    """(id, c) with labels 0, 1, ... in their order; only distinct labels are ranked."""
    ranks = labels.select(column).distinct().withColumn("rank", F.row_number().over(Window.orderBy(column)) - 1)
    return labels.join(ranks, column).select("id", F.col("rank").cast("int").alias("c"))


def csr_offsets(nodes: DataFrame, arcs: DataFrame, blocks: int = 64) -> DataFrame:
    """(id, degree, offset): arcs before the node's own in id order.

    Prefix sums run inside blocks of ids; blocks are placed by a table with one row each.
    """
    degrees = nodes.join(arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    keyed = degrees.withColumn("block", F.floor(F.col("id") / (1 << 16)))
    sums = keyed.groupBy("block").agg(F.sum("degree").alias("s"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.select("block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return keyed.withColumn("inner", F.coalesce(F.sum("degree").over(within), F.lit(0))).join(placed, "block").select("id", "degree", (F.col("base") + F.col("inner")).alias("offset"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iterative plan in the folder of spark.checkpoint.dir."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, smaller than a checkpoint; shuffle files that made it are deleted."""
    spark, path, cleanup = df.sparkSession, f"{own_folder(df.sparkSession, 'table')}/rows", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def connected_labels(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, rep): the smallest node that arcs lead to. Minimum labels spread and then jump to their own label's label."""
    labels = nodes.select("id", F.col("id").alias("rep"))
    pairs = arcs.select("src", "dst")
    while True:
        near = pairs.join(labels.select(F.col("id").alias("dst"), "rep"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("rep").alias("m"))
        spread = labels.join(near, "id", "left").select("id", F.least("rep", F.coalesce("m", "rep")).alias("rep"), F.col("rep").alias("old"))
        jump = spread.join(spread.select(F.col("id").alias("rep"), F.col("rep").alias("far")), "rep").select("id", F.least("rep", "far").alias("rep"), "old")
        after = checkpointed(jump)
        if after.where("rep <> old").isEmpty():
            return after.select("id", "rep")
        labels = after.select("id", "rep")


def components_within_clusters(nodes: DataFrame, arcs: DataFrame, labels: DataFrame, column: str = "c") -> DataFrame:
    """(id, rep): connected parts of each cluster."""
    own = labels.select(F.col("id").alias("src"), F.col(column).alias("a"))
    other = labels.select(F.col("id").alias("dst"), F.col(column).alias("b"))
    return connected_labels(nodes, arcs.join(own, "src").join(other, "dst").where("a = b").select("src", "dst"))
