"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTables


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Edges run from small a to large b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    down = joined.select(F.col("m").alias("a"), F.col("a").alias("b"))
    return down.union(least.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()


def components(edges: DataFrame, tables: SharedTables, name: str) -> DataFrame:
    """(node, label) of all nodes in ``edges`` (a, b); label is the smallest node of the component."""
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    current, state, step = tables.save(ordered, f"{name}-0"), None, 0
    while True:
        step += 1
        after = tables.save(_small_star(_large_star(current)), f"{name}-{step}")
        found = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        tables.drop(f"{name}-{step - 1}")
        if found == state:
            break
        current, state = after, found
    labels = after.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return labels.union(after.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
