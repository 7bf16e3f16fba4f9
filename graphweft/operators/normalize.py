"""Normal form of a graph, and every violation of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_self_loops(arcs: DataFrame) -> DataFrame:
    return arcs.where("src <> dst")


def dedup_arcs(arcs: DataFrame) -> DataFrame:
    """Unweighted: repeated arcs count once."""
    return arcs.select("src", "dst").where("src <> dst").distinct().withColumn("w", F.lit(1).cast("long"))


def merge_arcs(arcs: DataFrame) -> DataFrame:
    """Weighted: repeated arcs add up."""
    return arcs.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def upper_edges(arcs: DataFrame) -> DataFrame:
    """Each edge once, from the smaller end, without its weight."""
    return arcs.where("dst > src").select("src", "dst").distinct()


def symmetrize(nodes: DataFrame, arcs: DataFrame, self_loops: bool = False) -> DataFrame:
    """(src, dst) of both directions, with a loop at every node if asked for."""
    pairs = arcs.select("src", "dst")
    pairs = pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    if self_loops:
        pairs = pairs.union(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    return pairs.distinct()


def asymmetric_arcs(arcs: DataFrame) -> DataFrame:
    """Arcs whose reverse is missing; weights are not compared."""
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return arcs.select("src", "dst").join(back, ["src", "dst"], "left_anti").distinct()


def graph_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Arcs of ``left`` that ``right`` lacks, repetitions counted."""
    return left.select("src", "dst", "w").exceptAll(right.select("src", "dst", "w"))


def validate(nodes: DataFrame, arcs: DataFrame, header_edges: int | None = None) -> DataFrame:
    """All violations as (rule, src, dst, detail); an empty result is a valid graph."""
    ends = arcs.select("src", "dst")
    outside = ends.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.lit("endpoint").alias("rule"), "src", "dst", F.lit(1).cast("long").alias("detail"))
    loops = ends.where("src = dst").select(F.lit("self_loop").alias("rule"), "src", "dst", F.lit(1).cast("long").alias("detail"))
    repeated = ends.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("detail")).where("detail > 1").select(F.lit("repeated").alias("rule"), "src", "dst", "detail")
    one_way = asymmetric_arcs(arcs).select(F.lit("asymmetric").alias("rule"), "src", "dst", F.lit(1).cast("long").alias("detail"))
    found = outside.union(loops).union(repeated).union(one_way)
    if header_edges is not None:
        none = F.lit(None).cast("long")
        wrong = arcs.agg(F.count(F.lit(1)).alias("detail")).where(F.col("detail") != 2 * header_edges)
        found = found.union(wrong.select(F.lit("edge_count").alias("rule"), none.alias("src"), none.alias("dst"), "detail"))
    return found
