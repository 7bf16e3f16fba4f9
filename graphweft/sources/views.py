"""Graphs derived from the relational tables.

A graph is three DataFrames: ``nodes(id)``, ``arcs(src, dst, w)`` with both directions of each edge and
no self-loops, and ``labels(id, c, t)`` with a clustering and a truth.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    arcs: DataFrame
    labels: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def both_directions(edges: DataFrame) -> DataFrame:
    """One scan of (src, dst, w) edges gives the arcs of both directions."""
    return edges.select(F.explode(F.array(F.struct("src", "dst", "w"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))).alias("e")).select("e.*")


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers (even ids) and suppliers (odd ids); an edge weighs the line items between them. C: nation, T: region."""
    customer, supplier, nation = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = items.groupBy((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).agg(F.count(F.lit(1)).alias("w"))
    people = customer.select((F.col("c_custkey") * 2).alias("id"), F.col("c_nationkey").alias("c")).union(supplier.select((F.col("s_suppkey") * 2 + 1).alias("id"), F.col("s_nationkey").alias("c")))
    labels = people.join(nation, F.col("c") == F.col("n_nationkey")).select("id", F.col("c").cast("int").alias("c"), F.col("n_regionkey").cast("int").alias("t"))
    return Graph(people.select("id"), both_directions(edges), labels)


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes from 0 in the order of the values. One row per distinct value meets in the ranking."""
    return df.select(F.col(column).alias("value")).distinct().select("value", (F.row_number().over(Window.orderBy("value")) - 1).cast("int").alias("code"))


def copurchase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (src < dst) per order and pair of its parts; an order has few lines."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    a, b = items.select("l_orderkey", F.col("l_partkey").alias("src")), items.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").where("src < dst").select("src", "dst")


def copurchase(spark: SparkSession, sf_dir: str, weighted: bool = False) -> Graph:
    """Parts bought in one order. C: type, T: brand."""
    pairs = copurchase_pairs(spark, sf_dir).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    edges = pairs.select("src", "dst", F.col("n").alias("w") if weighted else F.lit(1).cast("long").alias("w"))
    part = table(spark, sf_dir, "part")
    kinds, brands = dense_codes(part, "p_type"), dense_codes(part, "p_brand")
    labels = part.join(kinds, part.p_type == kinds.value).select("p_partkey", "p_brand", F.col("code").alias("c"))
    labels = labels.join(brands, labels.p_brand == brands.value).select(F.col("p_partkey").alias("id"), "c", F.col("code").alias("t"))
    return Graph(part.select(F.col("p_partkey").alias("id")), both_directions(edges), labels)


BLOCK = 4096


def similarity_edges(vectors: DataFrame, threshold: int, scale: int = 1000) -> DataFrame:
    """(src < dst, w) where the inner product of round(scale * x) reaches ``threshold``, block against block."""
    fine = vectors.where(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.round(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))
    blocks = max(1, -(-vectors.count() // BLOCK))
    keyed = fine.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # a pair of blocks meets once, i <= j
    left = keyed.select(F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))).alias("j"), "id", "v")
    right = keyed.select(F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i2"), F.col("own").alias("j2"), F.col("id").alias("id2"), F.col("v").alias("v2"))

    def side(part: pa.Table, ids: str, values: str):
        own = np.asarray(part.column(ids).combine_chunks(), dtype=np.int64)
        return own, np.asarray(part.column(values).combine_chunks().flatten(), dtype=np.float64).reshape(len(own), -1)

    def multiply(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if a.num_rows and b.num_rows:
            (x, u), (y, v) = side(a, "id", "v"), side(b, "id2", "v2")
            products = u @ v.T
            near = products >= threshold
            if key[0].as_py() == key[1].as_py():
                near &= x[:, None] < y[None, :]
            i, j = np.nonzero(near)
            out = [np.minimum(x[i], y[j]), np.maximum(x[i], y[j]), products[i, j].astype(np.int64)]
        return pa.table([pa.array(c) for c in out], names=["src", "dst", "w"])

    return left.groupBy("i", "j").cogroup(right.groupBy("i2", "j2")).applyInArrow(multiply, "src long, dst long, w long")


def knn(spark: SparkSession, sf_dir: str, threshold: int = 300_000) -> Graph:
    """Embeddings with a large inner product, unweighted. C and T: the label."""
    vectors = table(spark, sf_dir, "embeddings")
    edges = similarity_edges(vectors, threshold).select("src", "dst", F.lit(1).cast("long").alias("w"))
    labels = vectors.select(F.col("vec_id").alias("id"), F.col("label").alias("c"), F.col("label").alias("t"))
    return Graph(vectors.select(F.col("vec_id").alias("id")), both_directions(edges), labels)


def documents_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A document and the one with the smallest id that has a common line of more than 20 characters: a star per line. C: source, T: language."""
    documents = table(spark, sf_dir, "documents")
    lines = documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.lower(F.trim("line")).alias("line")).where(F.length("line") > 20).distinct()
    first = lines.groupBy("line").agg(F.min("doc_id").alias("src"))
    edges = lines.join(first, "line").where("src < doc_id").select("src", F.col("doc_id").alias("dst")).distinct().withColumn("w", F.lit(1).cast("long"))
    sources, langs = dense_codes(documents, "source"), dense_codes(documents, "lang")
    labels = documents.select("doc_id", "source", "lang").join(sources, F.col("source") == sources.value).select("doc_id", "lang", F.col("code").alias("c"))
    labels = labels.join(langs, labels.lang == langs.value).select(F.col("doc_id").alias("id"), "c", F.col("code").alias("t"))
    return Graph(documents.select(F.col("doc_id").alias("id")), both_directions(edges), labels)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, src, dst): consecutive users in (ts, event_id) order, self-loops kept.

    Orders are taken within days; a day's first event follows the last one of the day before, found in a
    table with one row per day.
    """
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id").withColumn("day", F.to_date("ts"))
    order = Window.partitionBy("day").orderBy("ts", "event_id")
    within = events.withColumn("n", F.row_number().over(order)).withColumn("before", F.lag("user_id").over(order))
    days = events.groupBy("day").agg(F.count(F.lit(1)).alias("size"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))
    by_day = Window.orderBy("day")
    days = days.select("day", F.lag("last").over(by_day).alias("carried"), F.coalesce(F.sum("size").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    joined = within.join(days, "day").select((F.col("offset") + F.col("n")).alias("pos"), F.coalesce("before", F.when(F.col("n") == 1, F.col("carried"))).alias("src"), F.col("user_id").alias("dst"))
    return joined.where("src is not null")
