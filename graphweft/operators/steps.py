"""Single steps of clustering methods, as DataFrame queries. Gains are exact integers.

With arc weights W in all, degrees k, volumes K (a node's own cluster counts the node) and w(u, B) the
weight from u to B without u itself: moving u from A to B changes N by
2 (W (w(u, B) - w(u, A)) - k_u (K_B - K_A + k_u)), and merging A and B by 2 (W w(A, B) - K_A K_B).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.exact import rounded
from graphweft.operators import blocks, transform
from graphweft.operators.metrics import node_degrees


def label_propagation_round(nodes: DataFrame, arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, c): the label with the most arc weight around each node, the smallest of equal ones; isolated nodes keep theirs."""
    other = labels.select(F.col("id").alias("dst"), "c")
    around = arcs.join(other, "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("w"))
    best = around.groupBy("id").agg(F.max(F.struct("w", (-F.col("c")).alias("minus"))).alias("b"))
    return labels.select("id", "c").join(best, "id", "left").select("id", F.coalesce(-F.col("b.minus"), "c").alias("c"))


def louvain_sweep(nodes: DataFrame, arcs: DataFrame, labels: DataFrame, down: bool = True, gamma: int = 1) -> DataFrame:
    """(id, c) after every node moved at once to the neighbour cluster of the largest positive gain.

    Moves go to smaller labels only (``down``) or to larger ones, so that no two nodes swap places.
    """
    degrees = node_degrees(nodes, arcs)
    held = labels.select("id", F.col("c").cast("long").alias("c")).join(degrees, "id")
    volumes = held.groupBy("c").agg(F.sum("k").alias("K"))
    total = degrees.agg(F.sum("k").alias("total"))
    around = arcs.where("src <> dst").join(labels.select(F.col("id").alias("dst"), F.col("c").cast("long").alias("b")), "dst").groupBy(F.col("src").alias("id"), "b").agg(F.sum("w").alias("w"))
    state = held.join(volumes.select("c", F.col("K").alias("KA")), "c").join(around.select("id", F.col("b").alias("c"), F.col("w").alias("wA")), ["id", "c"], "left")
    options = state.join(around, "id").join(volumes.select(F.col("c").alias("b"), F.col("K").alias("KB")), "b").join(total)
    gain = 2 * (F.col("total") * (F.col("w") - F.coalesce("wA", F.lit(0))) - gamma * F.col("k") * (F.col("KB") - F.col("KA") + F.col("k")))
    options = options.where("b < c" if down else "b > c").withColumn("gain", gain).where("gain > 0")
    best = options.groupBy("id").agg(F.max(F.struct("gain", (-F.col("b")).alias("minus"))).alias("m"))
    return held.join(best, "id", "left").select("id", F.coalesce(-F.col("m.minus"), "c").alias("c"))


#: Nodes and arc weight up to which listed_sweep holds all labels in a task and its gains fit 64 bits.
LISTED_NODES = 1_000_000
LISTED_WEIGHT = 1 << 30


def listed_sweep(near: DataFrame, labels: DataFrame, degrees: DataFrame, total: int, down: bool = True, gamma: int = 1) -> DataFrame:
    """louvain_sweep with the arcs as lists (id, m: neighbours, x: weights) that pass the labels of all nodes, which a task holds."""
    state = labels.select("id", F.col("c").cast("long").alias("c")).join(degrees, "id")
    state = state.join(state.groupBy("c").agg(F.sum("k").alias("volume")), "c")
    held = state.select("id", F.array("c", "k", "volume").alias("m"), F.lit(None).cast("array<double>").alias("x"))

    def hold(rows: pa.Table):
        values = np.concatenate([x.flatten().to_numpy() for x in rows.column("m").chunks]).reshape(-1, 3)
        order = np.argsort(np.asarray(rows.column("id")), kind="stable")
        return np.asarray(rows.column("id"))[order], *values[order].T

    def meet(block, batch: pa.RecordBatch):
        ids, c, k, volume = block
        sizes = batch.column("m").value_lengths().to_numpy()
        row, at = np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(ids, batch.column("m").flatten().to_numpy())
        own, w = np.searchsorted(ids, batch.column("id").to_numpy()), batch.column("x").flatten().to_numpy().astype(np.int64)
        order = np.lexsort((c[at], row))
        row, at, w = row[order], at[order], w[order]
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (c[at[1:]] != c[at[:-1]])))[: len(row)])
        row, at, w = row[first], at[first], np.add.reduceat(w, first) if len(first) else w
        inner, mine, b, degree = np.zeros(len(sizes), np.int64), c[own][row], c[at], k[own][row]
        inner[row[b == mine]] = w[b == mine]
        gain = 2 * (total * (w - inner[row]) - gamma * degree * (volume[at] - volume[own][row] + degree))
        some = np.flatnonzero(((b < mine) if down else (b > mine)) & (gain > 0))
        some = some[np.lexsort((b[some], -gain[some], row[some]))]
        some = some[np.unique(row[some], return_index=True)[1]]
        if len(some):
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row[some])), pa.array(b[some])], ["id", "b"])

    best = blocks.facing(near, held, hold, meet, "id long, b long")
    return state.join(best, "id", "left").select("id", F.coalesce("b", "c").alias("c"))


def merge_gains(table: DataFrame, between: DataFrame) -> DataFrame:
    """(a, b, gain, score) of merging adjacent clusters a < b; score scales the gain by the ratio of their sizes."""
    whole = table.agg(F.sum("volume").alias("total"))
    side = lambda x: table.select(F.col("c").alias(x), F.col("volume").alias(f"K{x}"), F.col("size").alias(f"s{x}"))
    pairs = between.where("a < b").join(side("a"), "a").join(side("b"), "b").join(whole)
    gain = 2 * (F.col("total") * F.col("w") - F.col("Ka") * F.col("Kb"))
    ratio = F.least("sa", "sb").cast("double") / F.greatest("sa", "sb").cast("double")
    return pairs.select("a", "b", gain.alias("gain"), rounded(gain.cast("double") * ratio, 6).alias("score"))


def best_merge(gains: DataFrame, by: str = "gain") -> DataFrame:
    """The one best pair, the smallest labels of equal ones."""
    best = gains.agg(F.max(F.struct(F.col(by).alias("x"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("m"))
    return best.select((-F.col("m.a")).alias("a"), (-F.col("m.b")).alias("b"), F.col("m.x").alias(by))


def mutual_best_merges(gains: DataFrame, by: str = "gain") -> DataFrame:
    """(a, b): pairs that are each other's best with a positive value, so that many merge in one round."""
    both = gains.where(F.col(by) > 0).select(F.explode(F.array(F.struct("a", "b", F.col(by).alias("x")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col(by).alias("x")))).alias("e")).select("e.*")
    best = both.groupBy("a").agg((-F.max(F.struct("x", (-F.col("b")).alias("minus")))["minus"]).alias("b"))
    return best.join(best.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).where("a < b")


def overlay(labels: DataFrame, first: str = "c", second: str = "t") -> DataFrame:
    """(id, c): nodes together in both clusterings; labels are the smallest node of each part."""
    return labels.join(labels.groupBy(first, second).agg(F.min("id").alias("part")), [first, second]).select("id", F.col("part").alias("c"))


def soft_step(arcs: DataFrame, degrees: DataFrame, soft: DataFrame) -> DataFrame:
    """One aggregation of soft assignments (id, i, x) by modularity weights, cut at zero and scaled to sum 1.

    A node without a positive part is left out.
    """
    whole = degrees.agg(F.sum("k").alias("total"))
    around = arcs.join(soft.select(F.col("id").alias("dst"), "i", "x"), "dst").groupBy(F.col("src").alias("id"), "i").agg(F.sum(F.col("w") * F.col("x")).alias("near"))
    mass = soft.join(degrees, "id").groupBy("i").agg(F.sum(F.col("k") * F.col("x")).alias("mass"))
    raw = around.join(degrees, "id").join(mass, "i").join(whole).withColumn("v", F.col("near") * F.col("total") - F.col("k") * F.col("mass")).where("v > 0")
    return raw.join(raw.groupBy("id").agg(F.sum("v").alias("sum")), "id").select("id", "i", (F.col("v").cast("double") / F.col("sum")).alias("x"))


def argmax_assign(soft: DataFrame) -> DataFrame:
    """(id, c): the position of the largest part, the first of equal ones."""
    return soft.groupBy("id").agg((-F.max(F.struct("x", (-F.col("i")).alias("minus")))["minus"]).alias("c"))


def kmeans_step(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, c, d): the nearest centre of integer points (id, v), the smallest of equal ones. ``centres`` (c, u): k rows, broadcast."""
    square = F.aggregate(F.zip_with("v", "u", lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda a, b: a + b)
    near = points.join(F.broadcast(centres)).select("id", "c", square.alias("d"))
    return near.groupBy("id").agg(F.min(F.struct("d", "c")).alias("m")).select("id", F.col("m.c").alias("c"), F.col("m.d").alias("d"))


def neighbor_sample(arcs: DataFrame, size: int = 10, seed: int = 0) -> DataFrame:
    """(src, dst): up to ``size`` neighbours of each node by a hash of the arc."""
    key = (F.col("src") * 7919 + F.col("dst") * 104729 + seed) % 1000003
    order = Window.partitionBy("src").orderBy(key, "dst")
    return arcs.select("src", "dst").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("src", "dst")


def walk_distribution(arcs: DataFrame, steps: int = 4) -> DataFrame:
    """(src, dst, p): where a random walk from src is after ``steps`` steps."""
    degree = arcs.groupBy("src").agg(F.sum("w").alias("k"))
    one = arcs.join(degree, "src").select("src", "dst", (F.col("w").cast("double") / F.col("k")).alias("p"))
    if steps < 2:
        return one
    least = degree.agg(F.max("k")).first()[0], arcs.agg(F.min("w")).first()[0]
    positive = None not in least and least[1] > 0 and (least[1] / least[0]) ** steps > 1e-300
    back = transform.saved(blocks.packed_lists(arcs, "dst", "src", "w")) if positive else None
    if positive and (back.agg(F.sum(F.length("packed"))).first()[0] or 0) <= blocks.WHOLE:
        at = blocks.walked(transform.saved(blocks.packed_lists(arcs, "src", "dst", "w")), back, steps - 1)
        return at.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("z").alias("p"))
    back, at = transform.saved(blocks.packed_lists(one, "dst", "src", "p")), one
    for _ in range(steps - 1):
        at = blocks.product(transform.saved(blocks.packed_lists(at, "src", "dst", "p")), back).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("z").alias("p"))
    return at


def two_hop_cooccurrence(arcs: DataFrame) -> DataFrame:
    """(a, b, n): common neighbours of a < b."""
    return blocks.common_entries(transform.saved(blocks.packed_lists(arcs, "dst", "src")))


def modularity_entries(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(src, dst, b, x) of every arc; the dense rest of the matrix is -k k and never built.

    b is W w - k k, exact; x is a quarter of w - k k / W, and w where the weights add up to 0.
    """
    degrees = node_degrees(nodes, arcs)
    own, other = degrees.select(F.col("id").alias("src"), F.col("k").alias("ks")), degrees.select(F.col("id").alias("dst"), F.col("k").alias("kd"))
    whole, square = degrees.agg(F.sum("k").alias("total")), F.col("ks") * F.col("kd")
    scaled = F.when(F.col("total") == 0, F.col("w").cast("double")).otherwise((F.col("w") - square.cast("double") / F.col("total")) / 4)
    return arcs.join(own, "src").join(other, "dst").join(whole).select("src", "dst", (F.col("total") * F.col("w") - square).alias("b"), rounded(scaled).alias("x"))


def sigmoid(logits: DataFrame) -> DataFrame:
    """(id, f): the probabilities of logits."""
    return logits.select("id", F.transform("f", lambda x: 1 / (1 + F.exp(-x))).alias("f"))


def select_large_communities(labels: DataFrame, factor: float = 0.5) -> DataFrame:
    """(c, size) of clusters with more nodes than the mean and ``factor`` standard deviations (of the population)."""
    sizes = labels.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(sizes.agg(F.avg("size").alias("mean"), F.stddev_pop("size").alias("sd"))).where(F.col("size") > F.col("mean") + factor * F.col("sd")).select("c", "size")


def row_normalized(features: DataFrame) -> DataFrame:
    """(id, f): each row over its sum and 1e-9."""
    total = F.aggregate("f", F.lit(0.0), lambda a, x: a + x)
    return features.withColumn("sum", total).select("id", F.transform("f", lambda x: x / (F.col("sum") + 1e-9)).alias("f"))


def l2_normalized(features: DataFrame) -> DataFrame:
    """(id, f): each row over its Euclidean length, at least 1e-12."""
    length = F.sqrt(F.aggregate("f", F.lit(0.0), lambda a, x: a + x * x))
    return features.withColumn("len", F.greatest(length, F.lit(1e-12))).select("id", F.transform("f", lambda x: x / F.col("len")).alias("f"))


def default_features(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.array(F.lit(1.0)).alias("f"))
