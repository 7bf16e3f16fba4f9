"""Clustering methods behind one interface: solve(graph, method, ...) -> labels(id, c).

A graph whose arcs exceed LOCAL_ARCS is coarsened by distributed sweeps and contraction until it fits;
the method then runs on the coarse graph in one process and its labels are joined back. Methods are
named after what they do; those that learn are surrogates without neural networks.
"""

from __future__ import annotations

import functools
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphweft.operators import blocks, local, metrics, steps, transform
from graphweft.sources import generate
from graphweft.sources.views import Graph
from graphweft.streaming import stream_cluster

#: Arcs and nodes that one process clusters; both bound what reaches the driver.
LOCAL_ARCS = 200_000
LOCAL_NODES = 20_000
SWEEPS = 4
#: Points that pass the leaders at once, and leaders of one product.
LED_ROWS = 256
LEADERS = 2048

METHODS = {
    "cnm": lambda g, o, c: local.agglomerate(g, clock=c),
    "wt": lambda g, o, c: local.agglomerate(g, True, clock=c),
    "louvain": lambda g, o, c: local.louvain(g, o.get("gamma", 1), o["seed"], clock=c),
    "leiden": lambda g, o, c: local.leiden(g, o.get("gamma", 1), o.get("rounds", 2), o["seed"], clock=c),
    "walktrap": lambda g, o, c: local.walktrap(g, o.get("steps", 4), clock=c),
    "infomap": lambda g, o, c: local.infomap(g, o["seed"], clock=c),
    "combo": lambda g, o, c: local.combo(g, clock=c),
    "memetic": lambda g, o, c: local.memetic(g, seed=o["seed"], clock=c),
    "gnns": lambda g, o, c: local.soft_aggregation(g, o.get("k", 16), o.get("starts", 10), seed=o["seed"], clock=c),
    "soft_modularity_ascent": lambda g, o, c: local.soft_ascent(g, o.get("k", 16), seed=o["seed"], clock=c),
    "exact_small": lambda g, o, c: local.exact_small(g),
}


def coarsened(graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: id, c), (coarse nodes: id, size), (coarse arcs with loops), small enough for one process.

    Nodes without an arc to another one have no cluster to join and stay among the members only.
    """
    members = graph.nodes.select("id", F.col("id").alias("c"))
    nodes, arcs = graph.nodes.select("id", F.lit(1).cast("long").alias("size")), graph.arcs.select("src", "dst", "w")
    arcs = transform.saved(arcs)
    nodes = transform.checkpointed(nodes.join(arcs.select(F.col("src").alias("id")).distinct(), "id", "left_semi"))
    while arcs.limit(LOCAL_ARCS + 1).count() > LOCAL_ARCS or nodes.limit(LOCAL_NODES + 1).count() > LOCAL_NODES:
        labels = nodes.select("id", F.col("id").alias("c"))
        before = nodes.count()
        degrees = transform.checkpointed(metrics.node_degrees(nodes, arcs))
        total = degrees.agg(F.sum("k")).first()[0] or 0
        near = transform.saved(blocks.lists(arcs.where("src <> dst"), "src", "dst", "w")) if before <= steps.LISTED_NODES and total <= steps.LISTED_WEIGHT else None
        for i in range(SWEEPS):
            down = i % 2 == 0
            labels = transform.checkpointed(steps.louvain_sweep(nodes, arcs, labels, down=down) if near is None else steps.listed_sweep(near, labels, degrees, total, down))
        members = transform.checkpointed(members.join(labels.select(F.col("id").alias("c"), F.col("c").alias("d")), "c", "left").select("id", F.coalesce("d", "c").alias("c")))
        arcs = transform.checkpointed(transform.contract_keep_diagonal(arcs, labels))
        nodes = transform.checkpointed(nodes.join(labels, "id").groupBy("c").agg(F.sum("size").alias("size")).select(F.col("c").alias("id"), "size"))
        if nodes.count() == before:
            raise ValueError("the graph does not coarsen to a size for one process")
    return members, nodes, arcs


def local_graph(nodes: DataFrame, arcs: DataFrame) -> tuple[list[int], local.LocalGraph]:
    rows = sorted((r["id"], r["size"]) for r in nodes.collect())
    code = {r[0]: i for i, r in enumerate(rows)}
    table = arcs.groupBy("src", "dst").agg(F.sum("w").alias("w")).toArrow().to_pydict()
    src, dst = [code[x] for x in table["src"]], [code[x] for x in table["dst"]]
    return [r[0] for r in rows], local.LocalGraph.of_arcs(len(rows), src, dst, table["w"], [r[1] for r in rows])


def solve(graph: Graph, method: str, seed: int = 0, limit: float | None = None, **options) -> DataFrame:
    """(id, c): the clustering; c is the smallest id of the cluster's coarse nodes. ``limit``: seconds for the search."""
    members, nodes, arcs = coarsened(graph)
    return searched(members, *local_graph(nodes, arcs), method, limit, seed=seed, **options)


def searched(members: DataFrame, ids: list[int], g: local.LocalGraph, method: str, limit: float | None, **options) -> DataFrame:
    """(id, c) of the members of coarse nodes, the method run on the coarse graph."""
    return joined(members, ids, METHODS[method](g, options, local.Clock(limit)) if ids else [])


def joined(members: DataFrame, ids: list[int], labels: list[int]) -> DataFrame:
    """(id, c) of the members of coarse nodes with these labels."""
    spark = members.sparkSession
    first: dict[int, int] = {}
    for i, c in zip(ids, labels):
        first.setdefault(c, i)
    found = spark.createDataFrame([(i, first[c]) for i, c in zip(ids, labels)], "c long, d long")
    return members.join(found, "c", "left").select("id", F.coalesce("d", "c").alias("c"))


def best_of(graph: Graph, method: str, runs: int = 5, limit: float | None = None, **options) -> DataFrame:
    """The best of some seeded runs by modularity, the first of equal ones.

    Seeds only matter to the search, so the graph is coarsened once; contraction keeps modularity, whose numerator
    is taken on the coarse graph.
    """
    members, nodes, arcs = coarsened(graph)
    ids, g = local_graph(nodes, arcs)
    found = [METHODS[method](g, options | {"seed": seed}, local.Clock(limit)) if ids else [] for seed in range(runs)]
    return joined(members, ids, max(found, key=g.numerator))


def restreamed(graph: Graph, seed: int = 0) -> DataFrame:
    """(id, c) of the nodes with arcs: streamed until nothing moves, then the graph of the clusters, which keeps modularity, refined by the memetic search."""
    labels = transform.checkpointed(stream_cluster.stream_nodes(graph.arcs, None))
    clusters = Graph(labels.select(F.col("c").alias("id")).distinct(), transform.saved(transform.contract_keep_diagonal(graph.arcs, labels)), graph.labels)
    found = solve(clusters, "memetic", seed)
    return labels.join(found.select(F.col("id").alias("c"), F.col("c").alias("d")), "c").select("id", F.col("d").alias("c"))


def propagated(graph: Graph, features: DataFrame, hops: int = 2) -> DataFrame:
    """(id, f): features averaged over a node and its neighbours, ``hops`` times, and L2-normalised."""
    arcs = graph.arcs.select("src", "dst").union(graph.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    near, at = transform.saved(blocks.lists(arcs, "src", "dst").select("id", "m")), features
    for _ in range(hops):
        at = transform.saved(blocks.neighbour_means(near, at))
    return steps.l2_normalized(at)


def kmeans(points: DataFrame, k: int, seed: int = 0, iterations: int = 50) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = points.select("id", array_to_vector("f").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations).fit(vectors)
    return model.transform(vectors).select("id", F.col("prediction").cast("long").alias("c"))


def propagate_kmeans(graph: Graph, features: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Surrogate of contrastive methods: propagated features, then k-means."""
    return kmeans(propagated(graph, features), k, seed)


def threshold_clusters(points: DataFrame, threshold: float) -> DataFrame:
    """(id, c) of points (id, f) by leaders: in id order a point joins the first leader nearer than ``threshold``, else it leads.

    Parts of the points are clustered at once, then the leaders of all parts: the near pairs of these are found block
    against block, and one task goes through them in id order, which holds the ids of leaders and no vectors; so a
    point is less than two thresholds from its leader. c is the leader's id.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        # a point f is near a leader v if f v - v v / 2 > (f f - t t) / 2: one product, with a column more on both sides
        leaders, names, n = np.zeros((0, 0)), np.zeros(0, np.int64), 0
        for batch in batches:
            own, flat = batch.column("id").to_numpy(zero_copy_only=False), batch.column("f").flatten().to_numpy(zero_copy_only=False)
            f, found = flat.reshape(len(own), -1), np.zeros(len(own), np.int64)
            square = (f**2).sum(axis=1)
            ones, halves, least = np.column_stack((f, np.ones(len(own)))), np.column_stack((f, -square / 2)), (square - threshold**2) / 2
            for start in range(0, len(own), LED_ROWS):
                rest = np.arange(start, min(start + LED_ROWS, len(own)))
                for at in range(0, n, LEADERS):
                    near = ones[rest] @ leaders[at : min(n, at + LEADERS)].T > least[rest][:, None]
                    hit = near.any(axis=1)
                    found[rest[hit]] = names[at + near[hit].argmax(axis=1)]
                    rest = rest[~hit]
                near, apart, led = ones[rest] @ halves[rest].T > least[rest][:, None], np.ones(len(rest), bool), []
                for i in range(len(rest)):
                    if apart[i]:
                        joins = apart & near[:, i]
                        joins[i] = True
                        found[rest[joins]], apart = own[rest[i]], apart & ~joins
                        led.append(rest[i])
                if n + len(led) > len(names):
                    room = max(1024, 2 * (n + len(led)))
                    leaders = np.concatenate((leaders[:n], np.zeros((room - n, f.shape[1] + 1)))) if n else np.zeros((room, f.shape[1] + 1))
                    names = np.concatenate((names[:n], np.zeros(room - n, np.int64)))
                leaders[n : n + len(led)], names[n : n + len(led)] = halves[led], own[led]
                n += len(led)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found, pa.int64())], ["id", "c"])

    def first_led(batches):
        leads: set[int] = set()
        for batch in batches:
            own = batch.column("id").to_pylist()
            found: list[int] = []
            for i, m in zip(own, batch.column("m").to_pylist()):
                found.append(next((j for j in m or () if j in leads), i))
                if found[-1] == i:
                    leads.add(i)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found, pa.int64())], ["id", "c"])

    labels = transform.checkpointed(points.select("id", "f").repartition(parts, "id").sortWithinPartitions("id").mapInArrow(run, "id long, c long"))
    leaders = transform.saved(points.join(labels.where("id = c").select("id"), "id").select("id", "f"))
    before = blocks.nearer(leaders, threshold).groupBy("id").agg(F.array_sort(F.collect_list("j")).alias("m"))
    led = leaders.select("id").join(before, "id", "left").repartition(1).sortWithinPartitions("id").mapInArrow(first_led, "id long, c long")
    return labels.join(led.select(F.col("id").alias("c"), F.col("c").alias("d")), "c").select("id", F.col("d").alias("c"))


def propagate_threshold(graph: Graph, features: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Surrogate of threshold clustering without a given k: propagated features, then leaders at least ``threshold`` apart."""
    return threshold_clusters(propagated(graph, features), threshold)


def select_then_assign(graph: Graph, features: DataFrame, gamma: float = 0.3, seed: int = 123) -> DataFrame:
    """Communities at a low resolution, the large ones kept, nodes to the nearest centre of propagated features."""
    return assigned(propagated(graph, features), transform.checkpointed(solve(graph, "louvain", seed, gamma=gamma)))


def assigned(at: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, c): the nearest centre of each point (id, f), where the large clusters of ``labels`` have their centres."""
    large = steps.select_large_communities(labels)
    kept = large if not large.isEmpty() else labels.select("c").distinct()
    means = at.join(labels.join(kept.select("c"), "c"), "id").select("c", F.posexplode("f").alias("i", "x")).groupBy("c", "i").agg(F.avg("x").alias("x"))
    centres = means.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("l")).select("c", F.transform("l", lambda p: p["x"]).alias("f"))
    return blocks.nearest(at, transform.saved(centres))


def power_iteration(graph: Graph, k: int, iterations: int = 20) -> DataFrame:
    """Spectral clustering of the affinity that the arcs give."""
    from pyspark.ml.clustering import PowerIterationClustering

    edges = graph.arcs.where("src < dst").select("src", "dst", F.col("w").cast("double").alias("weight"))
    out = PowerIterationClustering(k=k, maxIter=iterations, srcCol="src", dstCol="dst", weightCol="weight").assignClusters(edges)
    return out.select("id", F.col("cluster").cast("long").alias("c"))


def run_benchmark(spark: SparkSession, graph: Graph, name: str, method: str, runs: int = 1, limit: float | None = None, **options) -> DataFrame:
    """One row per run in the columns of the results table: solver, time, and the evaluator's row."""
    rows = None
    for run in range(runs):
        began = time.monotonic()
        labels = transform.checkpointed(solve(graph, method, run, limit, **options))
        took = time.monotonic() - began
        both = labels.join(graph.labels.select("id", "t"), "id")
        row = metrics.evaluate(graph.nodes, graph.arcs, both, name).select(
            F.lit(method).alias("algorithm"), F.lit(name).alias("instance"), F.lit(run).alias("run"), F.lit(None).cast("long").alias("memory"), F.lit(0).alias("code"), F.lit(took).alias("time"), F.lit(1).alias("iterations"), "*"
        )
        rows = row if rows is None else rows.union(row)
    return rows


#: Methods beside METHODS as (graph, options) -> (id, c).
STREAMED = {
    "power_iteration": lambda g, o: power_iteration(Graph(g.nodes, g.arcs.coalesce(max(1, g.arcs.count() // LOCAL_ARCS)), g.labels), o.get("k", 4)),
    "stream_edges": lambda g, o: stream_cluster.stream_edges(g.arcs.where("src < dst").select(F.struct("src", "dst").alias("pos"), "src", "dst")),
    "stream_nodes": lambda g, o: stream_cluster.stream_nodes(g.arcs),
}
#: Those that read features as (propagated features, communities at a low resolution, options) -> (id, c).
FEATURED = {
    "propagate_kmeans": lambda at, start, o: kmeans(at, o.get("k", 4), o["seed"]),
    "propagate_threshold": lambda at, start, o: threshold_clusters(at, 0.5),
    "select_then_assign": lambda at, start, o: assigned(at, start),
}
#: Every method for graphs of any size; exact_small takes 11 nodes at most.
SWEPT = [*(m for m in METHODS if m != "exact_small"), *STREAMED, *FEATURED]
#: Graphs of the sweep at a time, and runs on these that are no tasks; the driver's memory holds the plans of that many.
GRAPHS, RUNS = 3, 4


def searched_at_once(members: DataFrame, ids: list[int], g: local.LocalGraph, runs: dict[int, str], limit: float | None, options: dict) -> tuple[DataFrame, dict[int, float]]:
    """((run, id, c) of the methods of ``runs`` on one coarse graph, a task each; seconds of each run)."""
    spark, numbers = members.sparkSession, list(runs)

    def search(batches):
        for batch in batches:
            for at in batch.column("id").to_pylist():
                began = time.monotonic()
                labels, first = METHODS[runs[numbers[at]]](g, options, local.Clock(limit)) if ids else [], {}
                took = time.monotonic() - began
                for i, c in zip(ids, labels):
                    first.setdefault(c, i)
                n = len(labels)
                yield pa.RecordBatch.from_arrays([pa.array([numbers[at]] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array([first[c] for c in labels], pa.int64()), pa.array([took] * n, pa.float64())], ["run", "c", "d", "took"])

    found = transform.saved(spark.range(0, len(numbers), 1, max(1, len(numbers))).mapInArrow(search, "run int, c long, d long, took double"))
    every = members.join(spark.createDataFrame([(x,) for x in numbers], "run int"))
    seconds = {r["run"]: r["took"] for r in found.groupBy("run").agg(F.first("took").alias("took")).collect()}
    return every.join(found, ["run", "c"], "left").select("run", "id", F.coalesce("d", "c").alias("c")), seconds


def run_sweep(spark: SparkSession, settings: list, methods: list[str], limit: float | None = 360.0, **options) -> DataFrame:
    """Rows of run_benchmark for every generator setting and method; graphs are drawn anew and never stored.

    Settings that differ in their features only have the same graph; a method that reads no features runs
    once on it, and the row stands for each of them. The runs on a graph are evaluated together, the methods of METHODS run
    beside each other as tasks, and features are propagated for all settings at once, on a copy of the graph for each;
    the time of a run does not hold what it shares with others. ``limit`` holds for the methods of METHODS.
    """
    options = options | {"seed": 0}
    alike: dict = {}
    for setting in settings:
        alike.setdefault(replace(setting, dimensions=1, signal=0.0, spread=0.0), []).append(setting)

    def title(setting) -> str:
        return f"a{setting.assortativity}-s{setting.signal:.4f}"

    def of_graph(same: list) -> list[dict]:
        graph, _ = generate.block_model(spark, same[0])
        graph = Graph(*(transform.saved(x) for x in (graph.nodes, graph.arcs, graph.labels)))
        members, nodes, arcs = coarsened(graph)
        ids, g = local_graph(nodes, arcs)
        runs = [(m, i) for m in methods for i in (range(len(same)) if m in FEATURED else [0])]
        parts, took = [], {}
        if local_runs := {run: m for run, (m, _) in enumerate(runs) if m in METHODS}:
            labels, took = searched_at_once(members, ids, g, local_runs, limit, options)
            parts.append(labels)

        def one(run: int) -> DataFrame:
            method, i = runs[run]
            began = time.monotonic()
            if method in FEATURED:
                found = FEATURED[method](at.where(F.col("copy") == i).select("id", "f"), start, options)
            else:
                found = STREAMED[method](graph, options)
            found = transform.saved(found.select(F.lit(run).alias("run"), "id", F.col("c").cast("long").alias("c")))
            took[run] = time.monotonic() - began
            return found

        at = transform.saved(_propagated_copies(graph, [generate.features(spark, x) for x in same])) if set(methods) & set(FEATURED) else None
        start = transform.checkpointed(searched(members, ids, g, "louvain", None, gamma=0.3, **options)) if "select_then_assign" in methods else None
        parts += inner.map(one, [run for run, (m, _) in enumerate(runs) if m not in METHODS])
        every = graph.nodes.join(spark.createDataFrame([(x,) for x in range(len(runs))], "run int"))
        found = every.join(functools.reduce(DataFrame.union, parts), ["run", "id"], "left").select("run", "id", F.coalesce("c", "id").alias("c"))
        rows = metrics.evaluate(graph.nodes, graph.arcs, transform.saved(found.join(graph.labels.select("id", "t"), "id")), title(same[0]), by=("run",))
        schemas.append(rows.schema)
        out = []
        for row in map(lambda r: r.asDict(), rows.collect()):
            run = row.pop("run")
            method, i = runs[run]
            head = {"algorithm": method, "run": 0, "memory": None, "code": 0, "time": took.get(run, 0.0), "iterations": 1}
            out += [row | head | {"instance": title(s), "graph": title(s)} for s in ([same[i]] if method in FEATURED else same)]
        return out

    schemas: list = []
    with ThreadPoolExecutor(GRAPHS) as pool, ThreadPoolExecutor(RUNS) as inner:
        rows = [row for found in pool.map(of_graph, alike.values()) for row in found]
    head = "algorithm string, instance string, run int, memory long, code int, time double, iterations int"
    schema = StructType([*StructType.fromDDL(head), *(x for x in schemas[0] if x.name != "run")])
    return spark.createDataFrame([tuple(row[c] for c in schema.names) for row in rows], schema)


def _propagated_copies(graph: Graph, features: list[DataFrame]) -> DataFrame:
    """(copy, id, f): ``propagated`` for each table of features, on as many copies of the graph that no arc joins."""
    n = (graph.nodes.agg(F.max("id")).first()[0] or 0) + 1
    moved = lambda column: (F.col("copy") * n + F.col(column)).alias(column)
    copies = graph.nodes.sparkSession.range(len(features)).withColumnRenamed("id", "copy")
    nodes = graph.nodes.join(copies).select(moved("id"))
    arcs = graph.arcs.join(copies).select(moved("src"), moved("dst"), "w")
    every = functools.reduce(DataFrame.union, [f.select(F.lit(i).alias("copy"), "id", "f") for i, f in enumerate(features)]).select(moved("id"), "f")
    return propagated(Graph(nodes, arcs, nodes), every).select(F.expr(f"id div {n}").alias("copy"), (F.col("id") % n).alias("id"), "f")
