"""Toy graphs with rows worked out by hand, identities, and text round trips."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft.functions.exact import rounded
from graphweft.operators import blocks, local, metrics, normalize, report, solvers, steps, transform
from graphweft.plans import registry
from graphweft.sources import generate, text
from graphweft.sources.views import Graph, both_directions
from graphweft.streaming import stream_cluster

from .conftest import DATA

TWO = "0-1 0-2 1-2 3-4 3-5 4-5 2-3"
ROWS = {
    "F1": ("0-1 0-2 1-2", [0, 0, 0], [0, 0, 0], "3,6,0.000000000,0,1,0.00000000,0.00000000,1.00000000,1.00000000,6,0,0,0,0.00000000,0.00000000,1.00000000,1.00000000"),
    "F2": ("0-1 0-2 1-2", [0, 1, 2], [0, 0, 1], "3,6,-0.333333333,-12,3,0.50000000,0.50000000,0.00000000,0.66666667,0,0,4,2,0.00000000,0.76117026,1.00000000,0.66666667"),
    "F3": (TWO, [0, 0, 0, 1, 1, 1], [0, 0, 0, 1, 1, 2], "6,14,0.357142857,70,2,0.07142857,0.05555556,0.80000000,0.71428571,8,4,2,0,0.70588235,0.82784750,0.83333333,1.00000000"),
    "F3b": (TWO, [0, 0, 1, 1, 1, 1], [0, 0, 0, 1, 1, 2], "6,14,0.122448979,24,2,0.25000000,0.12500000,0.44444444,0.28571429,4,6,0,4,0.03669725,0.39665383,0.66666667,0.83333333"),
    "F4": ("0-1:5 1-2:2", [0, 0, 1, 2], [0, 0, 1, 1], "4,4,-0.040816326,-8,2,0.33333333,0.19444444,1.00000000,1.00000000,2,0,2,0,0.57142857,0.81649658,1.00000000,0.75000000"),
}


def graph(spark, edges, c, t=None):
    rows = []
    for e in edges.split():
        ends, _, w = e.partition(":")
        u, v = map(int, ends.split("-"))
        rows.append((u, v, int(w or 1)))
    arcs = both_directions(spark.createDataFrame(rows, "src long, dst long, w long"))
    labels = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(c, t or c))], "id long, c int, t int")
    return Graph(spark.range(len(c)).select("id"), arcs, labels)


@pytest.mark.parametrize("name", ROWS)
def test_evaluator_rows(spark, name):
    edges, c, t, expected = ROWS[name]
    g = graph(spark, edges, c, t)
    line = metrics.evaluator_line(metrics.evaluate(g.nodes, g.arcs, g.labels, f"a/{name}")).first()["line"]
    assert line == f"{name},{expected}"


def test_zero_volume_clusters(spark):
    g = graph(spark, "0-1", [0, 0, 1, 7])
    row = metrics.evaluate(g.nodes, g.arcs, g.labels, "F5", truth=False)
    assert metrics.evaluator_line(row).first()["line"] == "F5,4,2,0.000000000,0,1,0.00000000,0.00000000"


def test_no_arcs(spark):
    g = graph(spark, "0-1", [0, 1])
    assert metrics.modularity(metrics.clusters(g.arcs.where("false"), g.labels)).first()["modularity"] is None


def test_move_and_merge_gains(spark):
    g = graph(spark, TWO, [0, 0, 0, 1, 1, 1])
    between = transform.quotient(g.arcs, g.labels)
    gain = steps.merge_gains(metrics.cluster_table(g.labels, between), between).first()
    assert (gain["a"], gain["b"], gain["gain"]) == (0, 1, -70)
    assert sorted(map(tuple, between.collect())) == [(0, 0, 6), (0, 1, 1), (1, 0, 1), (1, 1, 6)]


def test_normal_form(spark):
    arcs = spark.createDataFrame([(0, 1, 4), (0, 1, 3), (1, 0, 7), (2, 2, 1), (0, 9, 1)], "src long, dst long, w long")
    assert {(r.src, r.dst, r.w) for r in normalize.merge_arcs(arcs).collect()} == {(0, 1, 7), (1, 0, 7), (0, 9, 1)}
    assert {(r.src, r.dst, r.w) for r in normalize.dedup_arcs(arcs).collect()} == {(0, 1, 1), (1, 0, 1), (0, 9, 1)}
    found = {(r.rule, r.src, r.dst) for r in normalize.validate(spark.range(3), arcs, 2).collect()}
    assert found == {("endpoint", 0, 9), ("self_loop", 2, 2), ("repeated", 0, 1), ("asymmetric", 0, 9), ("edge_count", None, None)}


def test_metis_round_trip_and_traps(spark, tmp_path):
    g = graph(spark, TWO, [0] * 7)
    text.write_lines(text.metis_lines(g.nodes, g.arcs), str(tmp_path / "g"))
    read = text.read_metis(spark, str(tmp_path / "g"))
    assert {tuple(r) for r in read.arcs.collect()} == {tuple(r) for r in g.arcs.collect()}
    assert read.nodes.count() == 7 and read.header_edges == 7
    (tmp_path / "w").write_text("% a comment\n3 2 11\n5 2 4 2 3\n% another\n1 1 4 1 3 2 9\n9\n")
    weighted = text.read_metis(spark, str(tmp_path / "w"))
    assert {tuple(r) for r in normalize.merge_arcs(weighted.arcs).collect()} == {(0, 1, 7), (1, 0, 7)}
    (tmp_path / "l").write_text("-1\n\n3.5\n")
    assert [r.c for r in text.read_labels(spark, str(tmp_path / "l")).orderBy("id").collect()] == [1, 0, 3]
    (tmp_path / "f").write_text("2 2\n0.5 1\n\n-2 3e1\n")
    assert [r.f for r in text.read_features(spark, str(tmp_path / "f")).orderBy("id").collect()] == [[0.5, 1.0], [-2.0, 30.0]]
    assert text.truth_beside(spark, str(tmp_path / "g")) is None


def test_performance_profile(spark):
    rows = [("A", "i1", 0.8), ("A", "i1", 0.6), ("A", "i2", 0.5), ("B", "i1", 0.4), ("B", "i2", -0.1), ("A", "i3", 0.9), ("B", "i3", None)]
    profile = report.performance_profile(spark.createDataFrame(rows, "algorithm string, instance string, modularity double"))
    got = {a: [r.ratio for r in profile.where(F.col("algorithm") == a).orderBy("rank").collect()] for a in "AB"}
    assert got == {"A": [1.0, 1.0, 1.0, 1.0], "B": [1.0, 0.5, 0.0, None]}
    with pytest.raises(ValueError):
        report.best_per_instance(spark.range(1))


def test_label_permutation_and_self_agreement(spark):
    g = graph(spark, TWO, [0, 0, 0, 1, 1, 2])
    swapped = g.labels.select("id", (5 - F.col("c")).alias("c"), "t")
    values = [metrics.modularity(metrics.clusters(g.arcs, x)).first()["N"] for x in (g.labels, swapped)]
    assert values[0] == values[1]
    assert tuple(metrics.supervised_metrics(metrics.contingency(g.labels)).first()) == (1.0, 1.0, 1.0, 1.0)


def test_wcc_of_two_triangles(spark):
    g = graph(spark, "0-1 0-2 1-2 3-4 3-5 4-5", [0, 0, 0, 1, 1, 1])
    assert metrics.wcc(g.nodes, g.arcs, g.labels).first()["wcc"] == 1.0


def test_components_of_a_long_path(spark):
    n = 200
    arcs = both_directions(spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).cast("long").alias("w")))
    assert {r.rep for r in transform.connected_labels(spark.range(n), arcs).collect()} == {0}


def random_local(n=60, k=3, seed=1):
    draw, src, dst = random.Random(seed), [], []
    for u in range(n):
        for v in range(u):
            if draw.random() < (0.5 if u % k == v % k else 0.03):
                src += [u, v]
                dst += [v, u]
    return local.LocalGraph.of_arcs(n, src, dst, [1] * len(src))


@pytest.mark.parametrize("method", sorted(set(solvers.METHODS) - {"exact_small", "wt"}))
def test_methods_find_planted_clusters(method):
    g = random_local()
    labels = solvers.METHODS[method](g, {"seed": 0, "k": 3}, local.Clock(None))
    assert g.modularity(labels) >= 0.99 * g.modularity([u % 3 for u in range(60)])


def test_exact_is_never_beaten():
    for seed in range(4):
        g = random_local(8, 2, seed)
        best = g.numerator(local.exact_small(g))
        assert all(g.numerator(solvers.METHODS[m](g, {"seed": 0, "k": 3}, local.Clock(None))) <= best for m in solvers.METHODS if m != "exact_small")
    with pytest.raises(ValueError):
        local.exact_small(random_local(20))


def test_generator(spark):
    model = generate.BlockModel(n=300, degree=12.0)
    g, features = generate.block_model(spark, model)
    arcs = g.arcs.cache()
    assert normalize.validate(g.nodes, arcs).isEmpty()
    assert 9 < arcs.count() / 300 < 13
    assert features.count() == 300 and len(features.first()["f"]) == 32
    assert len(generate.sweep_settings()) == 58


def test_coarsening_keeps_quality(spark, monkeypatch):
    monkeypatch.setattr(solvers, "LOCAL_ARCS", 1500)
    g, _ = generate.block_model(spark, generate.BlockModel(n=200, degree=14.0))
    labels = solvers.solve(g, "louvain")
    assert labels.count() == 200
    assert metrics.modularity(metrics.clusters(g.arcs, labels)).first()["modularity"] > 0.3


def test_sweep_covers_settings_and_methods(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(solvers, "run_sweep", lambda spark, settings, methods, *a, **k: asked.update(settings=settings, methods=methods) or spark.range(1).withColumn("time", F.lit(0)))
    registry.QUERIES["sweep"](spark, None)
    assert asked["settings"] == generate.sweep_settings() and set(solvers.METHODS) - {"exact_small"} | set(solvers.FEATURED) | set(solvers.STREAMED) == set(asked["methods"])
    monkeypatch.undo()
    settings = [generate.BlockModel(n=120, signal=x) for x in (0.01, 3.0)]
    methods = ["louvain", "stream_nodes", "stream_edges", "propagate_kmeans"]
    got = solvers.run_sweep(spark, settings, methods, k=4).collect()
    assert sorted((r.algorithm, r.instance) for r in got) == sorted((m, f"a0.8-s{s.signal:.4f}") for m in methods for s in settings)
    assert all(r.graph == r.instance and r.nodes == 120 for r in got)
    value = {(r.algorithm, r.instance): r.modularity for r in got}
    alone = solvers.solve(generate.block_model(spark, settings[0])[0], "louvain", 0)
    expected = metrics.modularity(metrics.clusters(generate.block_model(spark, settings[0])[0].arcs, alone)).first()["modularity"]
    assert value["louvain", "a0.8-s0.0100"] == value["louvain", "a0.8-s3.0000"] == expected
    assert value["propagate_kmeans", "a0.8-s0.0100"] != value["propagate_kmeans", "a0.8-s3.0000"]


def test_edge_stream_operator(spark, tmp_path):
    """The stateful operator and the one-task pass agree on the same order."""
    draw = random.Random(3)
    rows = [(i, draw.randrange(8) + 8 * (i % 2), draw.randrange(8) + 8 * (i % 2)) for i in range(120)]
    edges = spark.createDataFrame(rows, "pos long, src long, dst long")
    batch = {r.id: r.c for r in stream_cluster.stream_edges(edges, 100).collect()}
    edges.coalesce(1).write.parquet(str(tmp_path / "edges"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("pos long, src long, dst long").parquet(str(tmp_path / "edges"))
    started = stream_cluster.edge_stream(stream, 100).writeStream.outputMode("update").format("memory").queryName("communities").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        started.processAllAvailable()
        assert {r.id: r.c for r in spark.table("communities").collect()} == batch
    finally:
        started.stop()


def test_isolated_nodes_keep_their_label(spark, monkeypatch):
    """More isolated nodes than one process takes are no reason to fail."""
    from graphweft.operators import solvers
    from graphweft.sources.views import Graph

    monkeypatch.setattr(solvers, "LOCAL_NODES", 20)
    pairs = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)]
    arcs = spark.createDataFrame([(a, b, 1) for x, y in pairs for a, b in ((x, y), (y, x))], "src long, dst long, w long")
    graph = Graph(spark.range(200).toDF("id"), arcs, None)
    for method in ("louvain", "cnm", "walktrap"):
        found = {r.id: r.c for r in solvers.solve(graph, method).collect()}
        assert found == {i: 0 if i < 3 else 3 if i < 6 else i for i in range(200)}


def test_threshold_clusters_have_no_cap(spark):
    rows = [(g * 10 + i, [float(g % 10), float(g // 10), 0.01 * i]) for g in range(100) for i in range(10)]
    found = {r.id: r.c for r in solvers.threshold_clusters(spark.createDataFrame(rows, "id long, f array<double>"), 0.5).collect()}
    assert len(found) == 1000 and len(set(found.values())) == 100
    assert all(c // 10 == i // 10 for i, c in found.items())


def test_leaders_are_paired_block_by_block(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(600, 64))
    points = np.concatenate((points, points[:100] + 0.001))
    points /= np.linalg.norm(points, axis=1)[:, None]
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "id long, f array<double>")
    monkeypatch.setattr(blocks, "HELD", 64 * 128)
    near = {(r.id, r.j) for r in blocks.nearer(frame, 1.2).collect()}
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    assert near == {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(distance < 1.2))) if j < i}
    assert {r.id: r.c for r in solvers.threshold_clusters(frame, 0.5).collect()} == {i: i % 600 for i in range(700)}


def test_nearest_centres_block_by_block(spark, monkeypatch):
    rng = np.random.default_rng(5)
    f, u = rng.normal(size=(500, 8)), rng.normal(size=(60, 8))
    f[7, 3] = np.nan
    frame = lambda rows, name: spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in x]) for i, x in enumerate(rows)], f"{name} long, f array<double>")
    monkeypatch.setattr(blocks, "HELD", 100)
    found = {r.id: r.c for r in blocks.nearest(frame(f, "id"), frame(u, "c")).collect()}
    assert found == dict(enumerate(np.nansum((f[:, None] - u[None]) ** 2, axis=2).argmin(axis=1).tolist()))


def test_sweep_over_lists_is_the_sweep(spark):
    draw = random.Random(4)
    g = graph(spark, " ".join(f"{a}-{b}:{draw.randint(1, 5)}" for a, b in {tuple(sorted(draw.sample(range(80), 2))) for _ in range(300)}), [0] * 80)
    loops = g.arcs.union(spark.range(0, 80, 3).selectExpr("id AS src", "id AS dst", "cast(4 AS long) AS w"))
    degrees = metrics.node_degrees(g.nodes, loops)
    total = degrees.agg(F.sum("k")).first()[0]
    near = blocks.lists(g.arcs, "src", "dst", "w")
    for labels in (g.nodes.selectExpr("id", "id AS c"), g.nodes.selectExpr("id", "id % 11 AS c")):
        for down in (True, False):
            found = {r.id: r.c for r in steps.listed_sweep(near, labels, degrees, total, down).collect()}
            assert found == {r.id: r.c for r in steps.louvain_sweep(g.nodes, loops, labels, down).collect()}
            assert len(found) == 80


def test_walk_lists_are_packed_without_loss():
    rng = np.random.default_rng(6)
    for values in (rng.random(500), np.full(500, 0.1), rng.integers(1, 90, 500) / 7, np.array([-0.0, 0.0, np.nan] * 100), np.array([0.3])):
        for m in (np.sort(rng.choice(60_000, len(values), replace=False)), rng.integers(-(1 << 62), 1 << 62, len(values))):
            found, x = blocks._unpack(len(m), blocks._pack(m, values))
            order = np.argsort(m, kind="stable")
            assert found.tolist() == m[order].tolist() and x.tobytes() == values[order].tobytes()
    near = np.sort(rng.choice(51_282, 400, replace=False))
    assert len(blocks._pack(near, 1 / rng.integers(330, 480, 400))) < 400 * 6


def test_lists_of_rows_in_small_batches(spark):
    rows = [(i % 7, i, i / 2) for i in range(100)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = blocks.lists(spark.createDataFrame(rows, "k long, v long, w double"), "k", "v", "w").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r.id for r in found) == list(range(7))
    assert all(sorted(zip(r.m, r.x)) == [(v, w) for k, v, w in rows if k == r.id] for r in found)


def test_a_folder_of_lines_is_read_in_the_order_of_its_parts(spark, tmp_path):
    g = graph(spark, " ".join(f"{i}-{i + 1}" for i in range(59)), [0] * 60)
    lines = [r["line"] for r in text.metis_lines(g.nodes, g.arcs).orderBy("row").collect()]
    for part, at in enumerate(range(0, len(lines), 3), 99_990):
        (tmp_path / f"part-{part}-x.txt").write_text("".join(f"{x}\n" for x in lines[at : at + 3]))
    (tmp_path / "_SUCCESS").write_text("")
    assert [r["line"] for r in text.numbered_lines(spark, str(tmp_path)).orderBy("pos").collect()] == lines
    assert sorted(map(tuple, text.read_metis(spark, str(tmp_path)).arcs.collect())) == sorted(map(tuple, g.arcs.collect()))


def test_weighted_lines_in_many_parts(spark, tmp_path):
    g = graph(spark, " ".join(f"{i}-{i + 1}:{i + 2}" for i in range(59)), [0] * 60)
    lines = [r["line"] for r in text.weighted_metis_lines(g.nodes, g.arcs).orderBy("row").collect()]
    for part, at in enumerate(range(0, len(lines), 3)):
        (tmp_path / f"part-{part:05}-x.txt").write_text("".join(f"{x}\n" for x in lines[at : at + 3]))
    assert sorted(map(tuple, text.read_metis(spark, str(tmp_path)).arcs.collect())) == sorted(map(tuple, g.arcs.collect()))


def test_feature_lines_round_the_binary_value(spark):
    rows = [(0, [0.0000005, 2.5e-07, -1.0000015, 0.1000005]), (1, [float("nan"), None, float("-inf"), -0.0]), (2, None), (3, [])]
    found = dict(map(tuple, text.feature_lines(spark.createDataFrame(rows, "id long, f array<double>")).collect()))
    assert found == {0: "4 4", 1: f"{0.0000005:.6f} {2.5e-07:.6f} {-1.0000015:.6f} {0.1000005:.6f}", 2: "nan -inf -0.000000", 3: None, 4: None}


def test_rounded_like_sql_engines(spark):
    import duckdb

    values = [0.00029999999999999997, 0.00034999999999999994, -0.8989499999999999, 2.5e-5, -2.5e-5, 0.5, 1e300, -1e306, 1.7e-9, float("inf"), None]
    values += [(-1) ** i * (i / 1e5 - i * 2**-58) for i in range(1, 2000)]
    data = spark.createDataFrame(list(enumerate(values)), "i long, x double")
    found = [r["y"] for r in data.select("i", rounded(F.col("x"), 4).alias("y")).orderBy("i").collect()]
    assert found == [duckdb.execute("select round(?::double, 4)", [x]).fetchone()[0] for x in values]


def test_common_neighbours_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD", 40)
    monkeypatch.setattr(blocks, "PASSING", 50)
    monkeypatch.setattr(blocks, "RETURNED", 7)
    draw = random.Random(4)
    near = {i: sorted({draw.randrange(30) for _ in range(5)} - {i}) for i in range(30)}
    arcs = spark.createDataFrame([(i * 10**12, j * 10**12, 1 + (i + j) % 3) for i in near for j in near[i]], "src long, dst long, w long")
    counts = {}
    for m in near:
        for a in near[m]:
            for b in near[m]:
                if a < b:
                    counts[a * 10**12, b * 10**12] = counts.get((a * 10**12, b * 10**12), 0) + 1
    assert {(r["a"], r["b"]): r["n"] for r in steps.two_hop_cooccurrence(arcs).collect()} == counts


def test_walks_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD", 40)
    monkeypatch.setattr(blocks, "PASSING", 50)
    draw = random.Random(5)
    near = {i: {j: 1 + (i + j) % 3 for j in {draw.randrange(30) for _ in range(5)} - {i}} for i in range(30)}
    at = {i: {i: 1.0} for i in near}
    for _ in range(3):
        after = {i: {} for i in near}
        for i in at:
            for m, p in at[i].items():
                for j, w in near[m].items():
                    after[i][j] = after[i].get(j, 0) + p * w / sum(near[m].values())
        at = after
    arcs = spark.createDataFrame([(i, j, w) for i in near for j, w in near[i].items()], "src long, dst long, w long")
    found = {(r["src"], r["dst"]): r["p"] for r in steps.walk_distribution(arcs, 3).collect()}
    assert found == pytest.approx({(i, j): p for i in at for j, p in at[i].items()})


def test_wcc_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD", 30)
    monkeypatch.setattr(blocks, "PASSING", 40)
    draw = random.Random(6)
    pairs = sorted({tuple(sorted(draw.sample(range(24), 2))) for _ in range(90)})
    g = graph(spark, " ".join(f"{u}-{v}" for u, v in pairs), [i % 3 for i in range(24)])
    near = {i: {v for u, v in pairs if u == i} | {u for u, v in pairs if v == i} for i in range(24)}
    total = 0.0
    for x in near:
        closing = [(y, z) for y in near[x] for z in near[x] if y < z and z in near[y]]
        inside = [(y, z) for y, z in closing if y % 3 == z % 3 == x % 3]
        ends = {v for pair in closing for v in pair}
        below = 8 - 1 + len(ends) - len([v for v in ends if v % 3 == x % 3])
        total += len(inside) / len(closing) * len(ends) / below if closing else 0.0
    repeated = g.arcs.union(g.arcs.where("src % 4 = 0")).union(g.arcs.limit(1).select("src", F.col("src").alias("dst"), "w"))
    assert metrics.wcc(g.nodes, repeated, g.labels).first()["wcc"] == pytest.approx(total / 24, abs=1e-6)


def test_means_of_neighbours_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD", 6)
    monkeypatch.setattr(blocks, "PASSING", 6)
    arcs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 0), (2, 0), (2, 3), (3, 4), (4, 4), (5, 9)], "src long, dst long")
    features = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, None]), (2, [5.0, 8.0, 4.0]), (3, None), (4, [None, 1.0])], "id long, f array<double>")
    found = dict(map(tuple, blocks.neighbour_means(blocks.lists(arcs, "src", "dst"), features).collect()))
    assert found == {0: [4.0, 8.0, 4.0], 1: [1.0, 2.0], 2: [1.0, 2.0], 3: [None, 1.0], 4: [None, 1.0]}


def test_best_of_coarsens_once(spark, monkeypatch):
    calls, before = [], solvers.coarsened
    monkeypatch.setattr(solvers, "coarsened", lambda g: calls.append(1) or before(g))
    g = graph(spark, TWO, [0] * 6)
    labels = {r["id"]: r["c"] for r in solvers.best_of(g, "louvain").collect()}
    assert len(calls) == 1 and labels == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


def test_node_stream_places_and_moves():
    state = stream_cluster.NodeClusterer(14)
    near = {0: [1, 2], 1: [0, 2], 2: [0, 1, 3], 3: [2, 4, 5], 4: [3, 5], 5: [3, 4]}
    state.arrive(np.arange(6) * 10**12)
    rows = {u: (state.codes(np.array(v) * 10**12), np.ones(len(v), np.int64)) for u, v in near.items()}
    assert all([state.add(u, *rows[u]) for u in near]) and not any([state.add(u, *rows[u]) for u in near])
    assert state.community[:6].tolist() == [0, 0, 0, 3, 3, 3]


def test_documents_with_gaps_in_their_ids_pass_through_metis(spark, tmp_path):
    table = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").where("doc_id < 60")
    table.selectExpr("doc_id * 7 + 1000 AS doc_id", "text", "lang", "source").unionByName(spark.createDataFrame([(1000, "again", "en", "x"), (None, None, "en", "x")], table.selectExpr("doc_id", "text", "lang", "source").schema)).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("metis_scan", "metis_weighted_scan"):
        got = sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).select("src", "dst", "w").collect()))
        assert got and got == sorted(con.execute(f"select src, dst, w from ({registry.SQL[name]})").fetchall())


def test_clusterings_evaluated_together(spark):
    draw = random.Random(9)
    g = graph(spark, TWO, [0] * 6)
    rows = {run: [(i, draw.randrange(3), draw.randrange(2)) for i in range(6)] for run in range(4)}
    for arcs in (g.arcs, g.arcs.where("src < 0")):
        alone = [metrics.evaluate(g.nodes, arcs, spark.createDataFrame(x, "id long, c int, t int"), "x").first().asDict() for x in rows.values()]
        labels = spark.createDataFrame([(run, *r) for run, x in rows.items() for r in x], "run int, id long, c int, t int")
        found = {r.run: r.asDict() for r in metrics.evaluate(g.nodes, arcs, labels, "x", by=("run",)).collect()}
        assert [str({k: v for k, v in found[run].items() if k != "run"}) for run in rows] == [str(x) for x in alone]


def test_shifts_between_two_communities():
    draw = random.Random(5)
    arcs = [(a, b, draw.randint(1, 3)) for a, b in {tuple(draw.sample(range(14), 2)) for _ in range(40)}]
    g = local.LocalGraph.of_arcs(14, *zip(*arcs, *((b, a, w) for a, b, w in arcs), (3, 3, 4)))
    labels = [draw.randrange(3) for _ in range(14)]
    for a, b in ((0, 1), (1, 0), (2, 1), (0, None)):
        now, to, steps_ = list(labels), 3 if b is None else b, [(0, [])]
        while a in now:
            tried = [(g.numerator([to if v == u else c for v, c in enumerate(now)]), -u) for u in range(14) if now[u] == a]
            value, u = max(tried)
            now[-u] = to
            steps_.append((value - g.numerator(labels), [*steps_[-1][1], -u]))
        assert local._Shifts(g).best(np.array(labels), a, b) == max(steps_, key=lambda x: x[0])
    assert local.combo(local.LocalGraph([{}, {}], [1, 1])) == [0, 1]


def test_passes_over_few_clusters_are_those_of_single_nodes(monkeypatch):
    draw = random.Random(8)
    near = {i: {} for i in range(60)}
    for a, b in {tuple(sorted((draw.randrange(60), draw.randrange(60)))) for _ in range(240)}:
        near[a][b] = near[b][a] = draw.randint(1, 4)
    total = sum(w for x in near.values() for w in x.values())
    ends = []
    for few in (stream_cluster.FEW, 0):
        monkeypatch.setattr(stream_cluster, "FEW", few)
        state = stream_cluster.NodeClusterer(total)
        state.arrive(np.arange(60))
        rows = [(u, np.array(list(x), np.int32), np.array(list(x.values()), np.int64)) for u, x in near.items()]
        for row in rows:
            state.add(*row)
        moved = [state.again(iter(rows)) for _ in range(20)]
        assert moved[0] and not moved[-1]
        ends.append((moved, state.community[:60].tolist(), state.volume[:60].tolist()))
    plain = stream_cluster.NodeClusterer(total)
    plain.arrive(np.arange(60))
    passes = [any([plain.add(*row) for row in rows]) for _ in range(21)]
    assert ends[0] == ends[1] == (passes[1:], plain.community[:60].tolist(), plain.volume[:60].tolist())


def test_restreaming_ends_with_the_refined_quotient(spark):
    """Two passes leave clusters whose union has a larger modularity; all nodes keep a row."""
    draw = random.Random(1)
    pairs = sorted({tuple(sorted(draw.sample(range(60), 2))) for _ in range(150)})
    g = graph(spark, " ".join(f"{a}-{b}" for a, b in pairs), [0] * 60)
    value = lambda labels: int(metrics.modularity(metrics.clusters(g.arcs, labels)).first()["N"])
    streamed = stream_cluster.stream_nodes(g.arcs, None)
    assert value(streamed) == value(stream_cluster.stream_nodes(g.arcs, 1000))
    found = solvers.restreamed(g)
    assert {r.id for r in found.collect()} == {r.id for r in streamed.collect()}
    assert value(found) > value(streamed)
    # the refinement merges whole clusters
    both = streamed.join(found.withColumnRenamed("c", "d"), "id")
    assert both.groupBy("c").agg(F.count_distinct("d").alias("n")).where("n > 1").isEmpty()


def test_walks_held_whole_and_in_blocks_are_the_same(spark, monkeypatch):
    draw = random.Random(7)
    rows = [(draw.randrange(25) * 10**11, draw.randrange(25) * 10**11, draw.randint(1, 4)) for _ in range(90)]
    arcs = spark.createDataFrame([*rows, (25 * 10**11, 26 * 10**11, 1)], "src long, dst long, w long")
    found = []
    for whole in (blocks.WHOLE, 0):
        monkeypatch.setattr(blocks, "WHOLE", whole)
        found.append({(r["src"], r["dst"]): r["p"] for r in steps.walk_distribution(arcs).collect()})
    assert found[0] == pytest.approx(found[1]) and all(src < 25 * 10**11 for src, _ in found[0])


def test_the_registered_walks_have_four_steps(spark, tmp_path):
    """A path of nodes: two steps reach no node three or four away."""
    angle = [i * 1.2 for i in range(6)]
    spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))], 0) for i, a in enumerate(angle[:4])], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {(r.src, r.dst): r.p for r in registry.QUERIES["walk_distribution"](spark, str(tmp_path)).collect()}
    step = np.array([[0, 1, 0, 0], [0.5, 0, 0.5, 0], [0, 0.5, 0, 0.5], [0, 0, 1, 0]])
    four = np.linalg.matrix_power(step, 4)
    assert found == {(i, j): four[i, j] for i in range(4) for j in range(4) if four[i, j]}


def test_packed_lists_in_small_pieces(spark, monkeypatch):
    draw = random.Random(2)
    monkeypatch.setattr(blocks, "PIECE", 20)
    rows = [(draw.randrange(6) * 10**12, draw.randrange(40) - 20, float(draw.randrange(3))) for _ in range(400)]
    frame = spark.createDataFrame(rows, "k long, v long, w double").repartition(3)
    plain = {r.id: blocks._unpack(r.n, r.packed) for r in blocks.packed_lists(frame, "k", "v").collect()}
    valued = {r.id: blocks._unpack(r.n, r.packed) for r in blocks.packed_lists(frame, "k", "v", "w").collect()}
    once = {r.id: blocks._unpack(r.n, r.packed)[0].tolist() for r in blocks.packed_lists(frame, "k", "v", once=True).collect()}
    for k in {r[0] for r in rows}:
        assert plain[k][0].tolist() == sorted(v for i, v, _ in rows if i == k) and plain[k][1] is None
        assert sorted(zip(*map(np.ndarray.tolist, valued[k]))) == sorted((v, w) for i, v, w in rows if i == k)
        assert once[k] == sorted({v for i, v, _ in rows if i == k})


def test_lists_are_sent_in_few_bytes(spark):
    """What blocks of neighbour lists send and hold: some two bytes an entry, which took eight."""
    arcs = spark.range(200_000).selectExpr("id div 1000 AS src", "(id % 1000) * 50 + hash(id) % 25 AS dst")
    size = blocks.packed_lists(arcs, "src", "dst").selectExpr("sum(length(packed)) / sum(n)").first()[0]
    assert size < 2.5
