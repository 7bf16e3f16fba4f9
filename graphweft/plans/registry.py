"""The registered graph queries. Each takes (spark, sf_dir) and covers its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.functions.exact import rounded
from graphweft.operators import metrics, normalize, report, solvers, steps, transform
from graphweft.plans.folders import own_folder
from graphweft.plans.oracle import SQL
from graphweft.sources import generate, text, views
from graphweft.streaming import stream_cluster

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _clusters(graph):
    return metrics.clusters(graph.arcs, graph.labels)


@query
def eval_row(spark, sf_dir):
    g = views.trade(spark, sf_dir)
    return metrics.evaluate(g.nodes, g.arcs, g.labels, "trade")


# sources and sinks


@query
def selfloop_drop(spark, sf_dir):
    return normalize.drop_self_loops(views.event_stream(spark, sf_dir))


@query
def default_features(spark, sf_dir):
    return steps.default_features(views.trade(spark, sf_dir).nodes).select("id", F.col("f")[0].alias("f0"))


@query
def edges_upper(spark, sf_dir):
    return normalize.upper_edges(views.trade(spark, sf_dir).arcs)


@query
def metis_lines(spark, sf_dir):
    g = views.documents_graph(spark, sf_dir)
    return text.metis_lines(g.nodes, g.arcs)


@query
def label_lines(spark, sf_dir):
    return text.label_lines(views.trade(spark, sf_dir).labels)


@query
def feature_lines(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings")
    return text.feature_lines(vectors.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("f")))


# normal form


@query
def arcs_dedup(spark, sf_dir):
    return normalize.dedup_arcs(views.copurchase_pairs(spark, sf_dir))


@query
def arcs_merge(spark, sf_dir):
    return normalize.merge_arcs(views.copurchase_pairs(spark, sf_dir).withColumn("w", F.lit(1).cast("long")))


@query
def graph_stats(spark, sf_dir):
    g = views.trade(spark, sf_dir)
    return metrics.graph_stats(g.nodes, g.arcs)


def _spoiled(graph):
    """The trade arcs with missing, repeated, looping and dangling ones."""
    arcs, one = graph.arcs.select("src", "dst", "w"), F.lit(1).cast("long")
    loops = graph.nodes.where("id % 10 = 0").select(F.col("id").alias("src"), F.col("id").alias("dst"), one.alias("w"))
    dangling = graph.nodes.where("id % 100 = 0").select(F.col("id").alias("src"), F.lit(-1).cast("long").alias("dst"), one.alias("w"))
    return arcs.where("(src + dst) % 7 <> 0").union(arcs.where("src % 50 = 0")).union(loops).union(dangling)


@query
def validate_graph(spark, sf_dir):
    g = views.trade(spark, sf_dir)
    return normalize.validate(g.nodes, _spoiled(g))


@query
def validate_header(spark, sf_dir):
    """The violations with a header that names a wrong number of edges."""
    g = views.trade(spark, sf_dir)
    return normalize.validate(g.nodes, _spoiled(g), 7).na.fill(-1, ["src", "dst"])


@query
def asymmetric_arcs(spark, sf_dir):
    return normalize.asymmetric_arcs(_spoiled(views.trade(spark, sf_dir)))


@query
def graph_diff(spark, sf_dir):
    g = views.trade(spark, sf_dir)
    return normalize.graph_diff(_spoiled(g), g.arcs)


# transforms


@query
def contract_clusters(spark, sf_dir):
    g = views.trade(spark, sf_dir)
    weights, arcs = transform.contract(g.arcs, g.labels)
    node = weights.select(F.lit("node").alias("kind"), F.col("id").cast("long").alias("src"), F.col("id").cast("long").alias("dst"), F.col("vw").alias("w"))
    return node.union(arcs.select(F.lit("arc").alias("kind"), F.col("src").cast("long"), F.col("dst").cast("long"), "w"))


@query
def contract_keep_diag(spark, sf_dir):
    g = views.trade(spark, sf_dir)
    return transform.contract_keep_diagonal(g.arcs, g.labels)


@query
def components_active(spark, sf_dir):
    g = views.documents_graph(spark, sf_dir)
    return transform.connected_labels(g.nodes, g.arcs)


@query
def components_within_cluster(spark, sf_dir):
    g = views.documents_graph(spark, sf_dir)
    return transform.components_within_clusters(g.nodes, g.arcs, g.labels)


@query
def compact_labels(spark, sf_dir):
    return transform.compact_labels(views.trade(spark, sf_dir).labels.select("id", (F.col("c") * 10 + 3).alias("c")))


@query
def symmetrize_selfloops(spark, sf_dir):
    g = views.copurchase(spark, sf_dir)
    return normalize.symmetrize(g.nodes, g.arcs, self_loops=True)


@query
def csr_offsets(spark, sf_dir):
    g = views.trade(spark, sf_dir)
    return transform.csr_offsets(g.nodes, g.arcs).withColumnRenamed("offset", "offset_")


# structure


@query
def node_degree(spark, sf_dir):
    g = views.trade(spark, sf_dir)
    return metrics.node_degrees(g.nodes, g.arcs)


@query
def cluster_sizes(spark, sf_dir):
    return views.trade(spark, sf_dir).labels.groupBy("c").agg(F.count(F.lit(1)).alias("size"))


@query
def cluster_volume(spark, sf_dir):
    return _clusters(views.trade(spark, sf_dir)).select("c", "volume")


@query
def cluster_cut(spark, sf_dir):
    return _clusters(views.trade(spark, sf_dir)).select("c", "cut")


@query
def coverage_parts(spark, sf_dir):
    return metrics.coverage_parts(_clusters(views.trade(spark, sf_dir)))


@query
def modularity(spark, sf_dir):
    return metrics.modularity(_clusters(views.trade(spark, sf_dir)))


@query
def modularity_copurchase(spark, sf_dir):
    return metrics.modularity(_clusters(views.copurchase(spark, sf_dir)))


@query
def modularity_knn(spark, sf_dir):
    return metrics.modularity(_clusters(views.knn(spark, sf_dir)))


@query
def modularity_gamma(spark, sf_dir):
    return metrics.modularity(_clusters(views.trade(spark, sf_dir)), 2)


@query
def cluster_conductance(spark, sf_dir):
    return metrics.cluster_conductance(_clusters(views.trade(spark, sf_dir)))


@query
def cluster_conductance_std(spark, sf_dir):
    return metrics.cluster_conductance(_clusters(views.trade(spark, sf_dir)), halved=False)


@query
def inter_cluster_conductance(spark, sf_dir):
    return metrics.inter_cluster_conductance(_clusters(views.trade(spark, sf_dir)))


@query
def cluster_cut_ratio(spark, sf_dir):
    return metrics.cluster_cut_ratio(_clusters(views.trade(spark, sf_dir)))


@query
def structure_metrics(spark, sf_dir):
    return metrics.structure_metrics(_clusters(views.trade(spark, sf_dir)))


@query
def coverage(spark, sf_dir):
    return metrics.coverage(_clusters(views.trade(spark, sf_dir)))


@query
def performance(spark, sf_dir):
    g = views.copurchase(spark, sf_dir)
    return metrics.performance(g.arcs, g.labels)


@query
def map_equation(spark, sf_dir):
    g = views.trade(spark, sf_dir)
    return metrics.map_equation_of(g.nodes, g.arcs, g.labels)


@query
def wcc(spark, sf_dir):
    g = _near(spark, sf_dir)
    return metrics.wcc(g.nodes, g.arcs, g.labels)


@query
def soft_modularity(spark, sf_dir):
    g = views.trade(spark, sf_dir)
    soft = g.labels.select("id", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i == F.col("t"), 0.6).otherwise(0.1)).alias("s"))
    return metrics.soft_modularity(g.arcs, metrics.node_degrees(g.nodes, g.arcs), soft)


# agreement


@query
def edge_confusion(spark, sf_dir):
    g = views.trade(spark, sf_dir)
    return metrics.edge_confusion(g.arcs, g.labels)


@query
def edge_f1(spark, sf_dir):
    g = views.trade(spark, sf_dir)
    return metrics.edge_scores(metrics.edge_confusion(g.arcs, g.labels))


@query
def contingency(spark, sf_dir):
    return metrics.contingency(views.copurchase(spark, sf_dir).labels)


@query
def contingency_cube(spark, sf_dir):
    return metrics.contingency_cube(views.copurchase(spark, sf_dir).labels)


@query
def supervised_metrics(spark, sf_dir):
    return metrics.supervised_metrics(metrics.contingency(views.documents_graph(spark, sf_dir).labels))


def _agreement(*columns):
    return lambda spark, sf_dir: metrics.supervised_metrics(metrics.contingency(views.copurchase(spark, sf_dir).labels)).select(*columns)


QUERIES |= {"ari": _agreement("ari"), "nmi": _agreement("nmi"), "purity": _agreement("purity", "invpurity")}


# reports


def results(spark, sf_dir):
    """A table of runs made from the events: the type is the algorithm, a group of users the instance."""
    value, group = F.col("value"), F.col("user_id") % 12
    quality = F.when((F.col("event_type") == "error") & (group < 3), None).when((F.col("event_type") == "view") & (group == 5), -value).otherwise(value)
    return views.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("algorithm"), F.concat(F.lit("g"), group.cast("string")).alias("instance"), F.col("event_id").cast("int").alias("run"), quality.alias("modularity"),
        (value * 2).alias("time"), (F.col("user_id") * 100 + 10).alias("edges"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(16).alias("threads"), (F.col("user_id") * 20000).alias("memory"),
    )


QUERIES |= {
    "best_per_instance": lambda s, d: report.best_per_instance(results(s, d)),
    "opt_per_instance": lambda s, d: report.opt_per_instance(results(s, d)),
    "ratio_to_best": lambda s, d: report.ratio_to_best(results(s, d)).withColumn("ratio", rounded(F.col("ratio"))),
    "performance_profile": lambda s, d: report.performance_profile(results(s, d)),
    "performance_profile_wide": lambda s, d: report.performance_profile_wide(results(s, d)),
    "geomean_summary": lambda s, d: report.geomean_summary(results(s, d)),
    "improvement_log": lambda s, d: report.improvement_log(results(s, d)),
    "best_run": lambda s, d: report.best_run(results(s, d)),
    "speedup": lambda s, d: report.speedup(results(s, d)),
    "memory_table": lambda s, d: report.memory_table(results(s, d)),
    "run_status": lambda s, d: report.run_status(results(s, d), 100, 2_500_000),
}


# steps of clustering methods


@query
def label_propagation_round(spark, sf_dir):
    g = views.trade(spark, sf_dir)
    return steps.label_propagation_round(g.nodes, g.arcs, g.labels)


@query
def louvain_sweep(spark, sf_dir):
    g = views.copurchase(spark, sf_dir)
    return steps.louvain_sweep(g.nodes, g.arcs, g.labels)


def _gains(spark, sf_dir):
    g = views.trade(spark, sf_dir)
    between = transform.quotient(g.arcs, g.labels)
    return steps.merge_gains(metrics.cluster_table(g.labels, between), between)


@query
def cnm_merge_step(spark, sf_dir):
    return steps.best_merge(_gains(spark, sf_dir))


@query
def wt_merge_step(spark, sf_dir):
    return steps.best_merge(_gains(spark, sf_dir), "score")


@query
def overlay_clustering(spark, sf_dir):
    return steps.overlay(views.copurchase(spark, sf_dir).labels)


def _one_hot(graph):
    return graph.labels.select("id", F.col("t").alias("i"), F.lit(1).cast("long").alias("x"))


@query
def gnns_step(spark, sf_dir):
    g = views.trade(spark, sf_dir)
    out = steps.soft_step(g.arcs, metrics.node_degrees(g.nodes, g.arcs), _one_hot(g))
    return out.select("id", "i", rounded(F.col("x")).alias("x"))


@query
def argmax_assign(spark, sf_dir):
    g = views.trade(spark, sf_dir)
    near = g.arcs.join(g.labels.select(F.col("id").alias("dst"), F.col("t").alias("i")), "dst").groupBy(F.col("src").alias("id"), "i").agg(F.sum("w").alias("x"))
    return steps.argmax_assign(near)


def _points(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings")
    return vectors.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double"))).alias("v"))


@query
def kmeans_step(spark, sf_dir):
    points = _points(spark, sf_dir)
    return steps.kmeans_step(points, points.where("id < 10").select(F.col("id").cast("int").alias("c"), F.col("v").alias("u")))


@query
def neighbor_sample(spark, sf_dir):
    return steps.neighbor_sample(views.copurchase(spark, sf_dir).arcs)


@query
def walk_distribution(spark, sf_dir):
    # a sum that is a tie at 8 digits does not follow the order of its parts if it is rounded at 12 before
    return steps.walk_distribution(_near(spark, sf_dir).arcs).select("src", "dst", rounded(rounded(F.col("p"), 12)).alias("p"))


@query
def two_hop_cooccurrence(spark, sf_dir):
    return steps.two_hop_cooccurrence(_near(spark, sf_dir).arcs)


@query
def modularity_matrix_entries(spark, sf_dir):
    g = views.trade(spark, sf_dir)
    return steps.modularity_entries(g.nodes, g.arcs)


@query
def select_large_communities(spark, sf_dir):
    return steps.select_large_communities(views.documents_graph(spark, sf_dir).labels)


def _features(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings")
    return vectors.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("f"))


def _long(features):
    return features.select("id", F.posexplode("f").alias("pos", "x")).select("id", "pos", rounded(F.col("x")).alias("x"))


@query
def features_row_norm(spark, sf_dir):
    return _long(steps.row_normalized(_features(spark, sf_dir).select("id", F.transform("f", F.abs).alias("f"))))


@query
def sigmoid_probabilities(spark, sf_dir):
    return _long(steps.sigmoid(_features(spark, sf_dir)))


@query
def features_l2_norm(spark, sf_dir):
    return _long(steps.l2_normalized(_features(spark, sf_dir)))


# generator


@query
def adcsbm_params(spark, sf_dir):
    sizes = spark.range(4).select(F.col("id").cast("int").alias("c"), F.lit(250).cast("long").alias("size"))
    return generate.params(sizes, generate.BlockModel())


@query
def adcsbm_nodes(spark, sf_dir):
    return generate.nodes(spark, generate.BlockModel())


@query
def adcsbm_edges(spark, sf_dir):
    return generate.edges(spark, generate.BlockModel())


@query
def adcsbm_features(spark, sf_dir):
    return generate.features(spark, generate.BlockModel())


@query
def adcsbm(spark, sf_dir):
    graph, _ = generate.block_model(spark, generate.BlockModel())
    return metrics.evaluate(graph.nodes, graph.arcs, graph.labels, "adcsbm")


# clustering methods: labels (id, c) of the graph of near vectors, with the vectors as features; another graph where it says so


def _near(spark, sf_dir):
    """The graph of near vectors with each edge in a table once."""
    g = views.knn(spark, sf_dir)
    return views.Graph(g.nodes, views.both_directions(transform.saved(g.arcs.where("src < dst"))), g.labels)


def _solver(method, **options):
    def run(spark, sf_dir):
        return solvers.solve(_near(spark, sf_dir), method, **options)

    return run


QUERIES |= {
    "cnm": _solver("cnm"), "wt": _solver("wt"), "louvain": _solver("louvain"), "leiden": _solver("leiden"), "walktrap": _solver("walktrap"), "infomap": _solver("infomap"), "combo": _solver("combo"),
    "memetic": _solver("memetic", limit=20.0), "gnns": _solver("gnns", k=4), "soft_modularity_ascent": _solver("soft_modularity_ascent", k=4),
}


@query
def louvain_trade(spark, sf_dir):
    return solvers.solve(views.trade(spark, sf_dir), "louvain")


@query
def exact_small(spark, sf_dir):
    """The best partition of the regions' trade: nations contracted to a graph of five nodes."""
    g = views.trade(spark, sf_dir)
    arcs = transform.contract_keep_diagonal(g.arcs, g.labels, "t").select(F.col("src").cast("long"), F.col("dst").cast("long"), "w")
    nodes = g.labels.select(F.col("t").cast("long").alias("id")).distinct()
    return solvers.solve(views.Graph(nodes, arcs, g.labels), "exact_small")


@query
def kmeans(spark, sf_dir):
    return solvers.kmeans(_features(spark, sf_dir), 10)


@query
def propagate_kmeans(spark, sf_dir):
    graph, features = _near(spark, sf_dir), _features(spark, sf_dir)
    return solvers.propagate_kmeans(graph, features, 4)


@query
def propagate_threshold(spark, sf_dir):
    graph, features = _near(spark, sf_dir), _features(spark, sf_dir)
    return solvers.propagate_threshold(graph, features)


@query
def select_then_assign(spark, sf_dir):
    graph, features = _near(spark, sf_dir), _features(spark, sf_dir)
    return solvers.select_then_assign(graph, features)


@query
def power_iteration(spark, sf_dir):
    return solvers.power_iteration(_near(spark, sf_dir), 4)


@query
def stream_edge_cluster(spark, sf_dir):
    return stream_cluster.stream_edges(views.event_stream(spark, sf_dir))


@query
def stream_node_cluster(spark, sf_dir):
    return stream_cluster.stream_nodes(_near(spark, sf_dir).arcs)


@query
def restream_cluster(spark, sf_dir):
    return solvers.restreamed(_near(spark, sf_dir))


@query
def best_of_five(spark, sf_dir):
    return solvers.best_of(_near(spark, sf_dir), "louvain")


@query
def benchmark_runs(spark, sf_dir):
    return solvers.run_benchmark(spark, _near(spark, sf_dir), "near", "louvain", 2)


# text round trips


def _shared(spark, name):
    return f"{own_folder(spark, 'text')}/{name}"


def _through_metis(spark, nodes, arcs, lines, name):
    """The arcs written by ``lines`` and read back. A METIS node is its line's number: ids with gaps, twice or null are written as ranks."""
    path = _shared(spark, name)
    n, distinct, least, most = nodes.agg(F.count(F.lit(1)), F.count_distinct("id"), F.min("id"), F.max("id")).first()
    if n == distinct and (n == 0 or (least, most) == (0, n - 1)):
        text.write_lines(lines(nodes, arcs), path)
        return text.read_metis(spark, path).arcs
    ranks = transform.saved(text.ranked(nodes))

    def renamed(rows, column, old, new):
        return rows.join(ranks.select(F.col(old).alias(column), F.col(new).alias("to")), column).withColumn(column, F.col("to")).drop("to")

    text.write_lines(lines(renamed(nodes.dropDuplicates(["id"]), "id", "id", "rank"), renamed(renamed(arcs, "src", "id", "rank"), "dst", "id", "rank")), path)
    return renamed(renamed(text.read_metis(spark, path).arcs, "src", "rank", "id"), "dst", "rank", "id").select("src", "dst", "w")


@query
def metis_scan(spark, sf_dir):
    """The documents' graph written as METIS lines and read back."""
    g = views.documents_graph(spark, sf_dir)
    return _through_metis(spark, g.nodes, g.arcs, text.metis_lines, "graph.metis")


@query
def metis_weighted_scan(spark, sf_dir):
    """The documents' graph with arc and node weights as METIS lines, read back."""
    g = views.documents_graph(spark, sf_dir)
    nodes = g.nodes.withColumn("size", F.col("id") % 3 + 1)
    return _through_metis(spark, nodes, g.arcs.withColumn("w", (F.col("src") + F.col("dst")) % 5 + 1), text.weighted_metis_lines, "weighted.metis")


@query
def results_scan(spark, sf_dir):
    """The table of runs written as CSV and read back."""
    path, runs = _shared(spark, "results"), results(spark, sf_dir)
    kinds = [field.split(" ", 1) for field in text.RESULT_SCHEMA.split(", ")]
    text.write_results(runs.select(*[(F.col(name) if name in runs.columns else F.lit(None)).cast(kind).alias(name) for name, kind in kinds]), path)
    return text.read_results(spark, path).select("algorithm", "instance", "run", "memory", "time", "edges", "modularity")


@query
def labels_scan(spark, sf_dir):
    path = _shared(spark, "graph.labels")
    text.write_lines(text.label_lines(views.documents_graph(spark, sf_dir).labels), path)
    return text.read_labels(spark, path)


@query
def features_scan(spark, sf_dir):
    path = _shared(spark, "graph.features")
    text.write_lines(text.feature_lines(_features(spark, sf_dir)), path)
    return text.read_features(spark, path).select("id", F.size("f").alias("n"), rounded(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query
def eval_line(spark, sf_dir):
    return metrics.evaluator_line(eval_row(spark, sf_dir))


@query
def sweep_settings(spark, sf_dir):
    """The settings of the sweep: 27 of structure, 31 of the features' signal."""
    found = generate.sweep_settings()
    rows = [("assortativity", i, round(m.assortativity, 3)) for i, m in enumerate(found[:27])] + [("signal", j, round(m.signal, 6)) for j, m in enumerate(found[27:])]
    return spark.createDataFrame(rows, "setting string, step int, value double")


@query
def sweep(spark, sf_dir):
    """All settings, each by every method."""
    return solvers.run_sweep(spark, generate.sweep_settings(), solvers.SWEPT, k=4).drop("time")
