"""Structural, supervised and further objectives. Integers are exact until the last division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions.exact import pairs_of, ratio, rounded, truncated_ratio
from graphweft.operators import blocks, transform
from graphweft.operators.transform import quotient

#: Nodes up to which their clusters are broadcast.
BROADCAST = 2_000_000


def node_degrees(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, k): weighted degree, 0 for isolated nodes."""
    return nodes.join(arcs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "id", "left").select("id", F.coalesce("k", F.lit(0)).alias("k"))


def graph_stats(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """One row: nodes, arcs (each edge twice), total arc weight."""
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(arcs.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("w"), F.lit(0)).alias("total_weight")))


def _beside(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows of one key ``by`` side by side; without one, two tables of one row."""
    return left.join(right, list(by)) if by else left.join(right)


def cluster_table(labels: DataFrame, between: DataFrame, column: str = "c", by: tuple[str, ...] = ()) -> DataFrame:
    """(c, size, volume, inner, cut) of every label, from the sizes and the quotient table; for each key ``by`` of both."""
    sizes = labels.groupBy(*by, F.col(column).alias("c")).agg(F.count(F.lit(1)).alias("size"))
    sums = between.groupBy(*by, F.col("a").alias("c")).agg(
        F.sum("w").alias("volume"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0)).alias("inner"), F.sum(F.when(F.col("a") != F.col("b"), F.col("w")).otherwise(0)).alias("cut")
    )
    return sizes.join(sums, [*by, "c"], "left").select(*by, "c", "size", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("volume", "inner", "cut")))


def clusters(arcs: DataFrame, labels: DataFrame, column: str = "c") -> DataFrame:
    return cluster_table(labels, quotient(arcs, labels, column), column)


def _whole(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The cluster table with the graph's W and n beside each row; one row a cluster and one for the whole."""
    return _beside(table, table.groupBy(*by).agg(F.sum("volume").alias("W"), F.sum("size").alias("n")), by)


def coverage_parts(table: DataFrame) -> DataFrame:
    """Total arc weight W, inner arc weight L, sum of cut weights."""
    return table.agg(F.sum("volume").alias("total_weight"), F.sum("inner").alias("inner_weight"), F.sum("cut").alias("cut_weight"))


def modularity(table: DataFrame, gamma: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """modularity (9 decimals, toward zero), N = W L - gamma sum K^2 exactly, as text, clusters with positive volume."""
    sums = table.groupBy(*by).agg(
        F.sum("volume").cast("decimal(18,0)").alias("W"),
        F.sum("inner").cast("decimal(18,0)").alias("L"),
        F.sum((F.col("volume").cast("decimal(18,0)") * F.col("volume").cast("decimal(18,0)")).cast("decimal(38,0)")).alias("S"),
        F.count_if(F.col("volume") > 0).cast("int").alias("clusters"),
    ).withColumn("N", F.expr(f"cast(W * L as decimal(38,0)) - cast({gamma}BD * S as decimal(38,0))").cast("decimal(38,0)"))
    return sums.select(*by, truncated_ratio("N", "W * W").alias("modularity"), F.col("N").cast("string").alias("N"), "clusters")


def conductance_of(halved: bool = True) -> Column:
    least = F.least(F.col("volume"), F.col("W") - F.col("volume"))
    cut = F.col("cut").cast("double") / (2.0 if halved else 1.0)
    return F.when(least > 0, cut / least.cast("double")).otherwise(F.lit(0.0))


def cut_ratio_of() -> Column:
    pairs = F.col("size") * (F.col("n") - F.col("size"))
    return F.when(pairs > 0, F.col("cut").cast("double") / 2.0 / pairs.cast("double")).otherwise(F.lit(0.0))


def cluster_conductance(table: DataFrame, halved: bool = True) -> DataFrame:
    """(c, conductance); ``halved`` takes half of the cut, as published results do."""
    return _whole(table).select("c", rounded(conductance_of(halved)).alias("conductance"))


def cluster_cut_ratio(table: DataFrame) -> DataFrame:
    return _whole(table).select("c", rounded(cut_ratio_of()).alias("cut_ratio"))


def structure_metrics(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means of conductance and cut ratio over all labels, isolated clusters among them."""
    return _whole(table, by).groupBy(*by).agg(rounded(F.avg(conductance_of())).alias("conductance"), rounded(F.avg(cut_ratio_of())).alias("cut"))


def inter_cluster_conductance(table: DataFrame) -> DataFrame:
    return _whole(table).agg(rounded(1.0 - F.max(conductance_of(False))).alias("inter_cluster_conductance"))


def coverage(table: DataFrame) -> DataFrame:
    return table.agg(rounded(ratio(F.sum("inner"), F.sum("volume"))).alias("coverage"))


def performance(arcs: DataFrame, labels: DataFrame, column: str = "c") -> DataFrame:
    """(inner edges + pairs of different clusters without an edge) / all pairs, weights ignored."""
    table = clusters(arcs.select("src", "dst", F.lit(1).cast("long").alias("w")), labels, column)
    n = F.sum("size")
    apart = pairs_of(n) - F.sum(pairs_of(F.col("size")))
    good = F.sum("inner") / 2 + (apart - F.sum("cut") / 2)
    return table.agg(rounded(ratio(good, pairs_of(n))).alias("performance"))


def edge_confusion(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """tp, fp, tn, fn over arcs, weights ignored: same cluster, same truth."""
    own = labels.select(F.col("id").alias("src"), F.col("c").alias("c1"), F.col("t").alias("t1"))
    other = labels.select(F.col("id").alias("dst"), F.col("c").alias("c2"), F.col("t").alias("t2"))
    both = arcs.select("src", "dst").join(own, "src").join(other, "dst").select((F.col("c1") == F.col("c2")).alias("c"), (F.col("t1") == F.col("t2")).alias("t"))
    return both.agg(F.count_if(F.expr("c and t")).alias("tp"), F.count_if(F.expr("c and not t")).alias("fp"), F.count_if(F.expr("not c and not t")).alias("tn"), F.count_if(F.expr("not c and t")).alias("fn"))


def edge_scores(confusion: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """f1 (NaN for 0/0) and accuracy beside the counts."""
    double = F.col("tp") * 2
    f1 = F.when(double + F.col("fp") + F.col("fn") > 0, ratio(double, double + F.col("fp") + F.col("fn"))).otherwise(F.lit(float("nan")))
    return confusion.select(*by, rounded(f1).alias("f1"), rounded(ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))).alias("accuracy"), "tp", "fp", "tn", "fn")


def contingency(labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(c, t, n): common nodes of a cluster and a class."""
    return labels.groupBy(*by, "c", "t").agg(F.count(F.lit(1)).alias("n"))


def contingency_cube(labels: DataFrame) -> DataFrame:
    """The contingency table with both margins and the total; -1 stands for all."""
    every = lambda x: F.when(F.grouping(x) == 1, F.lit(-1)).otherwise(F.col(x)).alias(f"{x}_")
    return labels.cube("c", "t").agg(F.count(F.lit(1)).alias("n"), every("c"), every("t")).select(F.col("c_").alias("c"), F.col("t_").alias("t"), "n")


def supervised_metrics(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """ari, nmi, purity, invpurity from a contingency table, with 0 where a score is undefined."""
    rows = table.groupBy(*by, "c").agg(F.sum("n").alias("n"), F.max("n").alias("m")).groupBy(*by).agg(
        F.sum(pairs_of(F.col("n"))).alias("A"), F.sum(F.col("n") * F.ln(F.col("n").cast("double"))).alias("hc"), F.sum("m").alias("pc"), F.sum("n").alias("n")
    )
    columns = table.groupBy(*by, "t").agg(F.sum("n").alias("n"), F.max("n").alias("m")).groupBy(*by).agg(
        F.sum(pairs_of(F.col("n"))).alias("B"), F.sum(F.col("n") * F.ln(F.col("n").cast("double"))).alias("ht"), F.sum("m").alias("pt")
    )
    cells = table.groupBy(*by).agg(F.sum(pairs_of(F.col("n"))).alias("S"), F.sum(F.col("n") * F.ln(F.col("n").cast("double"))).alias("hct"))
    one = _beside(_beside(rows, columns, by), cells, by)
    n = F.col("n").cast("double")
    expected = F.when(pairs_of(F.col("n")) > 0, F.col("A").cast("double") * F.col("B").cast("double") / pairs_of(F.col("n")).cast("double")).otherwise(F.lit(0.0))
    spread = (F.col("A") + F.col("B")).cast("double") / 2.0 - expected
    # entropies from sums of n ln n: H = ln N - sum / N
    entropy_c, entropy_t = F.ln(n) - F.col("hc") / n, F.ln(n) - F.col("ht") / n
    mutual = F.ln(n) + (F.col("hct") - F.col("hc") - F.col("ht")) / n
    tiny = 1e-12
    return one.select(
        *by,
        rounded(F.when(spread > 0, (F.col("S").cast("double") - expected) / spread).otherwise(F.lit(0.0))).alias("ari"),
        rounded(F.when((entropy_c > tiny) & (entropy_t > tiny), mutual / F.sqrt(entropy_c * entropy_t)).otherwise(F.lit(0.0))).alias("nmi"),
        rounded(F.col("pc").cast("double") / n).alias("purity"),
        rounded(F.col("pt").cast("double") / n).alias("invpurity"),
    )


def joint_table(arcs: DataFrame, labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, s, t, w, n): weight and number of arcs by the clusters and classes of both ends.

    Everything the evaluator needs of the arcs, in one pass and one shuffle that its parts share.
    """
    own = labels.select(*by, F.col("id").alias("src"), F.col("c").alias("a"), F.col("t").alias("s"))
    other = labels.select(*by, F.col("id").alias("dst"), F.col("c").alias("b"), F.col("t").alias("t"))
    return arcs.join(own, "src").join(other, [*by, "dst"]).groupBy(*by, "a", "b", "s", "t").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))


def evaluate(nodes: DataFrame, arcs: DataFrame, labels: DataFrame, name: str, truth: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """The evaluator's row: structure of a clustering and, with a truth, its agreement. Every node has a label.

    With columns ``by`` the labels hold a clustering for each of their values, and each gets a row.
    """
    joint = joint_table(arcs, labels if truth else labels.select(*by, "id", "c", F.lit(0).alias("t")), by)
    if by:
        # a clustering of a graph without arcs has a row too
        joint = labels.select(*by).distinct().join(joint, list(by), "left")
    table = cluster_table(labels, joint.groupBy(*by, "a", "b").agg(F.sum("w").alias("w")), by=by)
    head = nodes.agg(F.lit(name.rsplit("/", 1)[-1]).alias("graph"), F.count(F.lit(1)).alias("nodes")).join(joint.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges")))
    row = _beside(_beside(head, modularity(table, by=by), by), structure_metrics(table, by), by)
    if truth:
        count = lambda x: F.coalesce(F.sum(F.when(F.expr(x), F.col("n")).otherwise(0)), F.lit(0))
        confusion = joint.groupBy(*by).agg(count("a = b and s = t").alias("tp"), count("a = b and s <> t").alias("fp"), count("a <> b and s <> t").alias("tn"), count("a <> b and s = t").alias("fn"))
        row = _beside(_beside(row, edge_scores(confusion, by), by), supervised_metrics(contingency(labels, by), by), by)
    return row


def evaluator_line(row: DataFrame) -> DataFrame:
    """The row as one printed CSV line."""
    formats = {"modularity": "%.9f", **{c: "%.8f" for c in ("conductance", "cut", "f1", "accuracy", "ari", "nmi", "purity", "invpurity")}}
    return row.select(F.concat_ws(",", *[F.format_string(formats[c], F.col(c)) if c in formats else F.col(c).cast("string") for c in row.columns]).alias("line"))


def map_equation(table: DataFrame) -> DataFrame:
    """Two-level description length in bits, visit rates by degree. Needs (c, volume, cut) and the node term, see map_equation_of."""
    plog = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))
    whole = _whole(table).select((F.col("cut").cast("double") / F.col("W")).alias("q"), (F.col("volume").cast("double") / F.col("W")).alias("p"))
    return whole.agg(plog(F.sum("q")).alias("all_q"), F.sum(plog(F.col("q"))).alias("each_q"), F.sum(plog(F.col("q") + F.col("p"))).alias("each_qp"))


def map_equation_of(nodes: DataFrame, arcs: DataFrame, labels: DataFrame) -> DataFrame:
    degrees = node_degrees(nodes, arcs)
    total = degrees.agg(F.sum("k").alias("W"))
    visits = degrees.where("k > 0").join(total).agg(F.sum(F.col("k").cast("double") / F.col("W") * F.log2(F.col("k").cast("double") / F.col("W"))).alias("node"))
    return map_equation(clusters(arcs, labels)).join(visits).select(rounded(F.col("all_q") - 2 * F.col("each_q") + F.col("each_qp") - F.col("node"), 6).alias("map_equation"))


def wcc(nodes: DataFrame, arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """Weighted community clustering, averaged over nodes, from triangles inside and outside of clusters.

    Of a node x in cluster C: t(x, C) / t(x, V) * vt(x, V) / (|C| - 1 + vt(x, V) - vt(x, C)), where t counts
    triangles and vt the neighbours that close one; 0 without a triangle.
    """
    # a code of the cluster as a double, exact below 2^53; NaN for none
    held = labels.select("id", F.coalesce(F.col("c").cast("double"), F.lit(float("nan"))).alias("own"))
    few = F.broadcast if held.limit(BROADCAST + 1).count() <= BROADCAST else lambda x: x
    ends = arcs.where("src <> dst").join(few(held.select(F.col("id").alias("dst"), F.col("own").alias("x"))), "dst")
    around = transform.saved(blocks.packed_lists(ends, "src", "dst", "x", once=True).join(few(held), "id"))
    counts = blocks.closed(around)
    sizes = labels.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    rows = labels.join(sizes, "c").join(counts, "id", "left")
    below = F.col("size") - 1 + F.col("vv") - F.col("vc")
    value = F.when((F.col("tv") > 0) & (below > 0), F.col("tc").cast("double") / F.col("tv") * F.col("vv") / below).otherwise(F.lit(0.0))
    return rows.agg(rounded(F.avg(F.coalesce(value, F.lit(0.0))), 6).alias("wcc"))


def soft_modularity(arcs: DataFrame, degrees: DataFrame, soft: DataFrame) -> DataFrame:
    """Q of soft assignments (id, s): sum of w <s_u, s_v> less the squared norm of sum k_u s_u over W, over W."""
    dot = F.aggregate(F.zip_with("su", "sv", lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)
    inner = arcs.join(soft.select(F.col("id").alias("src"), F.col("s").alias("su")), "src").join(soft.select(F.col("id").alias("dst"), F.col("s").alias("sv")), "dst").agg(F.sum(F.col("w") * dot).alias("inner"), F.sum("w").alias("total"))
    parts = soft.join(degrees, "id").select("k", F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum(F.col("k") * F.col("x")).alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("square"))
    return inner.join(parts).select(rounded((F.col("inner") - F.col("square") / F.col("total")) / F.col("total"), 6).alias("modularity"))
