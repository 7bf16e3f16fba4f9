"""SQL of the graph views and of every relational query, for an engine with the tables as views."""

from __future__ import annotations

BOTH = "arcs AS (SELECT src, dst, w FROM edges0 UNION ALL SELECT dst, src, w FROM edges0)"
TRADE = f"""people AS (SELECT c_custkey * 2 AS id, c_nationkey AS c FROM customer UNION ALL SELECT s_suppkey * 2 + 1, s_nationkey FROM supplier),
nodes AS (SELECT id FROM people),
labels AS (SELECT id, CAST(c AS INTEGER) AS c, CAST(n_regionkey AS INTEGER) AS t FROM people JOIN nation ON c = n_nationkey),
edges0 AS (SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
{BOTH}"""
PAIRS = "pairs AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"
COPURCHASE = f"""{PAIRS},
nodes AS (SELECT p_partkey AS id FROM part),
labels AS (SELECT p_partkey AS id, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS c, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS t FROM part),
edges0 AS (SELECT DISTINCT src, dst, CAST(1 AS BIGINT) AS w FROM pairs),
{BOTH}"""
KNN = f"""vec AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(round(1000 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings),
nodes AS (SELECT vec_id AS id FROM embeddings),
labels AS (SELECT vec_id AS id, label AS c, label AS t FROM embeddings),
edges0 AS (SELECT a.id AS src, b.id AS dst, CAST(1 AS BIGINT) AS w FROM vec a JOIN vec b ON a.id < b.id WHERE list_dot_product(a.v, b.v) >= 300000),
{BOTH}"""
DOCS = f"""lines AS (SELECT DISTINCT doc_id, lower(trim(line, ' ')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(lower(trim(line, ' '))) > 20),
firsts AS (SELECT line, min(doc_id) AS src FROM lines GROUP BY line),
nodes AS (SELECT doc_id AS id FROM documents),
labels AS (SELECT doc_id AS id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS c, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS t FROM documents),
edges0 AS (SELECT DISTINCT src, doc_id AS dst, CAST(1 AS BIGINT) AS w FROM lines JOIN firsts USING (line) WHERE src < doc_id),
{BOTH}"""
DEG = "deg AS (SELECT n.id, CAST(coalesce(sum(w), 0) AS BIGINT) AS k FROM nodes n LEFT JOIN arcs ON n.id = src GROUP BY n.id)"
BETWEEN = "between_ AS (SELECT p.c AS a, q.c AS b, CAST(sum(w) AS BIGINT) AS w FROM arcs JOIN labels p ON src = p.id JOIN labels q ON dst = q.id GROUP BY 1, 2)"
CLUS = f"""{BETWEEN},
clus AS (SELECT s.c, s.size, CAST(coalesce(volume, 0) AS BIGINT) AS volume, CAST(coalesce(inner_, 0) AS BIGINT) AS inner_, CAST(coalesce(cut, 0) AS BIGINT) AS cut
  FROM (SELECT c, count(*) AS size FROM labels GROUP BY c) s
  LEFT JOIN (SELECT a, sum(w) AS volume, sum(CASE WHEN a = b THEN w ELSE 0 END) AS inner_, sum(CASE WHEN a <> b THEN w ELSE 0 END) AS cut FROM between_ GROUP BY a) q ON s.c = q.a),
whole AS (SELECT CAST(sum(volume) AS BIGINT) AS tot_w, CAST(sum(size) AS BIGINT) AS n FROM clus)"""
COND = "CASE WHEN least(volume, tot_w - volume) > 0 THEN CAST(cut AS DOUBLE) / 2.0 / least(volume, tot_w - volume) ELSE 0.0 END"
COND_STD = "CASE WHEN least(volume, tot_w - volume) > 0 THEN CAST(cut AS DOUBLE) / least(volume, tot_w - volume) ELSE 0.0 END"
CUT_RATIO = "CASE WHEN size * (n - size) > 0 THEN CAST(cut AS DOUBLE) / 2.0 / (size * (n - size)) ELSE 0.0 END"


def modularity_sql(gamma: int = 1) -> str:
    n = f"(tot_w * L - {gamma} * S)"
    return f"""SELECT CAST((1000000000 * {n}) // (tot_w * tot_w) AS DOUBLE) / 1e9 AS modularity, CAST({n} AS VARCHAR) AS N, clusters
FROM (SELECT CAST(sum(volume) AS HUGEINT) AS tot_w, CAST(sum(inner_) AS HUGEINT) AS L, sum(CAST(volume AS HUGEINT) * volume) AS S, CAST(count(*) FILTER (WHERE volume > 0) AS INTEGER) AS clusters FROM clus)"""


STRUCTURE = f"SELECT round(avg({COND}), 8) AS conductance, round(avg({CUT_RATIO}), 8) AS cut FROM clus, whole"
CONFUSION = """SELECT count(*) FILTER (WHERE p.c = q.c AND p.t = q.t) AS tp, count(*) FILTER (WHERE p.c = q.c AND p.t <> q.t) AS fp,
count(*) FILTER (WHERE p.c <> q.c AND p.t <> q.t) AS tn, count(*) FILTER (WHERE p.c <> q.c AND p.t = q.t) AS fn
FROM arcs JOIN labels p ON src = p.id JOIN labels q ON dst = q.id"""
F1 = f"SELECT round(2.0 * tp / (2 * tp + fp + fn), 8) AS f1, round(CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn), 8) AS accuracy, tp, fp, tn, fn FROM ({CONFUSION})"
CONT = "cont AS (SELECT c, t, count(*) AS n FROM labels GROUP BY c, t)"
SUPERVISED = """SELECT round(CASE WHEN (A + B) / 2.0 - A * B / P > 0 THEN (S - A * B / P) / ((A + B) / 2.0 - A * B / P) ELSE 0.0 END, 8) AS ari,
round(CASE WHEN hc > 1e-12 AND ht > 1e-12 THEN mi / sqrt(hc * ht) ELSE 0.0 END, 8) AS nmi, round(pc / n, 8) AS purity, round(pt / n, 8) AS invpurity FROM (
SELECT CAST((SELECT sum(n) FROM cont) AS DOUBLE) AS n, CAST((SELECT sum(n) * (sum(n) - 1) / 2 FROM cont) AS DOUBLE) AS P,
CAST((SELECT sum(n * (n - 1) / 2) FROM cont) AS DOUBLE) AS S,
CAST((SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cont GROUP BY c)) AS DOUBLE) AS A,
CAST((SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cont GROUP BY t)) AS DOUBLE) AS B,
CAST((SELECT sum(m) FROM (SELECT max(n) AS m FROM cont GROUP BY c)) AS DOUBLE) AS pc,
CAST((SELECT sum(m) FROM (SELECT max(n) AS m FROM cont GROUP BY t)) AS DOUBLE) AS pt,
(SELECT -sum(p * ln(p)) FROM (SELECT sum(n) / (SELECT sum(n) FROM cont) AS p FROM cont GROUP BY c)) AS hc,
(SELECT -sum(p * ln(p)) FROM (SELECT sum(n) / (SELECT sum(n) FROM cont) AS p FROM cont GROUP BY t)) AS ht,
(SELECT sum(p * ln(p / (pc * pt))) FROM (SELECT cont.n / z.n AS p, x.n / z.n AS pc, y.n / z.n AS pt FROM cont JOIN (SELECT c, sum(n) AS n FROM cont GROUP BY c) x USING (c) JOIN (SELECT t, sum(n) AS n FROM cont GROUP BY t) y USING (t), (SELECT sum(n) AS n FROM cont) z)) AS mi)"""


def q(view: str, body: str, *more: str) -> str:
    return f"WITH {', '.join((view, *more))}\n{body}"


EVAL = f"""SELECT 'trade' AS graph, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM arcs) AS edges, m.*, s.*, f.*, u.*
FROM ({modularity_sql()}) m, ({STRUCTURE}) s, ({F1}) f, ({SUPERVISED}) u"""
VALIDATE_ARCS = "bad AS (SELECT src, dst, w FROM arcs WHERE (src + dst) % 7 <> 0 UNION ALL SELECT src, dst, w FROM arcs WHERE src % 50 = 0 UNION ALL SELECT id, id, 1 FROM nodes WHERE id % 10 = 0 UNION ALL SELECT id, -1, 1 FROM nodes WHERE id % 100 = 0)"
RESULTS = """results AS (SELECT event_type AS algorithm, 'g' || CAST(user_id % 12 AS VARCHAR) AS instance, CAST(event_id AS INTEGER) AS run, CASE WHEN event_type = 'error' AND user_id % 12 < 3 THEN NULL WHEN event_type = 'view' AND user_id % 12 = 5 THEN -value ELSE value END AS modularity,
value * 2 AS time, CAST(user_id * 100 + 10 AS BIGINT) AS edges, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 16 END AS threads, user_id * 20000 AS memory FROM events)"""
BEST = "best AS (SELECT algorithm, instance, max(modularity) AS modularity FROM results WHERE modularity IS NOT NULL GROUP BY 1, 2)"
RATIOS = f"{BEST}, ratios AS (SELECT algorithm, instance, modularity / nullif(opt, 0) AS ratio FROM best JOIN (SELECT instance, max(modularity) AS opt FROM best GROUP BY 1) USING (instance))"
PROFILE = """SELECT algorithm, rank, round(CAST(rank AS DOUBLE) / n, 8) AS fraction, round(CASE WHEN rank = 0 THEN 1.0 WHEN ratio IS NOT NULL THEN ratio WHEN rank = coalesce(solved, 0) + 1 THEN 0.0 END, 8) AS ratio
FROM (SELECT DISTINCT algorithm FROM ratios) CROSS JOIN (SELECT count(DISTINCT instance) AS n FROM ratios) CROSS JOIN LATERAL (SELECT CAST(unnest(range(0, n + 1)) AS INTEGER) AS rank)
LEFT JOIN (SELECT algorithm, CAST(row_number() OVER (PARTITION BY algorithm ORDER BY ratio DESC, instance) AS INTEGER) AS rank, ratio FROM ratios WHERE ratio > 0) USING (algorithm, rank)
LEFT JOIN (SELECT algorithm, count(*) AS solved FROM ratios WHERE ratio > 0 GROUP BY 1) USING (algorithm)"""
BEST_RUN = "SELECT algorithm, instance, run, modularity, time, edges FROM (SELECT *, row_number() OVER (PARTITION BY algorithm, instance ORDER BY modularity DESC, run) AS r FROM results WHERE modularity IS NOT NULL) WHERE r = 1"
AROUND = "around AS (SELECT src AS id, l.c AS b, CAST(sum(w) AS BIGINT) AS w FROM arcs JOIN labels l ON dst = l.id GROUP BY 1, 2)"
SWEEP = f"""{DEG}, vol AS (SELECT c, CAST(sum(k) AS BIGINT) AS K FROM labels JOIN deg USING (id) GROUP BY c), {AROUND}, tot AS (SELECT CAST(sum(k) AS BIGINT) AS tot_w FROM deg),
gains AS (SELECT l.id, o.b, 2 * (tot_w * (o.w - coalesce(h.w, 0)) - d.k * (vb.K - va.K + d.k)) AS gain FROM labels l JOIN deg d USING (id) JOIN vol va ON va.c = l.c JOIN around o ON o.id = l.id JOIN vol vb ON vb.c = o.b LEFT JOIN around h ON h.id = l.id AND h.b = l.c, tot WHERE o.b < l.c),
picks AS (SELECT id, b FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gain DESC, b) AS r FROM gains WHERE gain > 0) WHERE r = 1)"""
MERGES = "gains AS (SELECT x.a, x.b, 2 * (tot_w * x.w - p.volume * s.volume) AS gain, round(2.0 * (tot_w * x.w - p.volume * s.volume) * (CAST(least(p.size, s.size) AS DOUBLE) / greatest(p.size, s.size)), 6) AS score FROM between_ x JOIN clus p ON p.c = x.a JOIN clus s ON s.c = x.b, whole WHERE x.a < x.b)"

LINE = ("graph", "nodes", "edges", "modularity", "N", "clusters", "conductance", "cut", "f1", "accuracy", "tp", "fp", "tn", "fn", "ari", "nmi", "purity", "invpurity")
DECIMALS = {"modularity": 9} | dict.fromkeys(("conductance", "cut", "f1", "accuracy", "ari", "nmi", "purity", "invpurity"), 8)
VALIDATE = """SELECT 'endpoint' AS rule, src, dst, CAST(1 AS BIGINT) AS detail FROM bad WHERE dst NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'self_loop', src, dst, 1 FROM bad WHERE src = dst
UNION ALL SELECT 'repeated', src, dst, count(*) FROM bad GROUP BY src, dst HAVING count(*) > 1
UNION ALL SELECT 'asymmetric', src, dst, 1 FROM (SELECT DISTINCT src, dst FROM bad b WHERE NOT EXISTS (SELECT 1 FROM bad r WHERE r.src = b.dst AND r.dst = b.src))"""

SQL = {
    "selfloop_drop": "WITH e AS (SELECT event_id AS pos, lag(user_id) OVER (ORDER BY ts, event_id) AS src, user_id AS dst, row_number() OVER (ORDER BY ts, event_id) AS n FROM events) SELECT n AS pos, src, dst FROM e WHERE src IS NOT NULL AND src <> dst",
    "default_features": q(TRADE, "SELECT id, 1.0::DOUBLE AS f0 FROM nodes"),
    "edges_upper": q(TRADE, "SELECT DISTINCT src, dst FROM arcs WHERE dst > src"),
    "metis_lines": q(DOCS, """SELECT 0::BIGINT AS row, CAST((SELECT count(*) FROM nodes) AS VARCHAR) || ' ' || CAST((SELECT count(*) FROM edges0) AS VARCHAR) || ' 0' AS line
UNION ALL SELECT id + 1, coalesce((SELECT string_agg(CAST(dst + 1 AS VARCHAR), ' ' ORDER BY dst) FROM arcs WHERE src = id), '') FROM nodes"""),
    "label_lines": q(TRADE, "SELECT id AS row, CAST(c AS VARCHAR) AS line FROM labels"),
    "arcs_dedup": f"WITH {PAIRS} SELECT DISTINCT src, dst, CAST(1 AS BIGINT) AS w FROM pairs",
    "arcs_merge": f"WITH {PAIRS} SELECT src, dst, count(*) AS w FROM pairs GROUP BY 1, 2",
    "graph_stats": q(TRADE, "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM arcs) AS edges, (SELECT CAST(sum(w) AS BIGINT) FROM arcs) AS total_weight"),
    "validate_graph": q(TRADE, f"SELECT rule, src, dst, detail FROM ({VALIDATE})", VALIDATE_ARCS),
    "validate_header": q(TRADE, f"SELECT rule, src, dst, detail FROM ({VALIDATE} UNION ALL SELECT 'edge_count', -1, -1, count(*) FROM bad HAVING count(*) <> 14)", VALIDATE_ARCS),
    "asymmetric_arcs": q(TRADE, "SELECT DISTINCT src, dst FROM bad b WHERE NOT EXISTS (SELECT 1 FROM bad r WHERE r.src = b.dst AND r.dst = b.src)", VALIDATE_ARCS),
    "graph_diff": q(TRADE, "SELECT src, dst, w FROM bad EXCEPT ALL SELECT src, dst, w FROM arcs", VALIDATE_ARCS),
    "contract_clusters": q(TRADE, "SELECT 'node' AS kind, CAST(c AS BIGINT) AS src, CAST(c AS BIGINT) AS dst, inner_ AS w FROM clus UNION ALL SELECT 'arc', a, b, w FROM between_ WHERE a <> b", CLUS),
    "contract_keep_diag": q(TRADE, "SELECT a AS src, b AS dst, w FROM between_ WHERE w <> 0", BETWEEN),
    "components_active": q(DOCS, "SELECT id, min(rep) AS rep FROM reach GROUP BY id").replace("WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT id, min", ", reach(id, rep) AS (SELECT id, id FROM nodes UNION SELECT dst, rep FROM reach JOIN arcs ON src = id)\nSELECT id, min"),
    "components_within_cluster": q(DOCS, "SELECT id, min(rep) AS rep FROM reach GROUP BY id").replace("WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT id, min", ", own AS (SELECT src, dst FROM arcs JOIN labels p ON src = p.id JOIN labels q ON dst = q.id WHERE p.c = q.c), reach(id, rep) AS (SELECT id, id FROM nodes UNION SELECT dst, rep FROM reach JOIN own ON src = id)\nSELECT id, min"),
    "compact_labels": q(TRADE, "SELECT id, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS c FROM (SELECT id, c * 10 + 3 AS c FROM labels)"),
    "symmetrize_selfloops": q(COPURCHASE, "SELECT src, dst FROM edges0 UNION SELECT dst, src FROM edges0 UNION SELECT id, id FROM nodes"),
    "csr_offsets": q(TRADE, "SELECT id, degree, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ FROM (SELECT n.id, count(src) AS degree FROM nodes n LEFT JOIN arcs ON src = n.id GROUP BY n.id)"),
    "node_degree": q(TRADE, "SELECT id, k FROM deg", DEG),
    "cluster_sizes": q(TRADE, "SELECT c, count(*) AS size FROM labels GROUP BY c"),
    "cluster_volume": q(TRADE, "SELECT c, volume FROM clus", CLUS),
    "cluster_cut": q(TRADE, "SELECT c, cut FROM clus", CLUS),
    "coverage_parts": q(TRADE, "SELECT CAST(sum(volume) AS BIGINT) AS total_weight, CAST(sum(inner_) AS BIGINT) AS inner_weight, CAST(sum(cut) AS BIGINT) AS cut_weight FROM clus", CLUS),
    "modularity": q(TRADE, modularity_sql(), CLUS),
    "modularity_copurchase": q(COPURCHASE, modularity_sql(), CLUS),
    "modularity_knn": q(KNN, modularity_sql(), CLUS),
    "modularity_gamma": q(TRADE, modularity_sql(2), CLUS),
    "cluster_conductance": q(TRADE, f"SELECT c, round({COND}, 8) AS conductance FROM clus, whole", CLUS),
    "cluster_conductance_std": q(TRADE, f"SELECT c, round({COND_STD}, 8) AS conductance FROM clus, whole", CLUS),
    "inter_cluster_conductance": q(TRADE, f"SELECT round(1.0 - max({COND_STD}), 8) AS inter_cluster_conductance FROM clus, whole", CLUS),
    "cluster_cut_ratio": q(TRADE, f"SELECT c, round({CUT_RATIO}, 8) AS cut_ratio FROM clus, whole", CLUS),
    "structure_metrics": q(TRADE, STRUCTURE, CLUS),
    "coverage": q(TRADE, "SELECT round(CAST(sum(inner_) AS DOUBLE) / sum(volume), 8) AS coverage FROM clus", CLUS),
    "performance": q(COPURCHASE, "SELECT round((sum(inner_) / 2 + sum(size) * (sum(size) - 1) / 2 - sum(size * (size - 1) / 2) - sum(cut) / 2) / (sum(size) * (sum(size) - 1) / 2), 8) AS performance FROM clus", CLUS),
    "edge_confusion": q(TRADE, CONFUSION),
    "edge_f1": q(TRADE, F1),
    "contingency": q(COPURCHASE, "SELECT c, t, n FROM cont", CONT),
    "contingency_cube": q(COPURCHASE, "SELECT CASE WHEN grouping(c) = 1 THEN -1 ELSE c END AS c, CASE WHEN grouping(t) = 1 THEN -1 ELSE t END AS t, count(*) AS n FROM labels GROUP BY CUBE (c, t)"),
    "ari": q(COPURCHASE, f"SELECT ari FROM ({SUPERVISED})", CONT),
    "nmi": q(COPURCHASE, f"SELECT nmi FROM ({SUPERVISED})", CONT),
    "purity": q(COPURCHASE, f"SELECT purity, invpurity FROM ({SUPERVISED})", CONT),
    "supervised_metrics": q(DOCS, SUPERVISED, CONT),
    "eval_row": q(TRADE, EVAL, CLUS, CONT),
    "map_equation": q(TRADE, """SELECT round(aq - 2 * eq + eqp - node, 6) AS map_equation FROM (SELECT sum(q) * log2(sum(q)) AS aq, sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) AS eq, sum(CASE WHEN q + p > 0 THEN (q + p) * log2(q + p) ELSE 0 END) AS eqp FROM (SELECT CAST(cut AS DOUBLE) / tot_w AS q, CAST(volume AS DOUBLE) / tot_w AS p FROM clus, whole)),
(SELECT sum(CAST(k AS DOUBLE) / tot_w * log2(CAST(k AS DOUBLE) / tot_w)) AS node FROM deg, whole WHERE k > 0)""", CLUS, DEG),
    "wcc": q(KNN, """SELECT round(avg(CASE WHEN coalesce(tv, 0) > 0 AND size - 1 + vv - vc > 0 THEN CAST(tc AS DOUBLE) / tv * vv / (size - 1 + vv - vc) ELSE 0.0 END), 6) AS wcc FROM labels l JOIN (SELECT c, count(*) AS size FROM labels GROUP BY c) s USING (c)
LEFT JOIN (SELECT x, count(*) AS tv, count(*) FILTER (WHERE cx = cy AND cx = cz) AS tc FROM corners GROUP BY x) k ON k.x = l.id LEFT JOIN (SELECT x, count(*) AS vv, count(*) FILTER (WHERE cx = cv) AS vc FROM (SELECT DISTINCT x, cx, y AS v, cy AS cv FROM corners UNION SELECT DISTINCT x, cx, z, cz FROM corners) GROUP BY x) v ON v.x = l.id""",
        "corners AS (SELECT a.src AS x, a.dst AS y, b.dst AS z, p.c AS cx, r.c AS cy, s.c AS cz FROM arcs a JOIN arcs b ON a.src = b.src AND a.dst < b.dst JOIN arcs c ON c.src = a.dst AND c.dst = b.dst JOIN labels p ON p.id = a.src JOIN labels r ON r.id = a.dst JOIN labels s ON s.id = b.dst)"),
    "best_per_instance": f"WITH {RESULTS}, {BEST} SELECT * FROM best",
    "opt_per_instance": f"WITH {RESULTS}, {BEST} SELECT instance, max(modularity) AS opt FROM best GROUP BY 1",
    "ratio_to_best": f"WITH {RESULTS}, {RATIOS} SELECT algorithm, instance, round(ratio, 8) AS ratio FROM ratios",
    "performance_profile": f"WITH {RESULTS}, {RATIOS} {PROFILE}",
    "performance_profile_wide": f"WITH {RESULTS}, {RATIOS} SELECT fraction, " + ", ".join(f"max(ratio) FILTER (WHERE algorithm = '{x}') AS \"{x}\"" for x in ("click", "error", "purchase", "signup", "view")) + f" FROM ({PROFILE}) GROUP BY rank, fraction",
    "geomean_summary": f"WITH {RESULTS}, b AS ({BEST_RUN}) SELECT algorithm, round(exp(avg(ln(modularity))), 6) AS quality, round(exp(avg(ln(time * 1e6 / edges))), 3) AS us_per_edge, count(*) AS instances FROM b WHERE modularity > 0 AND time > 0 AND edges > 0 GROUP BY 1",
    "improvement_log": f"WITH {RESULTS} SELECT algorithm, instance, run, time, modularity FROM (SELECT *, max(modularity) OVER (PARTITION BY algorithm, instance ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM results WHERE modularity IS NOT NULL) WHERE best IS NULL OR modularity > best",
    "results_scan": f"WITH {RESULTS} SELECT algorithm, instance, run, memory, time, edges, modularity FROM results",
    "best_run": f"WITH {RESULTS} {BEST_RUN}",
    "speedup": f"WITH {RESULTS} SELECT algorithm, instance, t_low, t_high, round(t_low / nullif(t_high, 0), 6) AS speedup FROM (SELECT algorithm, instance, max(time) FILTER (WHERE threads = 1) AS t_low, max(time) FILTER (WHERE threads = 16) AS t_high FROM results GROUP BY 1, 2)",
    "memory_table": f"WITH {RESULTS} SELECT algorithm, kb, CASE WHEN kb >= 1048576 THEN CAST(kb // 1048576 AS VARCHAR) || ' GB' WHEN kb >= 1024 THEN CAST(kb // 1024 AS VARCHAR) || ' MB' ELSE CAST(kb AS VARCHAR) || ' KB' END AS memory FROM (SELECT algorithm, max(memory) AS kb FROM results GROUP BY 1)",
    "run_status": f"WITH {RESULTS} SELECT algorithm, instance, run, CASE WHEN time > 1.5 * 100 THEN 'TLE' WHEN memory > 2500000 THEN 'MLE' WHEN modularity IS NULL THEN 'FAIL' ELSE 'OK' END AS status FROM results",
    "label_propagation_round": q(TRADE, f"SELECT l.id, coalesce(b, l.c) AS c FROM labels l LEFT JOIN (SELECT id, b, row_number() OVER (PARTITION BY id ORDER BY w DESC, b) AS r FROM around) a ON a.id = l.id AND r = 1", AROUND),
    "louvain_sweep": q(COPURCHASE, "SELECT l.id, CAST(coalesce(b, l.c) AS BIGINT) AS c FROM labels l LEFT JOIN picks USING (id)", SWEEP),
    "cnm_merge_step": q(TRADE, "SELECT a, b, gain FROM gains ORDER BY gain DESC, a, b LIMIT 1", CLUS, MERGES),
    "wt_merge_step": q(TRADE, "SELECT a, b, score FROM gains ORDER BY score DESC, a, b LIMIT 1", CLUS, MERGES),
    "overlay_clustering": q(COPURCHASE, "SELECT id, min(id) OVER (PARTITION BY c, t) AS c FROM labels"),
    "gnns_step": q(TRADE, """SELECT id, i, round(CAST(v AS DOUBLE) / sum(v) OVER (PARTITION BY id), 8) AS x FROM (SELECT r.id, r.i, r.near * tot_w - k * mass AS v FROM (SELECT src AS id, t AS i, sum(w) AS near FROM arcs JOIN labels ON dst = labels.id GROUP BY 1, 2) r JOIN deg USING (id) JOIN (SELECT t AS i, sum(k) AS mass FROM labels JOIN deg USING (id) GROUP BY 1) m ON m.i = r.i, (SELECT sum(k) AS tot_w FROM deg)) WHERE v > 0""", DEG),
    "argmax_assign": q(TRADE, "SELECT id, i AS c FROM (SELECT src AS id, t AS i, row_number() OVER (PARTITION BY src ORDER BY sum(w) DESC, t) AS r FROM arcs JOIN labels ON dst = labels.id GROUP BY src, t) WHERE r = 1"),
    "kmeans_step": "WITH vec AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings), d AS (SELECT p.id, CAST(c.id AS INTEGER) AS c, CAST(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS BIGINT) AS d FROM vec p, vec c WHERE c.id < 10) SELECT id, c, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, c) AS r FROM d) WHERE r = 1",
    "neighbor_sample": q(COPURCHASE, "SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY (src * 7919 + dst * 104729) % 1000003, dst) AS r FROM arcs) WHERE r <= 10"),
    "walk_distribution": q(KNN, "SELECT a.src, b.dst, round(round(sum(a.p * b.p), 12), 8) AS p FROM two a JOIN two b ON a.dst = b.src GROUP BY 1, 2", "one AS (SELECT arcs.src, dst, CAST(w AS DOUBLE) / k AS p FROM arcs JOIN (SELECT src, sum(w) AS k FROM arcs GROUP BY 1) d ON d.src = arcs.src)",
        "two AS MATERIALIZED (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM one a JOIN one b ON a.dst = b.src GROUP BY 1, 2)"),
    "two_hop_cooccurrence": q(KNN, "SELECT a.dst AS a, b.dst AS b, count(*) AS n FROM arcs a JOIN arcs b ON a.src = b.src AND a.dst < b.dst GROUP BY 1, 2"),
    "modularity_matrix_entries": q(TRADE, """SELECT src, dst, tot_w * w - p.k * s.k AS b, round(CASE WHEN tot_w = 0 THEN CAST(w AS DOUBLE) ELSE (w - CAST(p.k * s.k AS DOUBLE) / tot_w) / 4 END, 8) AS x
FROM arcs JOIN held p ON p.id = src JOIN held s ON s.id = dst, (SELECT CAST(sum(k) AS BIGINT) AS tot_w FROM held)""", DEG, "held AS MATERIALIZED (SELECT id, k FROM deg)").replace("edges0 AS (", "edges0 AS MATERIALIZED (", 1),
    "select_large_communities": q(DOCS, "SELECT c, size FROM (SELECT c, count(*) AS size FROM labels GROUP BY c), (SELECT avg(size) AS mean, stddev_pop(size) AS sd FROM (SELECT count(*) AS size FROM labels GROUP BY c)) WHERE size > mean + 0.5 * sd"),
    "features_row_norm": "SELECT id, pos, round(x / (sum(x) OVER (PARTITION BY id) + 1e-9), 8) AS x FROM (SELECT vec_id AS id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, abs(CAST(unnest(embedding) AS DOUBLE)) AS x FROM embeddings)",
    "features_l2_norm": "SELECT id, pos, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY id)), 1e-12), 8) AS x FROM (SELECT vec_id AS id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)",
    "adcsbm_params": "SELECT CAST(c AS INTEGER) AS c, CAST(250 AS BIGINT) AS size, round(20 * 0.8 / 249, 10) AS p_in, round(20 * (1 - 0.8) / 750, 10) AS p_out FROM range(4) x(c)",
    "sigmoid_probabilities": "SELECT id, pos, round(1 / (1 + exp(-x)), 8) AS x FROM (SELECT vec_id AS id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)",
    "feature_lines": "SELECT CAST(0 AS BIGINT) AS row, printf('%d %d', count(*), max(len(embedding))) AS line FROM embeddings UNION ALL SELECT vec_id + 1, list_aggregate(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), 'string_agg', ' ') FROM embeddings",
    "features_scan": "SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(printf('%.6f', CAST(x AS DOUBLE)) AS DOUBLE))), 4) AS total FROM embeddings",
    "soft_modularity": q(TRADE, """SELECT round((inner_ - square / total) / total, 6) AS modularity FROM
(SELECT sum(w * CASE WHEN p.t = r.t THEN 0.40::DOUBLE ELSE 0.15::DOUBLE END) AS inner_, CAST(sum(w) AS DOUBLE) AS total FROM arcs JOIN labels p ON src = p.id JOIN labels r ON dst = r.id),
(SELECT sum(v * v) AS square FROM (SELECT sum(k * CASE WHEN t = i THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END) AS v FROM labels JOIN deg USING (id), range(5) r(i) GROUP BY i))""", DEG),
    "eval_line": q(TRADE, "SELECT concat_ws(',', " + ", ".join(f"printf('%.{DECIMALS[c]}f', {c})" if c in DECIMALS else c for c in LINE) + f") AS line FROM ({EVAL})", CLUS, CONT),
    "metis_weighted_scan": q(DOCS, "SELECT src, dst, (src + dst) % 5 + 1 AS w FROM arcs"),
    "metis_scan": q(DOCS, "SELECT src, dst, w FROM arcs"),
    "labels_scan": q(DOCS, "SELECT id, c FROM labels"),
    "sweep_settings": "SELECT 'assortativity' AS setting, CAST(i AS INTEGER) AS step, round(0.95 - 0.025 * i, 3)::DOUBLE AS value FROM range(27) r(i) UNION ALL SELECT 'signal', CAST(j AS INTEGER), round(pow(10.0, (j - 20) / 10.0), 6) FROM range(31) s(j)",
}
