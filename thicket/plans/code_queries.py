"""Queries over the code graph: traversals, structure and detectors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators import graph, health, retrieval, smells
from thicket.plans.registry import query
from thicket.plans.views import prelude, view
from thicket.session import table

START, END = "P:10", "P:77"
WITH = prelude("nodes", "edges")
REC = prelude("nodes", "edges", recursive=True)
#: Weak components: label the least id, by a recursion over keyed rows.
COMPONENTS = ", u AS (SELECT DISTINCT source AS a, target AS b FROM {e} WHERE source <> target UNION SELECT DISTINCT target, source FROM {e} WHERE source <> target), cc(id, component) USING KEY (id) AS (SELECT id, id FROM {n} UNION (SELECT u.b, min(cc.component) FROM cc JOIN u ON u.a = cc.id JOIN recurring.cc r ON r.id = u.b WHERE cc.component < r.component GROUP BY u.b))"
FILES = ", f AS (SELECT target AS id, min(source) AS file_id FROM edges WHERE rel = 'CONTAINS' GROUP BY target), p AS (SELECT f.id, f.file_id, n.name AS path FROM f LEFT JOIN nodes n ON n.id = f.file_id) "
TEST = r"coalesce(regexp_matches(p.path, '(^|/)(tests?|scripts)/|_test\.|\.test\.|_spec\.|\.spec\.'), false)"


def both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; the edges are used many times and kept."""
    return view(spark, d, "nodes"), view(spark, d, "edges").persist()


def walk_sql(start: str, depth: int, where: str = "true", source: str = "source", target: str = "target") -> str:
    return f", walk(id, d) AS (SELECT '{start}', 0 UNION SELECT e.{target}, d + 1 FROM walk JOIN edges e ON e.{source} = walk.id AND {where} WHERE d < {depth}), hit AS (SELECT id, min(d) AS d FROM walk GROUP BY id) "


@query("impact", REC + walk_sql(START, 5) + "SELECT h.id AS target_id, h.d AS distance, min(e.rel) AS relation_type FROM hit h JOIN edges e ON e.target = h.id JOIN hit g ON g.id = e.source AND g.d = h.d - 1 GROUP BY h.id, h.d")
def impact(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(both(spark, d)[1], START, 5)


@query("callers_of", WITH + f"SELECT source AS caller_id, 1 AS distance, min(rel) AS relation_type FROM edges WHERE target = '{START}' GROUP BY source")
def callers_of(spark: SparkSession, d: str) -> DataFrame:
    return graph.callers_of(both(spark, d)[1], START)


@query("why_chain", REC + f", walk(id, d, chain) AS (SELECT '{START}', 0, '' UNION SELECT e.source, d + 1, CASE WHEN chain = '' THEN e.rel ELSE concat(chain, '->', e.rel) END FROM walk JOIN edges e ON e.target = walk.id WHERE d < 3) SELECT w.id AS ancestor_id, w.d AS distance, min(chain) AS chain FROM walk w JOIN (SELECT id, min(d) AS d FROM walk GROUP BY id) m ON m.id = w.id AND m.d = w.d WHERE w.d > 0 GROUP BY w.id, w.d")
def why_chain(spark: SparkSession, d: str) -> DataFrame:
    return graph.why_chain(both(spark, d)[1], START, 3)


@query("blast_radius", REC + walk_sql(START, 5) + "SELECT count(*) AS blast_radius FROM hit WHERE d > 0")
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return graph.blast_radius(both(spark, d)[1], START)


@query("bfs_layers", REC + walk_sql(START, 24) + "SELECT d AS layer, count(*) AS nodes FROM hit GROUP BY d")
def bfs_layers(spark: SparkSession, d: str) -> DataFrame:
    return graph.layers(both(spark, d)[1], START, 24)


@query("bfs_neighbours_calls", REC + walk_sql(START, 4, "e.rel IN ('CALLS', 'CALLS_NIF')") + "SELECT id, d AS distance FROM hit WHERE d > 0 ORDER BY d, id LIMIT 50")
def bfs_neighbours_calls(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(both(spark, d)[1], START, 4, 50, ["CALLS", "CALLS_NIF"])


@query("shortest_path_length", REC + walk_sql(START, 10) + f"SELECT d + 1 AS hops FROM hit WHERE id = '{END}'")
def shortest_path_length(spark: SparkSession, d: str) -> DataFrame:
    path = graph.shortest_path(both(spark, d)[1], START, END)
    return path.groupBy().agg(F.count("*").cast("int").alias("hops")).where("hops > 0")


@query("shortest_path", REC + f", walk(id, d) AS (SELECT '{START}', 0 UNION SELECT e.target, d + 1 FROM walk JOIN edges e ON e.source = walk.id WHERE d < 10), hit AS (SELECT id, min(d) AS d FROM walk GROUP BY id), p AS (SELECT h.id, h.d, min({{'r': e.rel, 's': e.source}}) AS m FROM hit h JOIN edges e ON e.target = h.id JOIN hit g ON g.id = e.source AND g.d = h.d - 1 GROUP BY h.id, h.d), way(id, d, rel) AS (SELECT '{END}', (SELECT d FROM hit WHERE id = '{END}'), NULL::VARCHAR WHERE '{END}' IN (SELECT id FROM hit) UNION ALL SELECT p.m.s, p.d - 1, p.m.r FROM way JOIN p ON p.id = way.id) SELECT d AS hop, id AS node_id, rel AS relation_type FROM way")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_path(both(spark, d)[1], START, END)


@query("disjoint_paths")
def disjoint_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.disjoint_paths(both(spark, d)[1], START, END)


@query("contract_bridge_edges", WITH + "SELECT DISTINCT source, target, rel FROM edges UNION ALL SELECT source, target, rel FROM (SELECT DISTINCT target AS source, source AS target, rel, dense_rank() OVER (PARTITION BY target ORDER BY source) AS k FROM edges WHERE rel = 'IMPLEMENTS') x WHERE k <= 32")
def contract_bridge_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_contract_bridge(both(spark, d)[1])


@query("neighbourhood_edges", REC + f", u AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges), walk(id, d) AS (SELECT '{START}', 0 UNION SELECT u.target, d + 1 FROM walk JOIN u ON u.source = walk.id WHERE d < 2) SELECT e.source, e.target, e.rel FROM edges e WHERE e.source IN (SELECT id FROM walk) AND e.target IN (SELECT id FROM walk)")
def neighbourhood_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(*both(spark, d), START, 2)[1].select("source", "target", "rel")


def _pagerank_unrolled(iterations: int = 50) -> str:
    sql = [WITH, ", s AS (SELECT count(*) AS n FROM nodes), o AS (SELECT source, count(*) AS c FROM edges GROUP BY source), w AS MATERIALIZED (SELECT e.source, e.target, count(*) / any_value(o.c)::DOUBLE AS w FROM edges e JOIN o ON o.source = e.source GROUP BY e.source, e.target), dn AS MATERIALIZED (SELECT id FROM nodes WHERE id NOT IN (SELECT source FROM o)), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS r FROM nodes, s)"]
    for k in range(1, iterations + 1):
        sql.append(f", r{k} AS MATERIALIZED (SELECT n.id, 0.15 / s.n + 0.85 * (coalesce(g.v, 0) + l.v / s.n) AS r FROM nodes n, s, (SELECT coalesce(sum(r), 0) AS v FROM r{k - 1} WHERE id IN (SELECT id FROM dn)) l LEFT JOIN (SELECT w.target, sum(r * w.w) AS v FROM r{k - 1} JOIN w ON w.source = r{k - 1}.id GROUP BY w.target) g ON g.target = n.id)")
    return "".join(sql) + f" SELECT id, round(r, 9) AS rank FROM r{iterations}"


@query("pagerank", _pagerank_unrolled())
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(*both(spark, d)).select("id", F.round("rank", 9).alias("rank"))


@query("strong_components", REC + ", t AS (SELECT DISTINCT source, target FROM edges WHERE rel IN ('CALLS', 'CALLS_NIF', 'IMPORTS', 'IMPLEMENTS', 'USES', 'READS') AND source <> target), c(a, b) AS (SELECT source, target FROM t UNION SELECT c.a, t.target FROM c JOIN t ON t.source = c.b) SELECT x.a AS id, max(x.b) AS component FROM c x JOIN c y ON y.a = x.b AND y.b = x.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1")
def strong_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(graph.of_relations(both(spark, d)[1], graph.CYCLE_RELATIONS))


@query("circular_dependencies", REC + ", t AS (SELECT DISTINCT source, target FROM edges WHERE rel IN ('CALLS', 'CALLS_NIF', 'IMPORTS', 'IMPLEMENTS', 'USES', 'READS') AND source <> target), c(a, b) AS (SELECT source, target FROM t UNION SELECT c.a, t.target FROM c JOIN t ON t.source = c.b), s AS (SELECT x.a AS id, max(x.b) AS component FROM c x JOIN c y ON y.a = x.b AND y.b = x.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1) SELECT component, count(*) AS size, min(id) AS least_member FROM s GROUP BY component")
def circular_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return smells.circular_dependencies(both(spark, d)[1])


@query("components", REC + COMPONENTS.format(n="nodes", e="edges") + " SELECT id, component FROM cc")
def components(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    return graph.components(n, e)


@query("cut_points")
def cut_points(spark: SparkSession, d: str) -> DataFrame:
    return graph.cut_points(*both(spark, d))


@query("tree_bridges", prelude("tree") + "SELECT 'bridge' AS kind, least(source, target) AS a, greatest(source, target) AS b FROM tree")
def tree_bridges(spark: SparkSession, d: str) -> DataFrame:
    t = view(spark, d, "tree").persist()
    return graph.cut_points(t.select(F.col("source").alias("id")).distinct(), t).where("kind = 'bridge'")


@query("reciprocal_calls", WITH + "SELECT DISTINCT x.source AS a, x.target AS b FROM edges x JOIN edges y ON x.source = y.target AND x.target = y.source WHERE x.rel = 'CALLS' AND y.rel = 'CALLS' AND x.source < x.target")
def reciprocal_calls(spark: SparkSession, d: str) -> DataFrame:
    return graph.reciprocal(both(spark, d)[1])


@query("coverage_propagation", REC + ", w(id) AS (SELECT id FROM nodes WHERE tested UNION SELECT e.target FROM w JOIN edges e ON e.source = w.id WHERE e.rel IN ('CALLS', 'CALLS_NIF')) SELECT id FROM w")
def coverage_propagation(spark: SparkSession, d: str) -> DataFrame:
    return graph.covered(*both(spark, d))


@query("uncovered_clusters", REC + ", w(id) AS (SELECT id FROM nodes WHERE tested UNION SELECT e.target FROM w JOIN edges e ON e.source = w.id WHERE e.rel IN ('CALLS', 'CALLS_NIF')), x AS (SELECT id FROM nodes WHERE kind <> 'file' AND id NOT IN (SELECT id FROM w)), y AS (SELECT * FROM edges WHERE source IN (SELECT id FROM x) AND target IN (SELECT id FROM x))" + COMPONENTS.format(n="x", e="y") + " SELECT component AS cluster, count(*) AS size FROM cc GROUP BY component HAVING count(*) > 1")
def uncovered_clusters(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    return graph.clusters(n.where("kind <> 'file'").join(graph.covered(n, e), "id", "left_anti"), e)


LAYERS = [("src/domain/", 0), ("src/app/", 1), ("src/infra/", 2), ("src/", 3)]


@query("layer_violations", WITH + FILES + ", r AS (SELECT p.id, CASE WHEN path LIKE 'src/domain/%' THEN 0 WHEN path LIKE 'src/app/%' THEN 1 WHEN path LIKE 'src/infra/%' THEN 2 WHEN path LIKE 'src/%' THEN 3 END AS k FROM p) SELECT e.source, e.target, e.rel, a.k AS source_priority, b.k AS target_priority FROM edges e JOIN r a ON a.id = e.source JOIN r b ON b.id = e.target WHERE a.k < b.k")
def layer_violations(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    return graph.layer_violations(smells.files_of(n, e).select("id", F.col("path").alias("name")), e, LAYERS)


@query("drift_scores", WITH + FILES + ", r AS (SELECT p.id, CASE WHEN path LIKE 'src/domain/%' THEN 0 WHEN path LIKE 'src/app/%' THEN 1 WHEN path LIKE 'src/infra/%' THEN 2 WHEN path LIKE 'src/%' THEN 3 END AS k FROM p) SELECT concat(a.k, '->', b.k) AS layer_pair, count(*) AS score FROM edges e JOIN r a ON a.id = e.source JOIN r b ON b.id = e.target WHERE a.k < b.k GROUP BY 1")
def drift_scores(spark: SparkSession, d: str) -> DataFrame:
    return layer_violations(spark, d).groupBy(F.concat("source_priority", F.lit("->"), "target_priority").alias("layer_pair")).agg(F.count("*").alias("score"))


@query("edge_difference", WITH + ", a AS (SELECT DISTINCT source, target, rel FROM edges WHERE rel <> 'USES'), b AS (SELECT DISTINCT source, target, rel FROM edges WHERE rel <> 'READS') SELECT 'added' AS change, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a) x UNION ALL SELECT 'removed', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) y")
def edge_difference(spark: SparkSession, d: str) -> DataFrame:
    e = both(spark, d)[1]
    return graph.edge_difference(e.where("rel <> 'USES'"), e.where("rel <> 'READS'"))


@query("tree_waves", prelude("tree") + "SELECT source AS id, CASE substr(source, 1, 1) WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS wave FROM tree UNION SELECT target, CASE substr(target, 1, 1) WHEN 'N' THEN 2 WHEN 'C' THEN 3 ELSE 4 END FROM tree")
def tree_waves(spark: SparkSession, d: str) -> DataFrame:
    t = view(spark, d, "tree").persist()
    return graph.waves(t.select(F.col("source").alias("id")).union(t.select("target")).distinct(), t)


@query("tree_descendants", prelude("tree", recursive=True) + ", c(a, b) AS (SELECT source, target FROM tree UNION SELECT c.a, t.target FROM c JOIN tree t ON t.source = c.b) SELECT a AS id, count(*) AS descendants FROM c GROUP BY a")
def tree_descendants(spark: SparkSession, d: str) -> DataFrame:
    return graph.descendants(view(spark, d, "tree").persist())


@query("two_hop_expansion", WITH + f", z AS (SELECT '{START}' AS id, 0 AS d UNION ALL SELECT target, 1 FROM edges WHERE source = '{START}' UNION ALL SELECT y.target, 2 FROM edges x JOIN edges y ON y.source = x.target WHERE x.source = '{START}') SELECT id, min(d) AS distance FROM z GROUP BY id")
def two_hop_expansion(spark: SparkSession, d: str) -> DataFrame:
    return graph.two_hops(both(spark, d)[1], spark.createDataFrame([(START,)], "id string"))


@query("phantom_resolution", WITH + ", ph AS (SELECT DISTINCT source, CASE WHEN target IN (SELECT id FROM nodes WHERE complexity % 7 = 0) THEN concat('X::', target) ELSE target END AS target, rel FROM edges), k AS (SELECT id AS short, min(id) AS only FROM nodes WHERE kind IN ('function', 'method') GROUP BY id HAVING count(*) = 1) SELECT source, target, rel, max(r) AS resolved FROM (SELECT ph.source, coalesce(k.only, ph.target) AS target, ph.rel, k.only IS NOT NULL OR ph.target NOT LIKE 'X::%' AS r FROM ph LEFT JOIN k ON ph.target = concat('X::', k.short)) q WHERE rel <> 'CALLS_NIF' GROUP BY source, target, rel")
def phantom_resolution(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    lost = n.where("complexity % 7 = 0").select(F.col("id").alias("target"), F.lit(True).alias("lost"))
    phantoms = e.join(lost, "target", "left").select("source", F.when(F.col("lost"), F.concat(F.lit("X::"), "target")).otherwise(F.col("target")).alias("target"), "rel")
    return graph.resolve_phantoms(n, phantoms).where("rel <> 'CALLS_NIF'")


@query("triangle_matches", WITH + ", t AS (SELECT DISTINCT source, target FROM edges) SELECT x.source AS a, x.target AS b, y.target AS c FROM t x JOIN t y ON y.source = x.target JOIN t z ON z.source = x.source AND z.target = y.target WHERE x.source <> x.target AND y.target <> x.target AND x.source <> y.target")
def triangle_matches(spark: SparkSession, d: str) -> DataFrame:
    return graph.subgraph_matches([("a", "b"), ("b", "c"), ("a", "c")], both(spark, d)[1])


#: Calls of a seventh of the symbols go to phantoms of their bare names.
PHANTOM = ", ph AS (SELECT DISTINCT source, CASE WHEN rel IN ('CALLS', 'CALLS_NIF') AND target IN (SELECT id FROM nodes WHERE complexity % 7 = 0) THEN concat('X::', target) ELSE target END AS target, rel FROM edges), lost AS (SELECT DISTINCT source, target, string_split(target, '::')[-1] AS bare FROM ph WHERE rel IN ('CALLS', 'CALLS_NIF') AND target NOT IN (SELECT target FROM ph WHERE rel = 'CONTAINS')), tf AS (SELECT DISTINCT target AS id FROM ph WHERE rel = 'CONTAINS' AND source IN (SELECT f.source FROM ph f JOIN ph i ON i.source = f.target WHERE f.rel = 'CONTAINS' AND i.rel = 'IMPLEMENTS'))"


def phantoms(n: DataFrame, e: DataFrame) -> DataFrame:
    lost = n.where("complexity % 7 = 0").select(F.col("id").alias("target"), F.lit(True).alias("lost"))
    t = F.when(F.col("lost") & F.col("rel").isin("CALLS", "CALLS_NIF"), F.concat(F.lit("X::"), "target")).otherwise(F.col("target"))
    return e.join(lost, "target", "left").select("source", t.alias("target"), "rel").distinct()


DETECTORS = {
    "wrappers": (smells.wrappers, WITH + FILES + f", o AS (SELECT source, min(target) AS target FROM edges WHERE rel = 'CALLS' GROUP BY source HAVING count(*) = 1), k AS (SELECT target, count(*) AS c FROM edges WHERE rel = 'CALLS' GROUP BY target) SELECT n.id, n.name AS src, t.name AS tgt, coalesce(k.c, 0) AS callers FROM nodes n LEFT JOIN p ON p.id = n.id JOIN o ON o.source = n.id JOIN nodes t ON t.id = o.target LEFT JOIN k ON k.target = o.target WHERE n.kind IN ('function', 'method') AND NOT n.is_public AND NOT {TEST}"),
    "feature_envy": (smells.feature_envy, WITH + FILES + ", c AS (SELECT e.source, tf.file_id AS tf, tf.file_id IS DISTINCT FROM sf.file_id AS away FROM edges e JOIN f tf ON tf.id = e.target LEFT JOIN f sf ON sf.id = e.source WHERE e.rel = 'CALLS' AND e.source IN (SELECT id FROM nodes WHERE kind IN ('function', 'method'))), g AS (SELECT source, tf, count(*) AS n, bool_or(away) AS away FROM c GROUP BY source, tf), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY away DESC, n DESC, tf DESC) AS k FROM g) SELECT source AS id, sum(n)::BIGINT AS total, sum(CASE WHEN away THEN n ELSE 0 END)::BIGINT AS \"foreign\", max(CASE WHEN k = 1 AND away THEN tf END) AS dominant FROM r GROUP BY source HAVING sum(n) >= 3 AND sum(CASE WHEN away THEN n ELSE 0 END) >= 2 AND sum(CASE WHEN away THEN n ELSE 0 END) > sum(n) - sum(CASE WHEN away THEN n ELSE 0 END)"),
    "god_objects": (smells.god_objects, WITH + ", o AS (SELECT source, count(*) AS c FROM edges WHERE rel IN ('CALLS', 'CALLS_NIF') GROUP BY source) SELECT id, complexity, c AS fan_out FROM nodes JOIN o ON source = id WHERE complexity > 10 AND c > 10"),
    "orphan_code": (smells.orphan_code, WITH + FILES + f"SELECT DISTINCT n.name FROM nodes n LEFT JOIN p ON p.id = n.id WHERE n.kind IN ('function', 'method') AND NOT n.is_public AND NOT n.tested AND NOT {TEST} AND n.id NOT IN (SELECT target FROM edges WHERE rel = 'CALLS')"),
    "dead_code": (smells.dead_code, WITH + FILES + f"SELECT n.id FROM nodes n JOIN p ON p.id = n.id WHERE n.kind IN ('function', 'method') AND NOT n.is_public AND NOT n.tested AND NOT {TEST} AND n.id NOT IN (SELECT target FROM edges WHERE rel IN ('CALLS', 'CALLS_NIF'))"),
    "unsafe_exposure": (smells.unsafe_exposure, REC + ", e2 AS (SELECT DISTINCT source, target FROM edges WHERE rel = 'CALLS'), w(sink, pos, d) AS (SELECT id, id, 0 FROM nodes WHERE is_unsafe OR name = 'unwrap' UNION SELECT w.sink, e2.source, d + 1 FROM w JOIN e2 ON e2.target = w.pos WHERE d < 10) SELECT DISTINCT w.pos AS source, sink FROM w JOIN nodes n ON n.id = w.pos WHERE sink <> pos AND n.kind IN ('function', 'method') AND n.is_public"),
    "injection_risk": (smells.injection_risk, REC + ", e2 AS (SELECT DISTINCT source, target FROM edges WHERE rel = 'CALLS'), w(sink, pos, d) AS (SELECT id, id, 0 FROM nodes WHERE lower(name) IN ('eval', 'exec', 'system', 'raw_sql', 'query_raw', 'popen', 'shell') UNION SELECT w.sink, e2.source, d + 1 FROM w JOIN e2 ON e2.target = w.pos WHERE d < 10) SELECT DISTINCT w.pos AS source, sink FROM w JOIN nodes n ON n.id = w.pos WHERE sink <> pos AND n.kind IN ('function', 'method') AND n.is_public"),
    "nif_blocking": (smells.nif_blocking, REC + ", e2 AS (SELECT DISTINCT source, target FROM edges WHERE rel = 'CALLS'), w(id, pos, d) AS (SELECT DISTINCT target, target, 0 FROM edges WHERE rel = 'CALLS_NIF' UNION SELECT w.id, e2.target, d + 1 FROM w JOIN e2 ON e2.source = w.pos WHERE d < 20), m AS (SELECT id, pos, min(d) AS d FROM w GROUP BY id, pos) SELECT id, max(d) AS depth FROM m GROUP BY id HAVING max(d) > 5"),
    "security_audit": (smells.security_audit, WITH + ", s AS (SELECT id FROM nodes WHERE is_unsafe OR lower(name) IN ('eval', 'unwrap')), c AS (SELECT source, target FROM edges WHERE rel IN ('CALLS', 'CALLS_NIF')), h AS (SELECT source AS id FROM c WHERE target IN (SELECT id FROM s) UNION SELECT y.source FROM c x JOIN c y ON y.target = x.source WHERE x.target IN (SELECT id FROM s)) SELECT least(count(*), 100) AS findings, greatest(0, 100 - 20 * least(count(*), 100)) AS score FROM h WHERE id NOT IN (SELECT id FROM s)"),
    "technical_debt": (smells.technical_debt, WITH + FILES + ", x AS (SELECT id, CASE WHEN name LIKE 'todo%' THEN 'todo' END AS reason FROM nodes WHERE name LIKE 'todo%' UNION SELECT e.source, concat('calls ', n.name) FROM edges e JOIN nodes n ON n.id = e.target WHERE e.rel = 'CALLS' AND n.name IN ('unwrap', 'eval')) SELECT id, reason FROM x WHERE id IN (SELECT id FROM f)"),
    "telemetry_score": (smells.telemetry_score, WITH + "SELECT count(*) AS calls, greatest(0, 100 - 5 * count(*)) AS score FROM edges WHERE rel = 'CALLS' AND target IN (SELECT id FROM nodes WHERE name = 'println!')"),
    "detours": (smells.detours, WITH + FILES + f", i AS (SELECT target AS mid, min(source) AS src FROM edges WHERE rel = 'CALLS' GROUP BY target HAVING count(*) = 1), o AS (SELECT source AS mid, min(target) AS dst FROM edges WHERE rel = 'CALLS' GROUP BY source HAVING count(*) = 1) SELECT i.src, n.id AS mid, o.dst FROM nodes n JOIN i ON i.mid = n.id JOIN o ON o.mid = n.id JOIN p ON p.id = n.id JOIN p a ON a.id = i.src JOIN p b ON b.id = o.dst WHERE n.kind IN ('function', 'method') AND NOT n.is_public AND src <> dst AND a.file_id = p.file_id AND b.file_id = p.file_id AND NOT {TEST}"),
    "domain_leakage": (smells.domain_leakage, WITH + FILES + "SELECT e.source, e.target, a.path AS source_path, b.path AS target_path FROM edges e JOIN p a ON a.id = e.source JOIN p b ON b.id = e.target WHERE e.rel = 'CALLS' AND lower(a.path) LIKE '%domain%' AND lower(b.path) LIKE '%infra%'"),
    "cross_file_flows": (smells.cross_file_flows, WITH + FILES + "SELECT a.path AS source_path, b.path AS target_path, count(*) AS calls FROM edges e JOIN p a ON a.id = e.source JOIN p b ON b.id = e.target WHERE e.rel = 'CALLS' AND a.file_id <> b.file_id GROUP BY 1, 2"),
    "wiring_orphans": (smells.wiring_orphans, WITH + FILES + f", c AS (SELECT e.target AS id, sum(CASE WHEN n.tested THEN 0 ELSE 1 END) AS prod, sum(CASE WHEN n.tested THEN 1 ELSE 0 END) AS tests FROM (SELECT DISTINCT source, target FROM edges WHERE rel IN ('CALLS', 'CALLS_NIF')) e JOIN nodes n ON n.id = e.source GROUP BY e.target) SELECT n.id, CASE WHEN coalesce(c.tests, 0) > 0 THEN 'test_only' ELSE 'isolated' END AS state, coalesce(c.tests, 0)::BIGINT AS test_callers FROM nodes n LEFT JOIN p ON p.id = n.id LEFT JOIN c ON c.id = n.id WHERE n.kind IN ('function', 'method') AND n.is_public AND NOT n.tested AND NOT n.is_entry_point AND n.name NOT IN ('main', 'run_main') AND NOT {TEST} AND coalesce(c.prod, 0) = 0"),
    "god_names": (lambda n, e: smells.god_names(n, e, 3), WITH + "SELECT n.id, n.name, count(DISTINCT e.target) AS fan_out FROM nodes n JOIN edges e ON e.source = n.id WHERE e.rel = 'CALLS' AND length(n.name) >= 3 GROUP BY n.id, n.name HAVING count(DISTINCT e.target) >= 3"),
    "symbols_in_files": (lambda n, e: smells.symbols_in_files(n, e, "domain%1"), WITH + FILES + "SELECT id, path FROM p WHERE path LIKE '%domain%1%'"),
    "coverage_score": (lambda n, e: smells.coverage_score(n), WITH + "SELECT project_code, count(*) AS total, sum(CASE WHEN tested THEN 1 ELSE 0 END)::BIGINT AS tested, floor(100.0 * sum(CASE WHEN tested THEN 1 ELSE 0 END) / count(*))::INT AS score FROM nodes WHERE kind <> 'file' GROUP BY project_code"),
    "api_break_check": (lambda n, e: e.where(F.col("target") == START).select("source").distinct().join(n.select(F.col("id").alias("source"), "name"), "source"), WITH + f"SELECT DISTINCT e.source, n.name FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = '{START}'"),
    "tests_for": (lambda n, e: graph.reach(graph.reversed_edges(graph.of_relations(e, ["CALLS", "CALLS_NIF"])), n.where(F.col("id") == START), 4).join(n.where("tested").select("id"), "id", "left_semi").select("id", "distance"), REC + walk_sql(START, 4, "e.rel IN ('CALLS', 'CALLS_NIF')", "target", "source") + "SELECT h.id, h.d AS distance FROM hit h JOIN nodes n ON n.id = h.id WHERE h.d > 0 AND n.tested"),
    "simulate_mutation": (lambda n, e: graph.reach(graph.reversed_edges(e), n.where(F.col("id") == START), 5).groupBy("distance").agg(F.count("*").alias("affected")), REC + walk_sql(START, 5, "true", "target", "source") + "SELECT d AS distance, count(*) AS affected FROM hit WHERE d > 0 GROUP BY d"),
    "bidi_trace": (lambda n, e: graph.reach(e, n.where(F.col("id") == START), 24).select(F.lit("forward").alias("direction"), "id", "distance").unionByName(graph.reach(graph.reversed_edges(e), n.where(F.col("id") == START), 24).select(F.lit("backward").alias("direction"), "id", "distance")), REC + walk_sql(START, 24) + ", back(id, d) AS (SELECT '" + START + "', 0 UNION SELECT e.source, d + 1 FROM back JOIN edges e ON e.target = back.id WHERE d < 24) SELECT 'forward' AS direction, id, d AS distance FROM hit WHERE d > 0 UNION ALL SELECT 'backward', id, min(d) FROM back WHERE d > 0 AND id <> '" + START + "' GROUP BY id"),
    "degrees": (lambda n, e: graph.degrees(e), WITH + "SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree FROM (SELECT source AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target, 1, 0 FROM edges) x GROUP BY id"),
    "structural_invariants": (lambda n, e: smells.invariants(n, e, [{"id": "no-nif-from-interface", "mode": "forbidden", "source": {"kind": "interface"}, "relations": ["CALLS_NIF"]}, {"id": "class-calls", "mode": "required", "source": {"kind": "class"}, "relations": ["CALLS"]}]), WITH + "SELECT 'no-nif-from-interface' AS rule, e.source, e.target FROM edges e JOIN nodes n ON n.id = e.source JOIN nodes t ON t.id = e.target WHERE n.kind = 'interface' AND e.rel = 'CALLS_NIF' UNION ALL SELECT 'class-calls', id, NULL FROM nodes WHERE kind = 'class' AND id NOT IN (SELECT e.source FROM edges e JOIN nodes t ON t.id = e.target WHERE e.rel = 'CALLS')"),
    "abstraction_detours": (smells.abstraction_detours, WITH + FILES + ", h AS (SELECT i.id AS interface, c.id AS implementation FROM nodes i JOIN p a ON a.id = i.id JOIN p b ON b.file_id = a.file_id JOIN nodes c ON c.id = b.id WHERE i.kind = 'interface' AND c.kind IN ('class', 'struct', 'module') AND (lower(c.name) = lower(i.name) || 'impl' OR lower(c.name) = lower(i.name) || '_impl' OR (starts_with(lower(c.name), lower(i.name)) AND contains(lower(c.name), 'adapter')))) SELECT interface, min(implementation) AS implementation FROM h GROUP BY interface HAVING count(*) = 1"),
    "dead_clusters": (lambda n, e: smells.dead_clusters(n, phantoms(n, e), n.where(F.col("kind").isin("function", "method")), n.where("is_entry_point"))[0], REC + PHANTOM + ", bridge AS (SELECT target AS source, source AS target FROM (SELECT DISTINCT source, target, dense_rank() OVER (PARTITION BY target ORDER BY source) AS k FROM ph WHERE rel = 'IMPLEMENTS') q WHERE k <= 32 AND NOT EXISTS (SELECT 1 FROM ph z WHERE z.rel = 'IMPLEMENTS' AND z.source = q.target AND z.target = q.source)), fw AS (SELECT source, target FROM ph WHERE rel IN ('CALLS', 'CALLS_NIF') UNION SELECT source, target FROM bridge UNION SELECT l.target, n.id FROM lost l JOIN nodes n ON n.id = l.bare JOIN tf ON tf.id = n.id WHERE n.kind IN ('function', 'method')), w(id) AS (SELECT id FROM nodes WHERE is_entry_point UNION SELECT fw.target FROM w JOIN fw ON fw.source = w.id), x AS (SELECT id FROM nodes WHERE kind IN ('function', 'method') AND id NOT IN (SELECT id FROM w)), y AS (SELECT * FROM ph WHERE source IN (SELECT id FROM x) AND target IN (SELECT id FROM x))" + COMPONENTS.format(n="x", e="y") + " SELECT component AS cluster, count(*) AS size FROM cc GROUP BY component HAVING count(*) > 1"),
    "wiring_orphans_dispatch": (lambda n, e: smells.wiring_orphans(n, phantoms(n, e)), WITH + PHANTOM + ", p AS (SELECT f.id, f.file_id, n.name AS path FROM (SELECT target AS id, min(source) AS file_id FROM ph WHERE rel = 'CONTAINS' GROUP BY target) f LEFT JOIN nodes n ON n.id = f.file_id)" + f", c AS (SELECT e.target AS id, sum(CASE WHEN n.tested THEN 0 ELSE 1 END) AS prod, sum(CASE WHEN n.tested THEN 1 ELSE 0 END) AS tests FROM (SELECT DISTINCT source, target FROM ph WHERE rel IN ('CALLS', 'CALLS_NIF')) e JOIN nodes n ON n.id = e.source GROUP BY e.target), lc AS (SELECT bare, sum(CASE WHEN n.tested THEN 0 ELSE 1 END) AS prod, sum(CASE WHEN n.tested THEN 1 ELSE 0 END) AS tests FROM lost l JOIN nodes n ON n.id = l.source GROUP BY bare), o AS (SELECT n.id, coalesce(c.tests, 0) + CASE WHEN tf.id IS NULL THEN 0 ELSE coalesce(lc.tests, 0) END AS tests, CASE WHEN tf.id IS NULL THEN 0 ELSE coalesce(lc.prod, 0) END AS prod FROM nodes n LEFT JOIN p ON p.id = n.id LEFT JOIN c ON c.id = n.id LEFT JOIN lc ON lc.bare = n.id LEFT JOIN tf ON tf.id = n.id WHERE n.kind IN ('function', 'method') AND n.is_public AND NOT n.tested AND NOT n.is_entry_point AND n.name NOT IN ('main', 'run_main') AND NOT {TEST} AND coalesce(c.prod, 0) = 0) SELECT id, CASE WHEN tests > 0 THEN 'test_only' ELSE 'isolated' END AS state, tests::BIGINT AS test_callers FROM o WHERE prod = 0"),
}
for _name, (_detector, _sql) in DETECTORS.items():
    query(_name, _sql)(lambda spark, d, f=_detector: f(*both(spark, d)))


#: Symbols nearer than this are duplicates, as studied.
DUPLICATE = 0.10


def evidence(spark: SparkSession, d: str, pairs: bool = False) -> dict:
    """What the axes measure besides the graph: symbols with a trace, and near-duplicate pairs of symbols by their vectors."""
    traced = view(spark, d, "traces").where("artifact_type = 'Symbol'").select(F.col("artifact_ref").alias("id")).distinct()
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    owner = lambda c: F.concat(F.lit("P:"), F.col(c) % 200)
    near = retrieval.similar_pairs(vectors, "label", DUPLICATE).select(owner("a").alias("a"), owner("b").alias("b")).where("a <> b")
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return {"traced": traced, "pairs": near} if pairs else {"traced": traced, "duplicates": near.count()}


@query("structural_health_index")
def structural_health_index(spark: SparkSession, d: str) -> DataFrame:
    return health.index(*both(spark, d), **evidence(spark, d))


@query("health_worklist")
def health_worklist(spark: SparkSession, d: str) -> DataFrame:
    return health.worklist(*both(spark, d), **evidence(spark, d))


@query("main_sequence", WITH + ", m AS (SELECT id, project_code AS module, kind = 'interface' AS abstract FROM nodes WHERE kind <> 'file'), x AS (SELECT DISTINCT a.module AS s, b.module AS t, e.source, e.target FROM edges e JOIN m a ON a.id = e.source JOIN m b ON b.id = e.target WHERE a.module <> b.module AND e.rel IN ('CALLS', 'CALLS_NIF', 'IMPORTS', 'IMPLEMENTS', 'USES', 'READS', 'READS_ARTIFACT')), ca AS (SELECT t AS module, count(DISTINCT source) AS ca FROM x GROUP BY t), ce AS (SELECT s AS module, count(DISTINCT target) AS ce FROM x GROUP BY s), a AS (SELECT module, avg(CASE WHEN abstract THEN 1.0 ELSE 0 END) AS a FROM m GROUP BY module) SELECT a.module, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, round(abs(a.a + coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0))::DOUBLE - 1), 6) AS distance FROM a LEFT JOIN ca ON ca.module = a.module LEFT JOIN ce ON ce.module = a.module WHERE coalesce(ca, 0) + coalesce(ce, 0) > 0")
def main_sequence(spark: SparkSession, d: str) -> DataFrame:
    return health.main_sequence(*both(spark, d)).withColumn("distance", F.round("distance", 6))


@query("audit_bundle")
def audit_bundle(spark: SparkSession, d: str) -> DataFrame:
    return health.audit(*both(spark, d))
