"""Queries of governance: verdicts, digests, plans and packets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators import governance, graph, ops, smells
from thicket.plans.code_queries import FILES, TEST, both, evidence
from thicket.plans.registry import query
from thicket.plans.views import prelude, view
from thicket.session import table

NEWEST = "SELECT path, project_code, status, coalesce(skip_reason, '') = '' AS eligible FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_seen_ms DESC NULLS LAST, status DESC NULLS LAST) AS k FROM indexed_files) q WHERE k = 1"


@query("intent_kinds", "SELECT doc_id, CASE WHEN regexp_matches(t, 'constraint|must|should|need|requires|rule') THEN 'Requirement' WHEN regexp_matches(t, 'decision|choose|adopt|use |switch|architecture') THEN 'Decision' WHEN regexp_matches(t, 'guideline|policy|convention|standard') THEN 'Guideline' WHEN regexp_matches(t, 'concept|means|term|definition') THEN 'Concept' ELSE 'Requirement' END AS kind FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) q")
def intent_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", governance.intent_kind(F.col("text")).alias("kind"))


@query("indexing_verdicts", f"WITH f AS ({NEWEST}), c AS (SELECT DISTINCT file_path AS path FROM chunks WHERE file_path IS NOT NULL), g AS (SELECT project_code, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE status <> 'discovered') AS indexed, count(*) FILTER (WHERE status = 'discovered') AS discovered, count(*) FILTER (WHERE status = 'discovered' AND c.path IS NULL) AS unextracted, count(*) AS enrolled, count(c.path) AS chunked FROM f LEFT JOIN c ON c.path = f.path GROUP BY project_code) SELECT *, CASE WHEN eligible = 0 THEN 'none_eligible' WHEN unextracted > 0 THEN 'not_extracted' WHEN discovered > 0 THEN 'stale_flags' WHEN eligible = indexed THEN 'complete' WHEN eligible > indexed THEN 'incomplete' ELSE 'stale_rows' END AS verdict, CASE WHEN chunked >= enrolled THEN NULL WHEN chunked * 100.0 / enrolled < 50 THEN 'severe' WHEN chunked * 100.0 / enrolled < 90 THEN 'partial' END AS cause FROM g")
def indexing_verdicts(spark: SparkSession, d: str) -> DataFrame:
    f = ops.newest(table(spark, d, "indexed_files"), ["path"], "last_seen_ms", "status")
    f = f.select("path", "project_code", "status", (F.coalesce("skip_reason", F.lit("")) == "").alias("eligible"))
    return governance.indexing_verdicts(f, table(spark, d, "chunks"))


DIFF = "--- a/src/distance/catalog_probe2.c\n+++ b/src/distance/catalog_probe2.c\n@@ -1 +1 @@\n-a\n+b\n--- a/src/distance/parser_publish2.ex\n+++ /dev/null\n+++ b/tools/lane_trace2.rs\n"


@query("diff_symbols", "SELECT DISTINCT p.file, source_id AS symbol FROM chunks JOIN (VALUES ('src/distance/catalog_probe2.c'), ('src/distance/parser_publish2.ex'), ('tools/lane_trace2.rs')) p(file) ON contains(file_path, p.file) WHERE source_id IS NOT NULL AND source_type = 'symbol'")
def diff_symbols(spark: SparkSession, d: str) -> DataFrame:
    return governance.symbols_of_diff(DIFF, table(spark, d, "chunks"))


@query("test_impact", prelude("nodes", "edges", recursive=True) + ", walk(id, d) AS (SELECT id, 0 FROM nodes WHERE id IN ('P:10', 'P:77', 'P:300') UNION SELECT e.source, d + 1 FROM walk JOIN edges e ON e.target = walk.id AND e.rel IN ('CALLS', 'CALLS_NIF') WHERE d < 3) SELECT w.id, min(d) AS distance FROM walk w JOIN nodes n ON n.id = w.id WHERE n.tested AND w.id NOT IN ('P:10', 'P:77', 'P:300') GROUP BY w.id")
def test_impact(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    return governance.test_impact(n, e, n.where("id in ('P:10', 'P:77', 'P:300')"), 3)


@query("resolve_symbol", "WITH s AS (SELECT DISTINCT id FROM symbols WHERE name = 'prune_anchor_bounded' OR string_split(id, '::')[-1] = 'prune_anchor_bounded' ORDER BY id LIMIT 6) SELECT id, row_number() OVER (ORDER BY id) > 1 AS homonym, (SELECT count(*) FROM s) >= 6 AS truncated FROM s")
def resolve_symbol(spark: SparkSession, d: str) -> DataFrame:
    return governance.resolve(table(spark, d, "symbols"), "prune_anchor_bounded")


@query("conception_view", "WITH m AS (SELECT project_code, file_path AS name, count(DISTINCT source_id) AS number FROM chunks WHERE file_path IS NOT NULL GROUP BY 1, 2), i AS (SELECT DISTINCT project_code, name FROM symbols WHERE kind = 'interface'), k AS (SELECT *, row_number() OVER (PARTITION BY project_code ORDER BY name) AS number FROM i) SELECT project_code, 'module' AS section, name, number FROM (SELECT *, row_number() OVER (PARTITION BY project_code ORDER BY number DESC, name) AS k FROM m) x WHERE k <= 5 UNION ALL SELECT project_code, 'interface', name, number FROM k WHERE number <= 5 UNION ALL SELECT project_code, 'public', 'all', count(DISTINCT id) FROM symbols WHERE is_public GROUP BY project_code")
def conception_view(spark: SparkSession, d: str) -> DataFrame:
    return governance.conception(table(spark, d, "chunks"), table(spark, d, "symbols"))


def _untraced(spark: SparkSession, d: str) -> DataFrame:
    from thicket.operators import intent

    return intent.untraced(view(spark, d, "intent_nodes").where("type in ('Decision', 'Requirement')"), view(spark, d, "traces"))


@query("anomalies")
def anomalies(spark: SparkSession, d: str) -> DataFrame:
    return governance.anomalies(*both(spark, d), _untraced(spark, d))


@query("anomaly_counts", prelude("nodes", "edges", "intent_nodes", "traces") + FILES + f", w AS (SELECT n.id FROM nodes n LEFT JOIN p ON p.id = n.id WHERE n.kind IN ('function', 'method') AND NOT n.is_public AND NOT {TEST} AND (SELECT count(*) FROM edges e WHERE e.rel = 'CALLS' AND e.source = n.id) = 1) SELECT 'wrapper' AS kind, 'low' AS severity, count(*) AS n FROM w UNION ALL SELECT 'orphan_code', 'medium', count(DISTINCT n.name) FROM nodes n LEFT JOIN p ON p.id = n.id WHERE n.kind IN ('function', 'method') AND NOT n.is_public AND NOT n.tested AND NOT {TEST} AND n.id NOT IN (SELECT target FROM edges WHERE rel = 'CALLS') UNION ALL SELECT 'orphan_intent', 'medium', count(*) FROM intent_nodes WHERE type IN ('Decision', 'Requirement') AND id NOT IN (SELECT entity FROM traces)")
def anomaly_counts(spark: SparkSession, d: str) -> DataFrame:
    found = anomalies(spark, d).where("kind in ('wrapper', 'orphan_code', 'orphan_intent')")
    return found.groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query("debt_digest")
def debt_digest(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    proof = evidence(spark, d, pairs=True)
    return governance.debt_digest(n, proof["pairs"], _untraced(spark, d), proof["traced"], graph.pagerank(n, e), view(spark, d, "chunk_view"))


@query("blocked_by_cycles", prelude("edges", recursive=True) + ", t AS (SELECT DISTINCT source, target FROM edges WHERE rel IN ('IMPORTS', 'USES', 'CALLS_NIF')), c(a, b) AS (SELECT source, target FROM t UNION SELECT c.a, t.target FROM c JOIN t ON t.source = c.b), y AS (SELECT DISTINCT a FROM c WHERE a = b) SELECT DISTINCT b AS id FROM c WHERE a IN (SELECT a FROM y) AND b NOT IN (SELECT a FROM y)")
def blocked_by_cycles(spark: SparkSession, d: str) -> DataFrame:
    return governance.blocked_by_cycles(both(spark, d)[1], ("IMPORTS", "USES", "CALLS_NIF"))


BONUS = {"1-URGENT": 20, "2-HIGH": 15, "3-MEDIUM": 8, "4-NOT SPECIFIED": 4, "5-LOW": 4}
PLAN = ", s AS (SELECT * FROM intent_nodes WHERE type IN ('Requirement', 'Decision', 'Milestone') AND status NOT IN ('delivered', 'superseded', 'rejected', 'archived')), e AS (SELECT DISTINCT source, target FROM intent_edges WHERE rel IN ('SOLVES', 'BELONGS_TO', 'TARGETS', 'REFINES', 'EXPLAINS', 'VERIFIES') AND source IN (SELECT id FROM s) AND target IN (SELECT id FROM s)), c(a, b) AS (SELECT source, target FROM e UNION SELECT c.a, e.target FROM c JOIN e ON e.source = c.b), h AS (SELECT a AS id, count(*) AS n FROM c WHERE a <> b GROUP BY a), sc AS (SELECT s.id, s.type, s.priority, coalesce(h.n, 0) AS descendants, round((40 * coalesce(h.n, 0) + CASE priority WHEN '1-URGENT' THEN 20 WHEN '2-HIGH' THEN 15 WHEN '3-MEDIUM' THEN 8 WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 4 ELSE 0 END - CASE WHEN type = 'Milestone' AND h.n IS NULL THEN 10 ELSE 0 END) * exp(-greatest(0.0::DOUBLE, coalesce(epoch_us(TIMESTAMP '1998-08-01') - epoch_us(created_at), 0) / 86400000000.0::DOUBLE) / 30.0::DOUBLE))::BIGINT + CASE WHEN type = 'Requirement' AND status = 'current' THEN 50 ELSE 0 END AS score FROM s LEFT JOIN h ON h.id = s.id) "
INTENT = prelude("intent_nodes", "intent_edges", recursive=True)


@query("plan_scores", INTENT + PLAN + "SELECT id, type, priority, descendants, score FROM sc")
def plan_scores(spark: SparkSession, d: str) -> DataFrame:
    return governance.plan_scores(view(spark, d, "intent_nodes"), view(spark, d, "intent_edges"), "1998-08-01", BONUS, centrality=False)


@query("plan_scores_central")
def plan_scores_central(spark: SparkSession, d: str) -> DataFrame:
    return governance.plan_scores(view(spark, d, "intent_nodes"), view(spark, d, "intent_edges"), "1998-08-01", BONUS)


@query("actionable_leaves", INTENT + PLAN + ", b AS (SELECT e.target AS id, max(sc.score) AS ps FROM intent_edges e JOIN sc ON sc.id = e.source WHERE e.rel IN ('SOLVES', 'BELONGS_TO', 'TARGETS', 'REFINES', 'EXPLAINS', 'VERIFIES') GROUP BY e.target) SELECT sc.id, score, coalesce(ps, score) AS parent_score, score + (greatest(0, least(40, coalesce(ps, score))) // 4) AS rank, CASE priority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END AS level FROM sc LEFT JOIN b ON b.id = sc.id WHERE type = 'Requirement'")
def actionable_leaves(spark: SparkSession, d: str) -> DataFrame:
    return governance.actionable_leaves(plan_scores(spark, d), view(spark, d, "intent_edges"), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"])


@query("session_anchors", prelude("intent_nodes") + "SELECT 'pillar' AS section, id, row_number() OVER (ORDER BY id) AS place FROM (SELECT id FROM intent_nodes WHERE type = 'Pillar' AND status = 'current' ORDER BY id LIMIT 10) a UNION ALL SELECT 'decision', id, row_number() OVER (ORDER BY made DESC, id) FROM (SELECT concat('DOC-', doc_id) AS id, created_at AS made FROM documents WHERE source = 'decision_records' ORDER BY made DESC, id LIMIT 10) b UNION ALL SELECT 'revision', id, row_number() OVER (ORDER BY made DESC, id) FROM (SELECT concat('DOC-', doc_id) AS id, ingested_at AS made FROM documents WHERE source = 'commit_log' ORDER BY made DESC, id LIMIT 10) c")
def session_anchors(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").withColumn("id", F.concat(F.lit("DOC-"), "doc_id"))
    return governance.anchors(view(spark, d, "intent_nodes"), doc.where("source = 'decision_records'").select("id", F.col("created_at").alias("at")), doc.where("source = 'commit_log'").select("id", F.col("ingested_at").alias("at")))


@query("friction_regressions", "SELECT o_custkey AS id, 'error' AS kind, epoch(max(o_orderdate))::BIGINT - epoch(min(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END))::BIGINT AS late_seconds FROM orders GROUP BY o_custkey HAVING max(o_orderdate) > min(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AND o_custkey % 3 = 0")
def friction_regressions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("last_observed"), F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("resolved_at"))
    kind = F.when(F.col("id") % 3 == 0, "error").otherwise("note")
    return governance.friction_regressions(o.select("id", kind.alias("kind"), F.when(F.col("resolved_at").isNotNull(), "resolved").otherwise("open").alias("status"), "last_observed", "resolved_at"))


@query("live_leases", "SELECT resource, holder, acquired_at, row_number() OVER (PARTITION BY resource ORDER BY acquired_at, holder) AS place FROM (SELECT event_type AS resource, event_id AS holder, ts AS acquired_at, ts + INTERVAL 3600 SECOND AS expires_at FROM events) l WHERE expires_at > (SELECT max(ts) FROM events)")
def live_leases(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    leases = e.select(F.col("event_type").alias("resource"), F.col("event_id").alias("holder"), F.col("ts").alias("acquired_at"), (F.col("ts") + F.expr("INTERVAL 3600 SECOND")).alias("expires_at"))
    return governance.live_leases(leases, F.lit(now))


@query("mail_fan_out", "WITH m AS (SELECT doc_id AS message_id, source AS topic, project_code AS sender FROM documents WHERE source IN ('mailbox', 'handoffs')), s AS (SELECT 'mailbox' AS topic, code AS recipient FROM projects WHERE status = 'active' UNION SELECT '*', code FROM projects WHERE status = 'paused') SELECT DISTINCT message_id, recipient FROM m JOIN s ON (s.topic = m.topic OR s.topic = '*') WHERE recipient <> sender")
def mail_fan_out(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").where("source in ('mailbox', 'handoffs')").select(F.col("doc_id").alias("message_id"), F.col("source").alias("topic"), F.col("project_code").alias("sender"))
    p = table(spark, d, "projects")
    s = p.where("status = 'active'").select(F.lit("mailbox").alias("topic"), F.col("code").alias("recipient")).unionByName(p.where("status = 'paused'").select(F.lit("*").alias("topic"), F.col("code").alias("recipient")))
    return governance.fan_out(m, s)


@query("contract_seals", prelude("tree") + ", o AS (SELECT concat('C:', o_custkey) AS p, substr(sha256(concat('O:', o_orderkey)), 1, 16) AS s, concat('O:', o_orderkey) AS id FROM orders), c AS (SELECT concat('N:', c_nationkey) AS p, concat('C:', c_custkey) AS id, substr(sha256(CASE WHEN count(s) = 0 THEN concat('C:', c_custkey) ELSE concat('C:', c_custkey, chr(31), string_agg(s, chr(31) ORDER BY s)) END), 1, 16) AS s FROM customer LEFT JOIN o ON o.p = concat('C:', c_custkey) GROUP BY c_nationkey, c_custkey), n AS (SELECT concat('R:', n_regionkey) AS p, concat('N:', n_nationkey) AS id, substr(sha256(concat('N:', n_nationkey, chr(31), string_agg(s, chr(31) ORDER BY s))), 1, 16) AS s FROM nation JOIN c ON c.p = concat('N:', n_nationkey) GROUP BY n_regionkey, n_nationkey), r AS (SELECT p AS id, substr(sha256(concat(p, chr(31), string_agg(s, chr(31) ORDER BY s))), 1, 16) AS s FROM n GROUP BY p) SELECT id, s AS seal FROM o UNION ALL SELECT id, s FROM c UNION ALL SELECT id, s FROM n UNION ALL SELECT id, s FROM r")
def contract_seals(spark: SparkSession, d: str) -> DataFrame:
    t = view(spark, d, "tree").persist()
    return governance.seals(t.select(F.col("source").alias("id")).union(t.select("target")).distinct(), t, F.col("id"))


@query("intents_round_trip", prelude("intent_nodes") + "SELECT id, type, status, regexp_replace(title, '\\s+', ' ', 'g') AS title FROM intent_nodes WHERE type <> 'Milestone'")
def intents_round_trip(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "intent_nodes").where("type <> 'Milestone'")
    text = governance.write_intents(n).select(F.col("id").alias("path"), F.concat(F.lit("# Intents\n\n"), "text", F.lit("\nprose\n")).alias("text"))
    return governance.parse_intents(text).select("id", "type", "status", "title")


@query("neighbourhood_clones")
def neighbourhood_clones(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    return governance.neighbourhood_clones(n.where("kind <> 'file'"), e.where("rel <> 'CONTAINS'"), least_edges=4).withColumn("distance", F.round("distance", 6))


@query("change_safety", prelude("nodes", "traces") + "SELECT id, CASE WHEN tested THEN 'safe' WHEN id IN (SELECT artifact_ref FROM traces) THEN 'caution' ELSE 'unsafe' END AS safety FROM nodes")
def change_safety(spark: SparkSession, d: str) -> DataFrame:
    return smells.change_safety(view(spark, d, "nodes"), view(spark, d, "traces").select(F.col("artifact_ref").alias("id")))


@query("phantom_data", "WITH e AS (SELECT concat('P:', l_partkey) AS source, concat('q::phantom::', l_suppkey % 7, l_linenumber) AS target, CASE WHEN l_suppkey % 7 = 3 AND l_partkey % 50 = 0 THEN 'DECLARES' ELSE 'READS' END AS rel FROM lineitem), g AS (SELECT target AS id, count(*) FILTER (WHERE rel = 'READS') AS r, count(DISTINCT CASE WHEN rel = 'DECLARES' THEN source END) AS d FROM e GROUP BY target) SELECT id, CASE WHEN r > 0 AND d = 0 THEN 'dead' WHEN d > 1 THEN 'multi' END AS issue FROM g WHERE (r > 0 AND d = 0) OR d > 1")
def phantom_data(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.concat(F.lit("P:"), "l_partkey").alias("source"), F.concat(F.lit("q::phantom::"), F.col("l_suppkey") % 7, "l_linenumber").alias("target"), F.when((F.col("l_suppkey") % 7 == 3) & (F.col("l_partkey") % 50 == 0), "DECLARES").otherwise("READS").alias("rel"))
    return smells.phantom_data(e)


@query("practice_tick", "SELECT vec_id AS id, CASE WHEN label = 9 THEN label / 10.0::DOUBLE ELSE label / 10.0::DOUBLE * 0.95::DOUBLE END AS trust, round(CASE WHEN label = 9 THEN 1.0 ELSE pow(1 + 19 / 81.0::DOUBLE * (vec_id % 60) / 10.0::DOUBLE, -0.5) END, 9) AS r, vec_id % 11 <> 0 AND label <> 9 AND vec_id % 60 > 14 AND (label / 10.0::DOUBLE * 0.95::DOUBLE < 0.08 OR pow(1 + 19 / 81.0::DOUBLE * (vec_id % 60) / 10.0::DOUBLE, -0.5) < 0.05) AS prune FROM embeddings")
def practice_tick(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") / 10).alias("trust"), (F.col("vec_id") % 60).alias("days"), F.lit(10.0).alias("stability"), (F.col("label") == 9).alias("durable"), F.when(F.col("vec_id") % 11 == 0, "principle").otherwise("rule").alias("tier"))
    return ops.practice_tick(v).withColumn("r", F.round("r", 9))


@query("mail_sweep", "SELECT doc_id AS message_id, created_at + INTERVAL 30 DAY < (SELECT max(ingested_at) FROM documents) AND doc_id % 3 > 1 AS archived FROM documents WHERE source = 'mailbox'")
def mail_sweep(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    now = doc.agg(F.max("ingested_at")).first()[0]
    m = doc.where("source = 'mailbox'").select(F.col("doc_id").alias("message_id"), (F.col("created_at") + F.expr("INTERVAL 30 DAYS")).alias("ttl_at"), (F.col("doc_id") % 3).alias("priority_rank"))
    return ops.sweep(m, F.lit(now)).select("message_id", "archived")
