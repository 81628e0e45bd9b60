"""Queries over the intent graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators import contracts, graph, intent
from thicket.plans.registry import query
from thicket.plans.views import prelude, view
from thicket.session import table

WITH = prelude("intent_nodes", "intent_edges", "traces")
COVER = "SELECT r.id, CASE WHEN status IN ('delivered', 'superseded', 'rejected', 'archived') THEN 'done' WHEN coalesce(e, 0) > 0 AND coalesce(b, 0) = 0 AND criteria IS NOT NULL AND status IN ('current', 'accepted') THEN 'done' WHEN coalesce(e, 0) > 0 OR criteria IS NOT NULL THEN 'partial' ELSE 'missing' END AS state, concat_ws(',', CASE WHEN coalesce(e, 0) = 0 THEN 'evidence' END, CASE WHEN coalesce(b, 0) > 0 THEN 'broken' END, CASE WHEN criteria IS NULL THEN 'criteria' END, CASE WHEN status NOT IN ('current', 'accepted', 'delivered', 'superseded', 'rejected', 'archived') THEN 'status' END) AS gaps, coalesce(e, 0) AS evidence, coalesce(b, 0) AS broken FROM intent_nodes r LEFT JOIN (SELECT entity, count(*) AS e, sum(CASE WHEN artifact_status = 'broken' THEN 1 ELSE 0 END)::BIGINT AS b FROM traces GROUP BY entity) t ON t.entity = r.id WHERE type = 'Requirement'"


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return view(spark, d, "intent_nodes"), view(spark, d, "intent_edges"), view(spark, d, "traces")


@query("requirement_states", WITH + COVER)
def requirement_states(spark: SparkSession, d: str) -> DataFrame:
    n, _, t = parts(spark, d)
    return intent.coverage_states(n.where("type = 'Requirement'"), t)


@query("uncovered_requirements", WITH + "SELECT id FROM intent_nodes WHERE type = 'Requirement' AND criteria IS NULL AND id NOT IN (SELECT entity FROM traces)")
def uncovered_requirements(spark: SparkSession, d: str) -> DataFrame:
    n, _, t = parts(spark, d)
    return intent.uncovered(n.where("type = 'Requirement'"), t)


@query("intent_orphans", WITH + "SELECT id, type FROM intent_nodes WHERE type IN ('Requirement', 'Decision', 'Validation') AND id NOT IN (SELECT entity FROM traces)")
def intent_orphans(spark: SparkSession, d: str) -> DataFrame:
    n, _, t = parts(spark, d)
    return intent.untraced(n, t)


@query("illegal_relations", WITH + ", x AS (SELECT * FROM intent_edges UNION ALL SELECT target, source, rel FROM intent_edges WHERE rel = 'VERIFIES') SELECT source, target, rel FROM x WHERE NOT ((substr(source, 1, 3), substr(target, 1, 3), rel) IN (('PIL', 'VIS', 'EPITOMIZES'), ('REQ', 'PIL', 'BELONGS_TO'), ('DEC', 'REQ', 'SOLVES'), ('VAL', 'REQ', 'VERIFIES'), ('MIL', 'REQ', 'TARGETS')))")
def illegal_relations(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "intent_edges")
    return intent.illegal_edges(e.unionByName(graph.reversed_edges(e.where("rel = 'VERIFIES'"))))


RULES = [
    {"id": "requirement-has-pillar", "predicate": "required_edge", "source": "Requirement", "relation": "BELONGS_TO"},
    {"id": "no-broken-evidence", "predicate": "forbidden_evidence", "type": "Requirement", "status": "broken"},
    {"id": "requirement-has-criteria", "predicate": "required_field", "type": "Requirement", "field": "criteria"},
    {"id": "decision-solves-few", "predicate": "at_most", "type": "Decision", "relation": "SOLVES", "most": 150},
    {"id": "no-milestone-target", "predicate": "forbidden_edge", "source": "Milestone", "target": "Requirement", "relation": "TARGETS"},
    {"id": "validation-title", "predicate": "body_contains", "type": "Validation", "words": ["blue", "red"]},
    {"id": "validation-unique", "predicate": "unique_by", "type": "Validation", "field": "title"},
    {"id": "requirement-reaches-vision", "predicate": "reaches", "source": "Requirement", "target": "Vision", "relations": ["BELONGS_TO", "EPITOMIZES"]},
]


@query("intent_rules", WITH + """SELECT 'requirement-has-pillar' AS rule, 'required_edge' AS predicate, id AS source, CAST(NULL AS VARCHAR) AS target FROM intent_nodes WHERE type = 'Requirement' AND id NOT IN (SELECT source FROM intent_edges WHERE rel = 'BELONGS_TO')
UNION ALL SELECT 'no-broken-evidence', 'forbidden_evidence', entity, id FROM traces WHERE artifact_status = 'broken' AND entity IN (SELECT id FROM intent_nodes WHERE type = 'Requirement')
UNION ALL SELECT 'requirement-has-criteria', 'required_field', id, NULL FROM intent_nodes WHERE type = 'Requirement' AND criteria IS NULL
UNION ALL SELECT 'decision-solves-few', 'at_most', source, NULL FROM intent_edges WHERE rel = 'SOLVES' GROUP BY source HAVING count(DISTINCT target) > 150
UNION ALL SELECT 'no-milestone-target', 'forbidden_edge', source, target FROM intent_edges WHERE rel = 'TARGETS'
UNION ALL SELECT 'validation-title', 'body_contains', id, NULL FROM intent_nodes WHERE type = 'Validation' AND NOT regexp_matches(title, '(?i)blue|red')
UNION ALL SELECT 'validation-unique', 'unique_by', n.id, m.m FROM intent_nodes n JOIN (SELECT title, min(id) AS m FROM intent_nodes WHERE type = 'Validation' GROUP BY title HAVING count(*) > 1) m ON m.title = n.title WHERE n.type = 'Validation' AND n.id <> m.m
UNION ALL SELECT 'requirement-reaches-vision', 'reaches', id, NULL FROM intent_nodes WHERE type = 'Requirement' AND id NOT IN (SELECT a.source FROM intent_edges a JOIN intent_edges b ON b.source = a.target AND b.rel = 'EPITOMIZES' WHERE a.rel = 'BELONGS_TO')""")
def intent_rules(spark: SparkSession, d: str) -> DataFrame:
    return intent.rule_violations(*parts(spark, d), RULES)


@query("work_plan", WITH + "SELECT n.id, round((40 * coalesce(h.c, 0) + CASE priority WHEN '1-URGENT' THEN 20 WHEN '2-HIGH' THEN 15 WHEN '3-MEDIUM' THEN 8 ELSE 4 END) * exp(-greatest(0.0, datediff('day', CAST(created_at AS DATE), DATE '1998-12-31')) / 365.0::DOUBLE) + CASE WHEN status = 'current' THEN 50 ELSE 0 END, 6) AS score FROM intent_nodes n LEFT JOIN (SELECT target, count(DISTINCT source) AS c FROM intent_edges WHERE rel IN ('SOLVES', 'VERIFIES', 'TARGETS', 'REFINES') GROUP BY target) h ON h.target = n.id WHERE type = 'Requirement'")
def work_plan(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = parts(spark, d)
    return intent.work_plan(n.where("type = 'Requirement'"), e, "1998-12-31", 365.0).withColumn("score", F.round("score", 6))


@query("roadmap", WITH + f", s AS ({COVER}), t AS (SELECT source AS milestone, target AS id FROM intent_edges WHERE rel = 'TARGETS'), b AS (SELECT source AS id, min(target) AS pillar FROM intent_edges WHERE rel = 'BELONGS_TO' GROUP BY source), j AS (SELECT t.milestone, s.state, b.pillar FROM t JOIN s ON s.id = t.id LEFT JOIN b ON b.id = t.id), p AS (SELECT milestone, pillar, row_number() OVER (PARTITION BY milestone ORDER BY count(*) DESC, pillar DESC) AS k FROM j WHERE pillar IS NOT NULL GROUP BY milestone, pillar) SELECT c.milestone, c.requirements, c.ready, p.pillar AS dominant_pillar, c.ready / c.requirements::DOUBLE AS readiness FROM (SELECT milestone, count(*) AS requirements, sum(CASE WHEN state = 'done' THEN 1 ELSE 0 END)::BIGINT AS ready FROM j GROUP BY milestone) c LEFT JOIN p ON p.milestone = c.milestone AND p.k = 1")
def roadmap(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = parts(spark, d)
    return intent.roadmap(n, e, requirement_states(spark, d))


@query("next_ids", WITH + "SELECT substr(id, 1, 3) AS prefix, max(CAST(regexp_extract(id, '-(\\d+)$', 1) AS BIGINT)) AS last, max(CAST(regexp_extract(id, '-(\\d+)$', 1) AS BIGINT)) + 1 AS next FROM intent_nodes GROUP BY 1")
def next_ids(spark: SparkSession, d: str) -> DataFrame:
    return intent.next_ids(view(spark, d, "intent_nodes"))


@query("intent_children", WITH + "SELECT source AS id, rel FROM intent_edges WHERE target = 'PIL-3' ORDER BY id LIMIT 200")
def intent_children(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "intent_edges").where("target = 'PIL-3'").select(F.col("source").alias("id"), "rel").orderBy("id").limit(200)


@query("contract_shapes", "SELECT l_orderkey AS contract, sha256(string_agg(c, chr(31) ORDER BY c)) AS shape FROM (SELECT DISTINCT l_orderkey, concat(l_returnflag, l_linestatus, CAST(l_partkey AS VARCHAR)) AS c FROM lineitem) q GROUP BY l_orderkey")
def contract_shapes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("contract"), F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")).alias("condition"))
    return contracts.shape_hash(c)


@query("contract_drift", prelude("nodes") + ", c AS (SELECT o_orderkey AS contract, CASE WHEN o_orderkey % 5 > 0 THEN concat('P:', o_orderkey % 2500) END AS symbol, CASE WHEN o_orderkey % 3 = 0 THEN 'function' ELSE 'method' END AS kind, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS baseline, 'F' AS shape FROM orders) SELECT contract, CASE WHEN symbol IS NULL THEN 'Unbound' WHEN n.kind IS NULL THEN 'SymbolMissing' WHEN n.kind <> c.kind THEN 'KindMismatch' WHEN baseline IS NULL THEN 'NoBaseline' WHEN baseline = shape THEN 'Aligned' ELSE 'ShapeDrift' END AS verdict FROM c LEFT JOIN nodes n ON n.id = c.symbol")
def contract_drift(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(
        k.alias("contract"), F.when(k % 5 > 0, F.concat(F.lit("P:"), (k % 2500).cast("string"))).alias("symbol"), F.when(k % 3 == 0, "function").otherwise("method").alias("kind"),
        F.when(k % 4 > 0, F.col("o_orderstatus")).alias("baseline"), F.lit("F").alias("shape"),
    )
    return contracts.drift(c, view(spark, d, "nodes"))
