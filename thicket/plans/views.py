"""Views of the given tables in the terms of the operators: code graph, intent graph, chunks, telemetry, mail.

The texts run on Spark and on any other SQL engine; the whole tables take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thicket.session import table

NODES = """
SELECT concat('P:', p_partkey) AS id,
  CASE WHEN p_partkey % 197 = 0 THEN 'unwrap' WHEN p_partkey % 193 = 0 THEN 'eval' WHEN p_partkey % 89 = 0 THEN concat('todo_', p_partkey) WHEN p_partkey % 83 = 0 THEN 'println!' ELSE concat('fn_', p_partkey) END AS name,
  p_brand AS project_code, CASE p_size % 6 WHEN 0 THEN 'method' WHEN 1 THEN 'class' WHEN 2 THEN 'interface' WHEN 3 THEN 'struct' ELSE 'function' END AS kind,
  p_size % 5 = 0 AS tested, p_size % 2 = 0 AS is_public, p_partkey % 97 = 0 AS is_nif, p_partkey % 53 = 0 AS is_unsafe, p_partkey % 211 = 0 AS is_entry_point, p_size AS complexity
FROM part
UNION ALL
SELECT concat('F:', s_suppkey), concat(CASE s_suppkey % 4 WHEN 0 THEN 'src/domain/' WHEN 1 THEN 'src/infra/' WHEN 2 THEN 'tests/' ELSE 'src/app/' END, 'f', s_suppkey, '.rs'),
  'FILES', 'file', false, false, false, false, false, CAST(NULL AS INT) FROM supplier
"""
EDGES = """
SELECT DISTINCT concat('P:', l_partkey) AS source, concat('P:', nxt) AS target,
  CASE (l_partkey * 7 + nxt) % 20 WHEN 0 THEN 'IMPORTS' WHEN 1 THEN 'USES' WHEN 2 THEN 'IMPLEMENTS' WHEN 3 THEN 'CALLS_NIF' WHEN 4 THEN 'READS' ELSE 'CALLS' END AS rel
FROM (SELECT l_partkey, l_shipdate, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt,
        lead(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nd FROM lineitem) w
WHERE nxt IS NOT NULL AND nd >= l_shipdate AND nd <= l_shipdate + INTERVAL 365 DAY
UNION ALL
SELECT concat('F:', min(l_suppkey)), concat('P:', l_partkey), 'CONTAINS' FROM lineitem GROUP BY l_partkey
"""
#: Hierarchy region - nation - customer - order.
TREE = """
SELECT concat('R:', n_regionkey) AS source, concat('N:', n_nationkey) AS target, 'CONTAINS' AS rel FROM nation
UNION ALL SELECT concat('N:', c_nationkey), concat('C:', c_custkey), 'CONTAINS' FROM customer
UNION ALL SELECT concat('C:', o_custkey), concat('O:', o_orderkey), 'CONTAINS' FROM orders
"""
#: Intent graph: requirements are orders, pillars nations, decisions suppliers, validations parts, milestones order months.
INTENT_NODES = """
SELECT concat('REQ-', o_orderkey) AS id, 'Requirement' AS type, o_orderpriority AS priority, concat('order of customer ', o_custkey) AS title,
  CASE o_orderstatus WHEN 'F' THEN 'current' WHEN 'P' THEN 'accepted' ELSE 'planned' END AS status, CASE WHEN o_totalprice > 150000 THEN 'has acceptance criteria' END AS criteria, o_orderdate AS created_at FROM orders
UNION ALL SELECT concat('PIL-', n_nationkey), 'Pillar', NULL, n_name, 'current', NULL, NULL FROM nation
UNION ALL SELECT concat('VIS-', r_regionkey), 'Vision', NULL, r_name, 'current', NULL, NULL FROM region
UNION ALL SELECT concat('DEC-', s_suppkey), 'Decision', NULL, s_name, CASE WHEN s_acctbal < 0 THEN 'superseded' ELSE 'accepted' END, NULL, NULL FROM supplier
UNION ALL SELECT concat('VAL-', p_partkey), 'Validation', NULL, p_name, 'accepted', NULL, NULL FROM part
UNION ALL SELECT DISTINCT concat('MIL-', CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT)), 'Milestone', NULL, 'month', 'planned', NULL, CAST(NULL AS TIMESTAMP) FROM orders
"""
INTENT_EDGES = """
SELECT concat('PIL-', n_nationkey) AS source, concat('VIS-', n_regionkey) AS target, 'EPITOMIZES' AS rel FROM nation
UNION ALL SELECT concat('REQ-', o_orderkey), concat('PIL-', c_nationkey), 'BELONGS_TO' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> '5-LOW'
UNION ALL SELECT DISTINCT concat('DEC-', l_suppkey), concat('REQ-', l_orderkey), 'SOLVES' FROM lineitem WHERE l_linenumber = 1
UNION ALL SELECT DISTINCT concat('VAL-', l_partkey), concat('REQ-', l_orderkey), 'VERIFIES' FROM lineitem WHERE l_linenumber = 2
UNION ALL SELECT concat('MIL-', CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT)), concat('REQ-', o_orderkey), 'TARGETS' FROM orders WHERE o_orderstatus = 'O'
"""
#: Evidence: the lines of an order.
TRACES = """
SELECT concat('T-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS id, concat('REQ-', l_orderkey) AS entity, CASE WHEN l_linestatus = 'F' THEN 'Symbol' ELSE 'File' END AS artifact_type,
  concat('P:', l_partkey) AS artifact_ref, CASE l_returnflag WHEN 'R' THEN 'broken' ELSE 'ok' END AS artifact_status FROM lineitem WHERE l_linenumber >= 3
"""
#: Newest row of each chunk; of each symbol one row.
CHUNKS = """
SELECT id, max(source_id) AS source_id, max(project_code) AS project_code, max(file_path) AS file_path, max(kind) AS kind, max(content) AS content FROM chunks WHERE id IS NOT NULL GROUP BY id
"""
CALLS = """
SELECT concat('call-', event_id) AS id, event_type AS tool, concat('U', user_id % 7) AS project_code, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, ts, value AS latency_ms, user_id, event_id FROM events
"""
TEXTS = {
    "nodes": NODES, "edges": EDGES, "tree": TREE, "intent_nodes": INTENT_NODES, "intent_edges": INTENT_EDGES, "traces": TRACES, "chunk_view": CHUNKS, "calls": CALLS,
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings symbols chunks indexed_files projects".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name over the tables of a folder."""
    text = TEXTS[name]
    args = {}
    for t in TABLES:
        marker = "{" + t + "}"
        changed = _replace(text, t, marker)
        if changed != text:
            text, args[t] = changed, table(spark, sf_dir, t)
    return spark.sql(text, **args)


def _replace(text: str, name: str, marker: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {marker}", text)


def prelude(*names: str, recursive: bool = False) -> str:
    """The WITH clause that defines views for a query text."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({TEXTS[n]})" for n in names) + " "
