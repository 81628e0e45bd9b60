"""Queries of plain joins, aggregates, windows and set operations, also as the gateway runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import scalars, sqlgate
from thicket.operators import relational, retrieval
from thicket.plans.registry import query
from thicket.plans.views import prelude, view
from thicket.session import table


@query("first_chunk_of_symbol", "SELECT source_id, id AS chunk_id, file_path FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(chunk_part_index, 1), file_path NULLS LAST, id, created_at_ms NULLS LAST) AS k FROM chunks WHERE source_id IS NOT NULL AND id IS NOT NULL) q WHERE k = 1")
def first_chunk_of_symbol(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("source_id is not null and id is not null")
    order = [F.coalesce("chunk_part_index", F.lit(1)), F.col("file_path").asc_nulls_last(), F.col("id"), F.col("created_at_ms").asc_nulls_last()]
    return relational.first_by(c.select("source_id", "id", "file_path", "chunk_part_index", "created_at_ms"), ["source_id"], order).select("source_id", F.col("id").alias("chunk_id"), "file_path")


@query("price_as_of", "WITH p AS (SELECT l_partkey AS k, l_shipdate AS since, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2), o AS (SELECT l_orderkey, l_linenumber, l_partkey AS k, l_suppkey, l_quantity, l_extendedprice, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1) SELECT l_orderkey, o.k AS partkey, o_orderdate, price FROM o ASOF LEFT JOIN p ON o.k = p.k AND o.o_orderdate >= p.since")
def price_as_of(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    o = line.where("l_linenumber = 1").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", F.col("l_partkey").alias("partkey"), "o_orderdate")
    p = line.select(F.col("l_partkey").alias("partkey"), F.col("l_shipdate").alias("since"), F.col("l_extendedprice").alias("price"))
    return relational.as_of(o, p, "partkey", "o_orderdate", "since", "price")


@query("practice_fusion", "WITH v AS (SELECT vec_id AS id, label, vec_id % 3 AS role, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.id AS a, b.id AS b, round(1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS distance FROM v a JOIN v b ON a.label = b.label AND a.role = b.role AND a.id < b.id WHERE 1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) < 0.6")
def practice_fusion(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % 3).alias("role"), "embedding")
    return relational.close_pairs(v, ["label", "role"], 0.6).withColumn("distance", F.round("distance", 6))


@query("dashboard_json", "SELECT status, '[' || string_agg('{\"code\":\"' || code || '\",\"enrolled_at_ms\":' || enrolled_at_ms || '}', ',' ORDER BY code) || ']' AS rows FROM projects GROUP BY status")
def dashboard_json(spark: SparkSession, d: str) -> DataFrame:
    return relational.json_rows(table(spark, d, "projects"), "status", ["code", "enrolled_at_ms"], "code")


@query("json_array_total", "SELECT sum(CAST(json_extract(props, '$.k') AS BIGINT) + 1)::BIGINT AS total, (count(*) * 2)::BIGINT AS elements FROM events WHERE props IS NOT NULL")
def json_array_total(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("props is not null").select(F.concat(F.lit("["), "props", F.lit(', {"k": 1}]')).alias("j"))
    return relational.json_sum(e, "j", "array<struct<k: bigint>>", "k")


@query("json_event_fields", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def json_event_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").groupBy("event_type", (k % 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("map_counts", "SELECT tool, ok, error FROM (SELECT concat('U', user_id % 7) AS tool, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END)::BIGINT AS ok, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS error FROM events GROUP BY 1) q")
def map_counts(spark: SparkSession, d: str) -> DataFrame:
    per = view(spark, d, "calls").groupBy(F.col("project_code").alias("tool"), "status").agg(F.count("*").alias("n"))
    m = per.groupBy("tool").agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("m"))
    count = lambda s: F.coalesce(F.try_element_at("m", F.lit(s)), F.lit(0)).alias(s)
    return m.select("tool", count("ok"), count("error"))


@query("geometric_health", "SELECT n_regionkey, CASE WHEN min(v) <= 0 THEN 0.0::DOUBLE ELSE round(exp(sum(w * ln(greatest(v, 1e-300))) / sum(w)), 9) END AS mean FROM (SELECT n_regionkey, c_custkey % 4 AS w, CASE WHEN c_custkey % 997 = 996 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE + c_custkey % 10 END AS v FROM customer JOIN nation ON n_nationkey = c_nationkey) q WHERE w > 0 GROUP BY n_regionkey")
def geometric_health(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    v = F.when(F.col("c_custkey") % 997 == 996, 0.0).otherwise(1.0 + F.col("c_custkey") % 10)
    return relational.weighted_geometric_mean(c.select("n_regionkey", (F.col("c_custkey") % 4).alias("w"), v.alias("v")), ["n_regionkey"], "v", "w").withColumn("mean", F.round("mean", 9))


RUBRIC = [("quota", 2.0), ("snapshot", 1.0), ("registr(y|ies)", 1.0)]


@query("rubric_scores", "SELECT doc_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN regexp_matches(lower(text), 'quota') THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'snapshot') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'registr(y|ies)') THEN 1.0::DOUBLE ELSE 0 END) / 4.0::DOUBLE - CASE WHEN regexp_matches(lower(text), 'todo') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)) AS score FROM documents")
def rubric_scores(spark: SparkSession, d: str) -> DataFrame:
    return relational.rubric(table(spark, d, "documents"), "doc_id", "text", RUBRIC, ["todo"])


@query("snapshot_differences", "WITH s AS (SELECT event_type AS k, date_trunc('day', ts) AS day, count(*)::DOUBLE AS calls, count(DISTINCT user_id)::DOUBLE AS users FROM events GROUP BY 1, 2), r AS (SELECT *, lead(calls) OVER w AS c0, lead(users) OVER w AS u0, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY k ORDER BY day DESC)) SELECT k AS event_type, 'calls' AS counter, c0 AS before, calls AS after, calls - c0 AS change FROM r WHERE n = 1 AND c0 IS NOT NULL UNION ALL SELECT k, 'users', u0, users, users - u0 FROM r WHERE n = 1 AND u0 IS NOT NULL")
def snapshot_differences(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"))
    return relational.snapshot_changes(s, "event_type", "day", ["calls", "users"])


@query("requirements_page", prelude("intent_nodes") + "SELECT id, title, (SELECT count(*) > 60 FROM intent_nodes WHERE type = 'Requirement') AS has_more FROM intent_nodes WHERE type = 'Requirement' ORDER BY id LIMIT 20 OFFSET 40")
def requirements_page(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "intent_nodes").where("type = 'Requirement'").select("id", "title")
    return relational.page(n, [F.col("id")], 40, 20)


def _gateway(spark: SparkSession, d: str, text: str, tables: str, args: dict | list | None = None) -> DataFrame:
    for t in tables.split():
        table(spark, d, t).createOrReplaceTempView(t)
    return sqlgate.run(spark, text, args)


RANGE = "SELECT c_custkey, count(*) AS cheaper FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal >= c_acctbal - 500 AND s_acctbal < c_acctbal GROUP BY c_custkey"
FRAMES = "SELECT o_orderkey, rank() OVER w AS place, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS quarter, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)"
SETS = "(SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F') EXCEPT SELECT p_partkey FROM part WHERE p_size > 40"


@query("gateway_range_join", RANGE)
def gateway_range_join(spark: SparkSession, d: str) -> DataFrame:
    return _gateway(spark, d, RANGE, "customer supplier")


@query("gateway_frames", FRAMES)
def gateway_frames(spark: SparkSession, d: str) -> DataFrame:
    return _gateway(spark, d, FRAMES, "orders")


@query("gateway_sets", SETS)
def gateway_sets(spark: SparkSession, d: str) -> DataFrame:
    return _gateway(spark, d, "SELECT k FROM (" + SETS + ") q", "lineitem part")


@query("gateway_parameters", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 150000 AND o_orderpriority = '1-URGENT' GROUP BY 1")
def gateway_parameters(spark: SparkSession, d: str) -> DataFrame:
    return _gateway(spark, d, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > $least AND o_orderpriority = $priority GROUP BY 1", "orders", {"least": 150000, "priority": "1-URGENT"})


@query("scoped_edges", prelude("nodes", "edges") + "SELECT e.source, e.target, e.rel FROM edges e JOIN nodes n ON n.id = e.source WHERE n.project_code = 'Brand#2'")
def scoped_edges(spark: SparkSession, d: str) -> DataFrame:
    n, e = view(spark, d, "nodes"), view(spark, d, "edges")
    return scalars.in_scope(e.join(n.select(F.col("id").alias("source"), "project_code"), "source"), "Brand#2").select("source", "target", "rel")


@query("lane_precision", "WITH e AS (SELECT vec_id AS id, label AS query FROM embeddings WHERE vec_id % 7 = 0), f AS (SELECT label AS query, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id % 11, vec_id) AS rank FROM embeddings), t AS (SELECT * FROM f WHERE rank <= 10), g AS (SELECT query, count(*) AS n FROM t GROUP BY query), h AS (SELECT t.query, count(*) AS hit FROM t JOIN e ON e.query = t.query AND e.id = t.id GROUP BY t.query), q AS (SELECT query, count(DISTINCT id) AS n FROM e GROUP BY query) SELECT q.query, coalesce(hit, 0) / g.n::DOUBLE AS precision, coalesce(hit, 0) / q.n::DOUBLE AS recall FROM q LEFT JOIN g ON g.query = q.query LEFT JOIN h ON h.query = q.query")
def lane_precision(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    v = table(spark, d, "embeddings").select(F.col("label").alias("query"), F.col("vec_id").alias("id"))
    found = v.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("id") % 11, "id")))
    return retrieval.precision_recall(v.where("id % 7 = 0"), found, 10)
