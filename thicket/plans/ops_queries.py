"""Queries of operations: calls, files, chunks, mail, memory, gateway."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import sqlgate
from thicket.operators import ops
from thicket.plans.registry import query
from thicket.plans.views import prelude, view
from thicket.session import table

WITH = prelude("calls")
ROLL = "SELECT tool, project_code, status, date_trunc('hour', ts) AS bucket_hour, count(*) AS call_count, sum(latency_ms) AS latency_sum_ms, max(latency_ms) AS latency_max_ms FROM calls GROUP BY 1, 2, 3, 4"
NEWEST = "SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_seen_ms DESC NULLS LAST, status DESC NULLS LAST) AS k FROM indexed_files) q WHERE k = 1"


def files(spark: SparkSession, d: str) -> DataFrame:
    return ops.newest(table(spark, d, "indexed_files"), ["path"], "last_seen_ms", "status")


@query("hourly_rollup", WITH + f"SELECT * REPLACE (round(latency_sum_ms, 4) AS latency_sum_ms) FROM ({ROLL}) q")
def hourly_rollup(spark: SparkSession, d: str) -> DataFrame:
    return ops.hourly_rollup(view(spark, d, "calls")).withColumn("latency_sum_ms", F.round("latency_sum_ms", 4))


@query("telemetry_report", WITH + f"SELECT tool, sum(call_count)::BIGINT AS calls, sum(CASE WHEN status = 'error' THEN call_count ELSE 0 END)::BIGINT AS errors, round(sum(latency_sum_ms) / sum(call_count), 1) AS avg_ms, max(latency_max_ms) AS max_ms FROM ({ROLL}) r GROUP BY tool")
def telemetry_report(spark: SparkSession, d: str) -> DataFrame:
    return ops.telemetry_report(ops.hourly_rollup(view(spark, d, "calls")))


@query("latency_percentiles", WITH + "SELECT tool, min(CASE WHEN k >= ceil(n * 50 / 100.0) THEN latency_ms END) AS p50, min(CASE WHEN k >= ceil(n * 95 / 100.0) THEN latency_ms END) AS p95 FROM (SELECT tool, latency_ms, row_number() OVER (PARTITION BY tool ORDER BY latency_ms) AS k, count(*) OVER (PARTITION BY tool) AS n FROM calls) q GROUP BY tool")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return ops.nearest_rank_latency(view(spark, d, "calls"), ["tool"], [50, 95])


@query("ewma_alerts", prelude("calls", recursive=True) + ", s AS (SELECT project_code, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*)::DOUBLE AS score, row_number() OVER (PARTITION BY project_code ORDER BY date_trunc('day', ts)) AS k FROM calls WHERE status = 'error' GROUP BY 1, 2, date_trunc('day', ts)), r(project_code, day, score, k, ewma, alert) AS (SELECT project_code, day, score, k, score, false FROM s WHERE k = 1 UNION ALL SELECT s.project_code, s.day, s.score, s.k, 0.3 * s.score + 0.7 * r.ewma, s.score > 0 AND s.score > 1.5 * r.ewma FROM r JOIN s ON s.project_code = r.project_code AND s.k = r.k + 1) SELECT project_code, day, score, round(ewma, 6) AS ewma, alert FROM r")
def ewma_alerts(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "calls").where("status = 'error'").groupBy("project_code", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("score"))
    return ops.ewma(s, "project_code", "day", "score").withColumn("ewma", F.round("ewma", 6))


@query("last_minute_rate", WITH + "SELECT count(*) AS events, count(*) / 3600.0::DOUBLE AS per_second FROM calls WHERE ts > (SELECT max(ts) FROM calls) - INTERVAL 3600 SECOND")
def last_minute_rate(spark: SparkSession, d: str) -> DataFrame:
    return ops.sessions_rate(view(spark, d, "calls"), 3600)


@query("recall_scores", "SELECT vec_id AS id, round(greatest(0.0, 1 - (vec_id % 100) / 100.0::DOUBLE) * (0.5 + 0.5 * (label / 10.0::DOUBLE)) * CASE WHEN label = 9 THEN 1.0 ELSE pow(1 + 19 / 81.0::DOUBLE * (vec_id % 60) / 10.0::DOUBLE, -0.5) END, 9) AS score FROM embeddings")
def recall_scores(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    s = ops.recall_score((F.col("vec_id") % 100) / 100, F.col("label") / 10, F.col("vec_id") % 60, F.lit(10.0), F.col("label") == 9)
    return v.select(F.col("vec_id").alias("id"), F.round(s, 9).alias("score"))


@query("newest_files", NEWEST)
def newest_files(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d)


@query("files_by_status", f"SELECT project_code, status, count(*) AS files, sum(coalesce(size_bytes, 0))::BIGINT AS bytes FROM ({NEWEST}) f GROUP BY 1, 2")
def files_by_status(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy("project_code", "status").agg(F.count("*").alias("files"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"))


@query("exclusion_reasons", f"SELECT coalesce(nullif(skip_reason, ''), 'none') AS reason, count(*) AS files FROM ({NEWEST}) f GROUP BY 1")
def exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy(F.coalesce(F.nullif("skip_reason", F.lit("")), F.lit("none")).alias("reason")).agg(F.count("*").alias("files"))


@query("project_telemetry", f"WITH c AS (SELECT id, max(project_code) AS project_code, max(CASE WHEN embed_status = 'embedded' THEN 1 ELSE 0 END) AS done FROM chunks WHERE id IS NOT NULL GROUP BY id), f AS (SELECT project_code, count(*) AS files FROM ({NEWEST}) x GROUP BY 1), g AS (SELECT project_code, count(*) AS chunks, sum(done)::BIGINT AS embedded FROM c GROUP BY 1) SELECT p.code AS project_code, coalesce(f.files, 0) AS files, coalesce(g.chunks, 0) AS chunks, coalesce(g.embedded, 0) AS embedded, coalesce(least(100, round(100.0 * g.embedded / g.chunks, 2)), 0)::DOUBLE AS coverage_pct FROM projects p LEFT JOIN f ON f.project_code = p.code LEFT JOIN g ON g.project_code = p.code")
def project_telemetry(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("id is not null").groupBy("id").agg(F.max("project_code").alias("project_code"), F.max(F.when(F.col("embed_status") == "embedded", 1).otherwise(0)).alias("done"))
    g = c.groupBy("project_code").agg(F.count("*").alias("chunks"), F.sum("done").alias("embedded"))
    f = files(spark, d).groupBy("project_code").agg(F.count("*").alias("files"))
    p = table(spark, d, "projects").select(F.col("code").alias("project_code")).join(f, "project_code", "left").join(g, "project_code", "left")
    return p.select("project_code", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("files", "chunks", "embedded")], F.coalesce(F.least(F.lit(100.0), F.round(100 * F.col("embedded") / F.col("chunks"), 2)), F.lit(0.0)).alias("coverage_pct"))


@query("orphan_embeddings", "SELECT DISTINCT chunk_id, model_id FROM bulk_chunk_embedding_stage WHERE chunk_id NOT IN (SELECT id FROM chunks WHERE id IS NOT NULL)")
def orphan_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bulk_chunk_embedding_stage").select("chunk_id", "model_id").distinct().join(table(spark, d, "chunks").select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")


@query("embed_queue", "SELECT id, coalesce(nullif(max(token_count), 0), ceil(max(length(content)) / 3.0)::INT) AS tokens FROM chunks WHERE id IS NOT NULL AND embed_status = 'pending' AND embed_attempts < 3 GROUP BY id")
def embed_queue(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("id is not null and embed_status = 'pending' and embed_attempts < 3")
    return c.groupBy("id").agg(F.coalesce(F.nullif(F.max("token_count"), F.lit(0)), F.ceil(F.max(F.length("content")) / 3).cast("int")).alias("tokens"))


@query("call_graph_coverage", "WITH s AS (SELECT id, any_value(project_code) AS project_code, any_value(kind) AS kind FROM symbols GROUP BY id), f AS (SELECT project_code, regexp_extract(id, '\\.([a-z]+)::', 1) AS language, count(*) AS functions FROM s WHERE kind IN ('function', 'method') GROUP BY 1, 2), c AS (SELECT project_code, regexp_extract(file_path, '\\.([a-z]+)$', 1) AS language, count(DISTINCT source_id) AS callers FROM chunks WHERE content LIKE '%(%' AND file_path IS NOT NULL GROUP BY 1, 2) SELECT coalesce(f.project_code, c.project_code) AS project_code, coalesce(f.language, c.language) AS language, coalesce(functions, 0) AS functions, coalesce(callers, 0) AS callers FROM f FULL JOIN c ON f.project_code = c.project_code AND f.language = c.language")
def call_graph_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").groupBy("id").agg(F.first("project_code").alias("project_code"), F.first("kind").alias("kind"))
    f = s.where("kind in ('function', 'method')").groupBy("project_code", F.regexp_extract("id", r"\.([a-z]+)::", 1).alias("language")).agg(F.count("*").alias("functions"))
    c = table(spark, d, "chunks").where("content like '%(%' and file_path is not null").groupBy("project_code", F.regexp_extract("file_path", r"\.([a-z]+)$", 1).alias("language")).agg(F.countDistinct("source_id").alias("callers"))
    return f.join(c, ["project_code", "language"], "full").na.fill(0, ["functions", "callers"])


@query("unread_mail", "WITH m AS (SELECT doc_id AS message_id, project_code AS recipient, doc_id % 3 AS priority_rank FROM documents WHERE source = 'mailbox'), c AS (SELECT code AS recipient, (enrolled_at_ms % 500) AS cursor FROM projects) SELECT m.recipient, count(*) AS unread, min(priority_rank) AS top_priority FROM m LEFT JOIN c ON c.recipient = m.recipient WHERE message_id > coalesce(cursor, -1) GROUP BY m.recipient")
def unread_mail(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").where("source = 'mailbox'").select(F.col("doc_id").alias("message_id"), F.col("project_code").alias("recipient"), (F.col("doc_id") % 3).alias("priority_rank"))
    c = table(spark, d, "projects").select(F.col("code").alias("recipient"), (F.col("enrolled_at_ms") % 500).alias("cursor"))
    return ops.unread(m, c)


@query("sql_shapes", "SELECT substr(sha256(lower(trim(regexp_replace(regexp_replace(regexp_replace(p_name || ' = ''' || p_brand || ''' AND size > ' || p_size, '''(?:[^'']|'''')*''', '?', 'g'), '(^|[^A-Za-z0-9_])\\d+(?:\\.\\d+)?', '\\1?', 'g'), '\\s+', ' ', 'g')))), 1, 16) AS shape, count(*) AS n FROM part GROUP BY 1")
def sql_shapes(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" = '"), "p_brand", F.lit("' AND size > "), F.col("p_size").cast("string"))
    return table(spark, d, "part").groupBy(sqlgate.shape_hash(text).alias("shape")).agg(F.count("*").alias("n"))


@query("gateway_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def gateway_rollup(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return sqlgate.run(spark, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_quantity >= :least GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", {"least": 0})


@query("truth_check", "SELECT 'orders' AS \"table\", count(*) AS first, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS second, abs(count(*) - (SELECT count(DISTINCT l_orderkey) FROM lineitem)) AS delta, count(*) <> (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS drifted FROM orders")
def truth_check(spark: SparkSession, d: str) -> DataFrame:
    return ops.truth_check({"orders": table(spark, d, "orders")}, {"orders": table(spark, d, "lineitem").select("l_orderkey").distinct()})
