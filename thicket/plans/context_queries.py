"""Queries of retrieval contexts: full-text ranks, hybrid candidates, orders and bands, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import fts, tables
from thicket.operators import context, retrieval
from thicket.plans.registry import query
from thicket.plans.views import prelude, view
from thicket.session import table

STEM = "CASE WHEN length(w) <= 3 THEN w ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, 'sses$', 'ss'), 'ies$', 'i'), '([^s])s$', '\\1'), '(..)(?:ing|ed|ly)$', '\\1'), '(...)(?:ation|ator|ations)$', '\\1at'), 'y$', 'i') END"
SPLIT = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9_]+'), lambda x: x <> '')"


def _vector_sql(key: str, source: str, fields: list[tuple[str, float]], stem: bool) -> str:
    parts = " || ".join(f"list_transform({SPLIT.format(c)}, lambda x: {{'w': x, 'g': {g}::DOUBLE}})" for c, g in fields)
    return f"x AS (SELECT {key} AS id, unnest({parts}) AS y, generate_subscripts({parts}, 1) AS position FROM {source}), v AS (SELECT id, {STEM if stem else 'w'} AS lexeme, position, g AS weight FROM (SELECT id, position, y.w AS w, y.g AS g FROM x) z)"


RANK = ", r AS (SELECT *, row_number() OVER (PARTITION BY id, lexeme ORDER BY position) AS j FROM v WHERE lexeme IN ({0})), m AS (SELECT id, lexeme, sum(weight / (j * j)) AS s, max(weight) AS wm FROM r GROUP BY 1, 2), f AS (SELECT m.id, m.lexeme, m.s, m.wm, min(r.j) AS j FROM m JOIN r ON r.id = m.id AND r.lexeme = m.lexeme AND r.weight = m.wm GROUP BY 1, 2, 3, 4) "
FIELDS = {"source": "A", "text": "B"}


@query("fts_rank", "WITH " + _vector_sql("doc_id", "documents", [("source", 1.0), ("text", 0.4)], True) + RANK.format("'quota', 'snapshot'") + "SELECT id, round(sum((wm + s - wm / (j * j)) / 1.64493406685) / 2, 9) AS score FROM f GROUP BY id")
def fts_rank(spark: SparkSession, d: str) -> DataFrame:
    terms = fts.query_terms(spark, "quotas snapshots")
    v = fts.vectors(table(spark, d, "documents"), "doc_id", FIELDS, only=terms)
    return fts.rank(v, terms).withColumn("score", F.round("score", 9))


@query("fts_cover_rank", "WITH " + _vector_sql("doc_id", "documents", [("source", 1.0), ("text", 0.4)], True) + ", h AS (SELECT *, lag(lexeme) OVER w AS before, lag(position) OVER w AS p0, lag(weight) OVER w AS w0 FROM v WHERE lexeme IN ('quota', 'snapshot') WINDOW w AS (PARTITION BY id ORDER BY position, lexeme)) SELECT id, round(sum(2 / (1 / weight + 1 / w0) / (1 + greatest(0, position - p0 - 1))), 9) AS score FROM h WHERE before <> lexeme GROUP BY id")
def fts_cover_rank(spark: SparkSession, d: str) -> DataFrame:
    terms = fts.query_terms(spark, "quota snapshot")
    v = fts.vectors(table(spark, d, "documents"), "doc_id", FIELDS, only=terms)
    return fts.cover_rank(v, terms).withColumn("score", F.round("score", 9))


@query("intent_fts", prelude("intent_nodes") + ", " + _vector_sql("id", "intent_nodes", [("title", 1.0)], False) + RANK.format("'ring', 'small'") + "SELECT id, round(sum((wm + s - wm / (j * j)) / 1.64493406685) / 2, 9) AS score FROM f GROUP BY id ORDER BY score DESC, id DESC LIMIT 50")
def intent_fts(spark: SparkSession, d: str) -> DataFrame:
    terms = fts.query_terms(spark, "small ring", "simple")
    v = fts.vectors(view(spark, d, "intent_nodes"), "id", {"title": "A"}, "simple", terms)
    return fts.rank(v, terms).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), F.desc("id")).limit(50)


def _query_vector(spark: SparkSession, d: str, key: int = 0) -> list[float]:
    return table(spark, d, "embeddings").where(F.col("vec_id") == key).select("embedding").first()[0]


DIST = "1 - list_dot_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt((SELECT list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) FROM embeddings WHERE vec_id = 0)))"


@query("intent_trimodal", prelude("intent_nodes", "intent_edges") + f", a AS (SELECT concat('VAL-', vec_id) AS id, row_number() OVER (ORDER BY d, vec_id) AS rank FROM (SELECT vec_id, {DIST} AS d FROM embeddings ORDER BY d, vec_id LIMIT 50) q), " + _vector_sql("id", "intent_nodes", [("title", 1.0)], False) + RANK.format("'ring', 'small'") + ", t0 AS (SELECT id, round(sum((wm + s - wm / (j * j)) / 1.64493406685) / 2, 9) AS score FROM f GROUP BY id ORDER BY score DESC, id DESC LIMIT 50), t AS (SELECT id, row_number() OVER (ORDER BY score DESC, id DESC) AS rank FROM t0), s AS (SELECT id FROM a UNION SELECT id FROM t), g AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM (SELECT target AS id FROM intent_edges WHERE source IN (SELECT id FROM s) UNION SELECT source FROM intent_edges WHERE target IN (SELECT id FROM s)) n) SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM t UNION ALL SELECT * FROM g) u GROUP BY id ORDER BY score DESC, id LIMIT 20")
def intent_trimodal(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    near = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), context.cosine_distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in _query_vector(spark, d)])).alias("distance")).orderBy("distance", "id").limit(50)
    a = near.select(F.concat(F.lit("VAL-"), "id").alias("id"), F.row_number().over(Window.orderBy("distance", near["id"])).alias("rank"))
    t = intent_fts(spark, d).select("id", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("id"))).alias("rank"))
    return retrieval.trimodal(a, t, view(spark, d, "intent_edges"), 20).withColumn("score", F.round("score", 9))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("id is not null")
    return c.groupBy("id").agg(*[F.max(x).alias(x) for x in ("source_id", "file_path", "kind", "chunk_path", "content", "content_hash")])


CHUNK = "c AS (SELECT id, max(source_id) AS source_id, max(file_path) AS file_path, max(kind) AS kind, max(chunk_path) AS chunk_path, max(content) AS content, max(content_hash) AS content_hash FROM chunks WHERE id IS NOT NULL GROUP BY id)"
#: Embeddings of chunks for one model, the newest of each; the query is the vector of the first chunk by id that has one.
STAGE = "s AS (SELECT chunk_id, source_hash, embedding FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY embedded_at_ms DESC NULLS LAST, source_hash DESC NULLS LAST) AS k FROM bulk_chunk_embedding_stage WHERE model_id = (SELECT min(model_id) FROM bulk_chunk_embedding_stage) AND embedding IS NOT NULL AND len(embedding) = 64) q WHERE k = 1), qv AS (SELECT embedding AS e FROM s WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AND isfinite(list_sum(embedding::DOUBLE[])) ORDER BY chunk_id LIMIT 1)"
SDIST = "1 - list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])))"
FIN = "list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AND isfinite(list_sum(embedding::DOUBLE[]))"
HYBRID = f"WITH {CHUNK}, {STAGE}, n AS (SELECT chunk_id, source_hash, {SDIST} AS d FROM s, qv WHERE {FIN} ORDER BY d, chunk_id LIMIT 200), m AS (SELECT c.*, n.d FROM c LEFT JOIN n ON n.chunk_id = c.id AND n.source_hash = c.content_hash AND n.d < 0.55), h AS (SELECT *, coalesce(lower(content) LIKE '%quota%' OR lower(content) LIKE '%beacon%', false) AS lexical, coalesce(lower(file_path) LIKE '%distance%', false) AS onpath FROM m), r AS (SELECT *, CASE WHEN onpath THEN 2 WHEN lexical AND d IS NOT NULL THEN 3 WHEN d IS NOT NULL THEN 4 ELSE 5 END AS k FROM h WHERE d IS NOT NULL OR lexical OR onpath ORDER BY k, d NULLS LAST, id LIMIT 60) "


def _stage(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    from thicket.operators import relational

    s = table(spark, d, "bulk_chunk_embedding_stage").where("embedding is not null and size(embedding) = 64 and chunk_id is not null")
    first = s.agg(F.min("model_id")).first()[0]
    s = relational.first_by(s.where(F.col("model_id") == first), ["chunk_id"], [F.col("embedded_at_ms").desc_nulls_last(), F.col("source_hash").desc_nulls_last()])
    s = s.select("chunk_id", "source_hash", "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    good = s.where(F.exists("embedding", lambda x: x != 0) & (F.abs(total) < float("inf")) & ~F.isnan(total))
    return good, good.orderBy("chunk_id").select("embedding").first()[0]


@query("hybrid_chunks", HYBRID + "SELECT id, source_id, file_path, CASE k WHEN 2 THEN 'file_path' WHEN 3 THEN 'lexical+semantic' WHEN 4 THEN 'semantic' ELSE 'lexical' END AS source, abs(round(d, 6)) AS distance FROM r")
def hybrid_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("id", "source_id", "file_path", "source", F.abs(F.round("distance", 6)).alias("distance"))


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    s, q = _stage(spark, d)
    return context.hybrid_chunks(_chunks(spark, d), s, q, ["quota", "beacon"], path="distance", pool=200, limit=60)


@query("chunk_rerank", HYBRID + "SELECT id, round(CASE WHEN lower(content) LIKE '%quota%' THEN 1.5 ELSE 0 END + CASE WHEN lower(content) LIKE '%beacon%' THEN 1.5 ELSE 0 END + CASE WHEN lower(coalesce(file_path, '')) LIKE '%quota%' THEN 2 ELSE 0 END + CASE WHEN lower(coalesce(file_path, '')) LIKE '%beacon%' THEN 2 ELSE 0 END + coalesce(3 * (1 - d), 0) - CASE WHEN regexp_matches(lower(coalesce(file_path, '')), '(^|/)(tests?|scripts)/|_test\\.|\\.test\\.') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(lower(coalesce(file_path, '')), 'node_modules|vendor/|/dist/|_build') THEN 1 ELSE 0 END, 6) AS score FROM r")
def chunk_rerank(spark: SparkSession, d: str) -> DataFrame:
    return context.rerank_chunks(_hybrid(spark, d), ["quota", "beacon"]).select("id", "score")


@query("chunk_text_matches", f"WITH {CHUNK} SELECT id, CASE rank WHEN 0 THEN 'docstring' WHEN 1 THEN 'body' WHEN 2 THEN 'metadata' ELSE 'file_path' END AS reason, rank FROM (SELECT id, CASE WHEN regexp_matches(lower(coalesce(content, '')), '(?s)(\"\"\"|/\\*\\*|///|@doc).*?relay') THEN 0 WHEN contains(lower(coalesce(content, '')), 'relay') THEN 1 WHEN contains(lower(coalesce(kind, '')), 'relay') OR contains(lower(coalesce(chunk_path, '')), 'relay') THEN 2 WHEN contains(lower(coalesce(file_path, '')), 'relay') THEN 3 END AS rank FROM c) q WHERE rank IS NOT NULL")
def chunk_text_matches(spark: SparkSession, d: str) -> DataFrame:
    return context.text_matches(_chunks(spark, d), "relay")


@query("entry_rerank", "WITH s AS (SELECT id, min(name) AS name FROM symbols GROUP BY id) SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM (SELECT id, round(CASE WHEN lower(coalesce(name, '')) = 'relay_quota' THEN 5.0 ELSE 0 END + CASE WHEN contains(lower(coalesce(name, '')), 'relay') THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(coalesce(name, '')), 'quota') THEN 2.0 ELSE 0 END - CASE WHEN regexp_matches(lower(id), '(^|/)tests?/') THEN 1.0 ELSE 0 END, 6)::DOUBLE AS score FROM s) q ORDER BY place LIMIT 100")
def entry_rerank(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").groupBy("id").agg(F.min("name").alias("name")).select("id", "name", F.col("id").alias("file_path"), F.lit(None).cast("double").alias("distance"))
    return context.rerank_entries(s, ["relay", "quota"], "relay_quota").orderBy("place").limit(100)


@query("symbol_hybrid", prelude("nodes", "edges") + f", a AS (SELECT concat('P:', vec_id % 200) AS id, min(d) AS d FROM (SELECT vec_id, {DIST} AS d FROM embeddings ORDER BY d, concat('P:', vec_id % 200) LIMIT 40) q GROUP BY 1), t AS (SELECT n.id, a.d FROM nodes n LEFT JOIN a ON a.id = n.id WHERE lower(n.name) LIKE '%todo%' OR a.d < 0.5 ORDER BY a.d NULLS LAST, n.name, n.id LIMIT 20), b AS (SELECT DISTINCT y AS id FROM (SELECT source AS x, target AS y FROM edges UNION ALL SELECT target, source FROM edges) e WHERE x IN (SELECT id FROM t) AND y NOT IN (SELECT id FROM t) AND y IN (SELECT id FROM nodes)) SELECT id, abs(round(d, 6)) AS distance, via, row_number() OVER (ORDER BY via, d NULLS LAST, id) AS place FROM (SELECT id, d, 'match' AS via FROM t UNION ALL SELECT id, NULL, 'neighbour' FROM b) u")
def symbol_hybrid(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.concat(F.lit("P:"), F.col("vec_id") % 200).alias("id"), "embedding")
    out = context.symbol_hybrid(view(spark, d, "nodes"), v, view(spark, d, "edges"), "todo", _query_vector(spark, d), pool=40)
    return out.withColumn("distance", F.abs(F.round("distance", 6)))


LAYERS = "i AS (SELECT concat('D-', doc_id) AS id, n_chars::DOUBLE AS score, ceil(n_chars / 3.0)::BIGINT AS tokens FROM documents WHERE source = 'decision_records'), k AS (SELECT id, length(id)::DOUBLE AS score, ceil(max(length(content)) / 3.0)::BIGINT AS tokens FROM chunks WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id), n AS (SELECT concat('D-', doc_id) AS id, epoch_us(created_at)::DOUBLE AS score, ceil(n_chars / 3.0)::BIGINT AS tokens FROM documents WHERE source = 'commit_log')"


@query("layered_context", f"WITH {LAYERS}, b AS (SELECT 'intent' AS band, *, 1200 AS room FROM i UNION ALL SELECT 'code', *, 2000 FROM k UNION ALL SELECT 'recent', *, 800 FROM n), w AS (SELECT *, sum(tokens) OVER (PARTITION BY band ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS upto FROM b WHERE tokens > 0 AND tokens <= room) SELECT band, id, tokens, upto::BIGINT AS upto FROM w WHERE upto <= room")
def layered_context(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").withColumns({"id": F.concat(F.lit("D-"), "doc_id"), "tokens": F.ceil(F.col("n_chars") / 3)})
    c = table(spark, d, "chunks").where("id is not null and content is not null").groupBy("id").agg(F.ceil(F.max(F.length("content")) / 3).alias("tokens"))
    bands = {
        "intent": doc.where("source = 'decision_records'").select("id", F.col("n_chars").cast("double").alias("score"), "tokens"), "code": c.select("id", F.length("id").cast("double").alias("score"), "tokens"),
        "recent": doc.where("source = 'commit_log'").select("id", F.unix_micros(F.col("created_at").cast("timestamp")).cast("double").alias("score"), "tokens"),
    }
    return context.layered(bands, 4000)


@query("contradiction_check")
def contradiction_check(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    s = v.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return context.contradictions(s, "the quota is never rebuilt after the snapshot", _query_vector(spark, d))


@query("ann_controls", "SELECT label, count(*) AS rows, count(*) <= 50 AS exact, 40 AS ef, 30 AS candidates FROM embeddings GROUP BY label")
def ann_controls(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("rows"))
    plan = context.ann_plan(0, 10)
    return sizes.select("label", "rows", (F.col("rows") <= 50).alias("exact"), F.lit(plan["ef"]).alias("ef"), F.lit(plan["candidates"]).alias("candidates"))


def _edges_view(spark: SparkSession, d: str) -> None:
    tables.register(spark, view(spark, d, "edges"))


@query("sql_impact", prelude("edges", recursive=True) + ", walk(id, d) AS (SELECT 'P:10', 0 UNION SELECT e.target, d + 1 FROM walk JOIN edges e ON e.source = walk.id WHERE d < 3), hit AS (SELECT id, min(d) AS d FROM walk GROUP BY id) SELECT d AS distance, count(*) AS n FROM hit WHERE d > 0 GROUP BY d")
def sql_impact(spark: SparkSession, d: str) -> DataFrame:
    _edges_view(spark, d)
    return tables.run(spark, "SELECT distance, count(*) AS n FROM impact('P:10', 3) GROUP BY distance")


@query("sql_callers_join", prelude("edges") + "SELECT e.source AS caller_id, count(DISTINCT o.target) AS also_calls FROM edges e JOIN edges o ON o.source = e.source WHERE e.target = 'P:10' GROUP BY e.source")
def sql_callers_join(spark: SparkSession, d: str) -> DataFrame:
    _edges_view(spark, d)
    return tables.run(spark, "SELECT c.caller_id, count(DISTINCT o.target) AS also_calls FROM callers_of('P:10') c JOIN edges o ON o.source = c.caller_id GROUP BY c.caller_id")
