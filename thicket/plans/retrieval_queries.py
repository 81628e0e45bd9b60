"""Retrieval queries over documents, embeddings and the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import scalars
from thicket.operators import graph, retrieval
from thicket.plans.registry import query
from thicket.plans.views import prelude, view
from thicket.session import table

TERMS = ["registry", "pending"]
INDEX = "idx AS (SELECT id, term, sum(w) AS weight FROM (SELECT doc_id AS id, term, count(*) * 0.4 AS w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+')) AS term FROM documents) a WHERE term <> '' GROUP BY 1, 2 UNION ALL SELECT doc_id, term, count(*) * 1.0 FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(source, '')), '[^a-z0-9_]+')) AS term FROM documents) b WHERE term <> '' GROUP BY 1, 2) u GROUP BY id, term)"
TEXT = "t AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(sum(weight), 6) AS score FROM idx WHERE term IN ('registry', 'pending') GROUP BY id HAVING count(*) = 2 ORDER BY score DESC, id LIMIT 30) q)"
VECTOR = "qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)), v AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS rank FROM (SELECT vec_id AS id, 1 - list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))) AS distance FROM embeddings, qv ORDER BY distance, id LIMIT 30) x)"
GRAPH = "own AS (SELECT vec_id AS id, concat('P:', vec_id % 200) AS node FROM embeddings), z AS (SELECT 'P:10' AS id, 0 AS d UNION ALL SELECT target, 1 FROM edges WHERE source = 'P:10' UNION ALL SELECT y.target, 2 FROM edges x JOIN edges y ON y.source = x.target WHERE x.source = 'P:10'), g AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS rank FROM (SELECT own.id, min(z.d) AS distance FROM own JOIN z ON z.id = own.node GROUP BY own.id ORDER BY distance, own.id LIMIT 30) x)"


def _index(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.inverted_index(table(spark, d, "documents"), "doc_id", {"text": 0.4, "source": 1.0})


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return _vectors(spark, d).orderBy("id").first()["embedding"]


@query("text_lane", f"WITH {INDEX}, {TEXT} SELECT id, round(score, 6) AS score, rank FROM t")
def text_lane(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.text_lane(_index(spark, d), TERMS, 10).withColumn("score", F.round("score", 6))


@query("vector_lane", f"WITH {VECTOR} SELECT id, abs(round(distance, 6)) AS distance, rank FROM v")
def vector_lane(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_lane(_vectors(spark, d), _query_vector(spark, d), 10).withColumn("distance", F.abs(F.round("distance", 6)))


@query("graph_lane", prelude("edges").rstrip() + f", {GRAPH} SELECT id, distance, rank FROM g")
def graph_lane(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.graph_lane(view(spark, d, "edges"), spark.createDataFrame([("P:10",)], "id string"), _owner(spark, d), 10)


def _owner(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("P:"), F.col("vec_id") % 200).alias("node"))


@query("hybrid_rrf", prelude("edges").rstrip() + f", {INDEX}, {TEXT}, {VECTOR}, {GRAPH}, r AS (SELECT id, sum(s) AS score FROM (SELECT id, 1.0::DOUBLE / (60 + rank) AS s FROM t UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank) FROM v UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank) FROM g) q GROUP BY id ORDER BY score DESC, id LIMIT 10) SELECT r.id, round(r.score, 9) AS score, round(coalesce(t.score, 0), 6) AS fts, abs(round(coalesce(v.distance, 1), 6)) AS distance, coalesce(g.distance, 999) AS hops FROM r LEFT JOIN t ON t.id = r.id LEFT JOIN v ON v.id = r.id LEFT JOIN g ON g.id = r.id")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.hybrid(_index(spark, d), _vectors(spark, d), view(spark, d, "edges"), _owner(spark, d), spark.createDataFrame([("P:10",)], "id string"), TERMS, _query_vector(spark, d), 10)
    return out.select("id", F.round("score", 9).alias("score"), F.round("fts", 6).alias("fts"), F.abs(F.round("distance", 6)).alias("distance"), "hops")


@query("semantic_clones", "WITH x AS (SELECT a.vec_id AS a, b.vec_id AS b, 1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM x WHERE d < 0.5) SELECT least(a, b) AS a, greatest(a, b) AS b, round(min(d), 6) AS distance FROM k WHERE r <= 30 GROUP BY 1, 2")
def semantic_clones(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.similar_pairs(_vectors(spark, d), "label", 0.5).withColumn("distance", F.round("distance", 6))


@query("fuzzy_symbols", "SELECT DISTINCT id, name FROM symbols WHERE lower(name) LIKE '%split_b%' OR translate(lower(name), '_-:', '   ') LIKE '%split_b%' OR lower(name) LIKE '%split%b%' OR regexp_replace(lower(name), '[_\\-: ]', '', 'g') LIKE '%splitb%'")
def fuzzy_symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").where(scalars.fuzzy(F.col("name"), "split_b")).select("id", "name").distinct()


@query("symbol_relevance", "SELECT DISTINCT name FROM symbols WHERE lower(name) LIKE '%lease%' ORDER BY lower(name) = 'lease' DESC, lower(name) LIKE 'lease%' DESC, nullif(instr(lower(name), 'lease'), 0) NULLS LAST, length(name), name LIMIT 20")
def symbol_relevance(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "symbols").where(F.lower("name").contains("lease")).select("name").distinct()
    return names.orderBy(*scalars.relevance(F.col("name"), "lease")).limit(20)


@query("symbol_first_chunk", prelude("chunk_view") + "SELECT source_id, min(file_path) AS file_path FROM chunk_view WHERE source_id IS NOT NULL GROUP BY source_id")
def symbol_first_chunk(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "chunk_view").where("source_id is not null").groupBy("source_id").agg(F.min("file_path").alias("file_path"))


@query("debt_terms_in_chunks", prelude("chunk_view") + r"SELECT id, regexp_extract(content, '(?i)\b(todo|fixme|hack)\b', 1) AS word FROM chunk_view WHERE regexp_matches(content, '(?i)\b(todo|fixme|hack)\b')")
def debt_terms_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    pattern = r"(?i)\b(todo|fixme|hack)\b"
    return view(spark, d, "chunk_view").where(F.col("content").rlike(pattern)).select("id", F.regexp_extract("content", pattern, 1).alias("word"))


@query("impact_rows_named", prelude("nodes", "edges", recursive=True) + ", walk(id, d) AS (SELECT 'P:10', 0 UNION SELECT e.source, d + 1 FROM walk JOIN edges e ON e.target = walk.id WHERE d < 5), hit AS (SELECT id, min(d) AS d FROM walk GROUP BY id) SELECT h.id, n.name, h.d AS distance, min(e.rel) AS rel FROM hit h JOIN edges e ON e.source = h.id JOIN hit g ON g.id = e.target AND g.d = h.d - 1 JOIN nodes n ON n.id = h.id GROUP BY 1, 2, 3")
def impact_rows_named(spark: SparkSession, d: str) -> DataFrame:
    hit = graph.reach(graph.reversed_edges(view(spark, d, "edges")), spark.createDataFrame([("P:10",)], "id string"), 5)
    return hit.join(view(spark, d, "nodes").select("id", "name"), "id").select("id", "name", "distance", "rel")
