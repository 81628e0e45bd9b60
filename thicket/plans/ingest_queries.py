"""Queries of ingestion over the read files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators import relational
from thicket.plans.registry import query
from thicket.session import table
from thicket.sources import ingest

NEW = "f AS (SELECT path, content FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY read_at_ms DESC NULLS LAST, content_hash DESC NULLS LAST) AS k FROM file_contents) q WHERE k = 1)"


def newest(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("read_at_ms").desc_nulls_last(), F.col("content_hash").desc_nulls_last()]
    return relational.first_by(table(spark, d, "file_contents").select("path", "content", "read_at_ms", "content_hash"), ["path"], order)


GENERATED = ingest.GENERATED.replace("'", "''")


@query("prepared_files", f"WITH {NEW} SELECT path, sha256(content) AS content_hash, CASE WHEN content IS NULL THEN 'missing' WHEN content = '' THEN 'empty' WHEN strlen(content) > 2000000 THEN 'oversized' WHEN contains(content, chr(0)) THEN 'binary' WHEN length(content)::DOUBLE / (length(content) - length(replace(content, chr(10), '')) + 1) > 400 THEN 'minified' WHEN regexp_matches(content, '{GENERATED}') THEN 'generated' ELSE 'ready' END AS state FROM f")
def prepared_files(spark: SparkSession, d: str) -> DataFrame:
    return ingest.prepare(newest(spark, d))


def _symbols_sql() -> str:
    arms = []
    for e, patterns in ingest.DECLARATIONS.items():
        for pattern, kind in patterns:
            p = pattern.replace("'", "''")
            arms.append(f"WHEN e = '{e}' AND regexp_matches(t, '{p}') THEN {{'name': regexp_extract(t, '{p}', 1), 'kind': '{kind}'}}")
    names = ", ".join(f"'{e}'" for e in ingest.DECLARATIONS)
    return f"WITH {NEW}, l AS (SELECT path, regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) AS e, regexp_split_to_array(content, '\\r?\\n') AS a FROM f WHERE content IS NOT NULL), u AS (SELECT path, e, unnest(a) AS t, generate_subscripts(a, 1) AS line FROM l WHERE e IN ({names})), x AS (SELECT path, line, CASE {' '.join(arms)} END AS s FROM u) SELECT path, line, s.name AS name, s.kind AS kind FROM x WHERE s IS NOT NULL"


@query("parsed_symbols", _symbols_sql())
def parsed_symbols(spark: SparkSession, d: str) -> DataFrame:
    return ingest.symbols(newest(spark, d))


@query("chunked_files")
def chunked_files(spark: SparkSession, d: str) -> DataFrame:
    return ingest.chunk_files(newest(spark, d))


@query("chunked_round_trip", f"WITH {NEW} SELECT path, sha256(content) AS content_hash, true AS within FROM f WHERE content <> ''")
def chunked_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of a file joined again are the file, each within the budget; a file's chunks are few rows."""
    c = chunked_files(spark, d).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("x"), F.max("tokens").alias("most"))
    return c.select("path", F.sha2(F.array_join(F.transform("x", lambda p: p["content"]), ""), 256).alias("content_hash"), (F.col("most") <= 512).alias("within"))


@query("hashed_embeddings", f"WITH {NEW} SELECT path, 64 AS dimension, 1.0::DOUBLE AS norm FROM f WHERE content IS NOT NULL")
def hashed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    v = ingest.embed(newest(spark, d).where("content is not null"), "path", "content")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return v.select("path", F.size("embedding").alias("dimension"), F.round(norm, 5).alias("norm"))


@query("coalesced_events", "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS events, max(ts) AS last FROM events GROUP BY 1, 2")
def coalesced_events(spark: SparkSession, d: str) -> DataFrame:
    return ingest.coalesce_events(table(spark, d, "events"), "user_id", "ts", 3_600_000)
