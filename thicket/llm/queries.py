"""The pN_ queries: each applies one operator, with production parameters, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import knn, layout, mix, pack, secrets, split, syntax, tokens, toxicity
from thicket.session import cut, table


def limits(spark: SparkSession, d: str) -> dict[str, tuple[int, int]]:
    """size_limits by purpose: a fixed table of four rows."""
    return {r["purpose"]: (r["limit_tokens"], r["overlap_tokens"] or 0) for r in table(spark, d, "size_limits").collect()}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Line of each secret in each chunk; a repeated id counts once."""
    return secrets.find_secrets(table(spark, d, "chunks")).select("id", "line_no").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every row of chunks with its secrets masked; a repeated id comes out repeated, so no text is moved."""
    return secrets.find_secrets(table(spark, d, "chunks"), copy=True)


def p1_form(spark: SparkSession, d: str) -> DataFrame:
    """What masking must not change, by project-free totals: rows, rows with content, characters and lines of the masked copies."""
    lines = F.length("redacted") - F.length(F.replace("redacted", F.lit("\n"), F.lit("")))
    return p1_redacted(spark, d).agg(F.count("*").alias("rows"), F.count("redacted").alias("texts"), F.sum(F.length("redacted")).alias("chars"), F.sum(lines).alias("line_ends"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk in pieces within chunk_window, renumbered and recounted; a repeated id is kept once."""
    limit, overlap = limits(spark, d)["chunk_window"]
    pieces = split.split_oversized(table(spark, d, "chunks"), "id", "content", limit, overlap)
    return pieces.dropDuplicates(["id", "part_index"]).withColumnsRenamed(
        {"part_index": "chunk_part_index", "part_count": "chunk_part_count", "piece": "content"}
    )


def p2_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of a chunk without their overlaps joined again: id, hash of the text, and whether each piece is within the limit. A chunk's pieces are few rows."""
    limit, overlap = limits(spark, d)["chunk_window"]
    fresh = F.when(F.col("chunk_part_index") > 1, F.substr("content", F.lit(overlap * split.CHARS_PER_TOKEN + 1))).otherwise(F.col("content"))
    joined = p2_pieces(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk_part_index", fresh.alias("t")))).alias("x"), F.max("token_count").alias("most"))
    return joined.select("id", F.sha2(F.array_join(F.transform("x", lambda p: p["t"]), ""), 256).alias("hash"), (F.col("most") <= limit).alias("within"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that the splitter had to cut."""
    limit, overlap = limits(spark, d)["chunk_window"]
    pieces = split.split_oversized(table(spark, d, "chunks"), "id", "content", limit, overlap, whole=False)
    return pieces.where(F.col("part_count") > 1).select("id").distinct()


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """Every judged file with its edit cost and the cause of its errors."""
    return syntax.judge_files(table(spark, d, "file_contents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The files whose newest content does not parse."""
    return syntax.judge_files(table(spark, d, "file_contents")).where("broken").select("path")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per project and language, over the files indexed for a project."""
    files = table(spark, d, "indexed_files").groupBy("path").agg(
        F.max_by("project_code", F.struct(F.coalesce("last_seen_ms", F.lit(-1)), F.coalesce("project_code", F.lit("")))).alias("project_code")
    )
    judged = syntax.judge_files(table(spark, d, "file_contents")).join(files, "path", "left")
    return judged.groupBy("project_code", "extension").agg(
        F.count("*").alias("files"), F.count_if("broken").alias("broken"), F.avg(F.col("broken").cast("int")).alias("rate"),
        *[F.count_if(F.col("cause") == c).alias(c) for c in ("truncation", "conflict", "mismatch", "error")],
    )


def p4_vectors(spark: SparkSession, d: str) -> DataFrame:
    """symbols and, by model, the newest staged embedding of each chunk; each (collection, id) once."""
    symbols = table(spark, d, "symbols").select(F.lit("symbols").alias("collection"), "id", "embedding")
    symbols = symbols.where(knn.valid_vector(F.col("embedding"), 64)).groupBy("collection", "id").agg(F.min("embedding").alias("embedding"))
    stage = table(spark, d, "bulk_chunk_embedding_stage").groupBy(F.col("model_id").alias("collection"), F.col("chunk_id").alias("id")).agg(
        F.max_by("embedding", F.struct(F.coalesce("embedded_at_ms", F.lit(-1)), "embedding")).alias("embedding")
    )
    return symbols.unionByName(stage)


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar vectors of every valid vector."""
    return knn.all_neighbours(p4_vectors(spark, d), k=10, dim=64)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of at least 0.90 of which one is among the other's ten most similar."""
    near = knn.all_neighbours(p4_vectors(spark, d), k=10, dim=64, least=0.90).where(F.col("similarity") >= 0.90)
    pair = near.select(
        "collection", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")
    )
    return pair.distinct()


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kind of every indexed path; null where it was written by hand."""
    return layout.classify(table(spark, d, "indexed_files"), table(spark, d, "file_contents"), table(spark, d, "upstream_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The paths not written by hand."""
    return p5_kinds(spark, d).where(F.col("kind").isNotNull()).select("path")


def p5_remaining(spark: SparkSession, d: str) -> DataFrame:
    """By project: files, files of each kind, and the files that remain."""
    kinds = p5_kinds(spark, d)
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return kinds.groupBy("project_code").agg(
        F.count("*").alias("files"), *[count(k) for k in ("generated", "minified", "vendored", "blob")], F.count_if(F.col("kind").isNull()).alias("remaining")
    )


def capacities(spark: SparkSession, d: str) -> dict[str, int]:
    return {k: v[0] for k, v in limits(spark, d).items() if k.startswith("pack_")}


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Container and position of every document for each pack_* capacity."""
    sized = cut(tokens.with_tokens(table(spark, d, "documents"), ["doc_id"], "text"))
    packed = pack.pack_documents(sized, "doc_id", "tokens", capacities(spark, d))
    return packed.select("purpose", "container", "position", F.col("doc_key").cast("long").alias("doc_id"), "piece", "first_token", "tokens")


def p6_utilisation(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, by capacity."""
    packed = p6_packed(spark, d).withColumnRenamed("doc_id", "doc_key")
    return pack.utilisation(packed, capacities(spark, d))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = cut(tokens.with_tokens(table(spark, d, "documents"), ["doc_id", "source", "lang"], "text"))
    return mix.mix(sized, table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture with their epoch and tokens used."""
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share and repeats of each source."""
    return _mixed(spark, d)[1]


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    documents = table(spark, d, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, d, "moderation_labels")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents at or above the threshold."""
    return p8_scores(spark, d).where(F.col("score") >= toxicity.THRESHOLD).select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per source."""
    return toxicity.rates(p8_scores(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_redacted": p1_redacted, "p1_form": p1_form, "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_round_trip": p2_round_trip, "p3_files": p3_files, "p3_found": p3_found, "p3_rates": p3_rates, "p4_found": p4_found, "p4_neighbours": p4_neighbours,
        "p5_found": p5_found, "p5_kinds": p5_kinds, "p5_remaining": p5_remaining,
        "p6_packed": p6_packed, "p6_utilisation": p6_utilisation, "p7_mixture": p7_mixture, "p7_shares": p7_shares,
        "p8_found": p8_found, "p8_rates": p8_rates, "p8_scores": p8_scores,
    }


#: A valid vector in SQL: 64 elements, all finite, not all zero.
VALID = "len({0}) = 64 AND len(list_filter({0}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0"


def oracle_sql() -> dict[str, str]:
    return {
        # all pairs of each collection, which suits the small tables the text runs on
        "p4_found": "WITH g AS (SELECT 'symbols' AS collection, id, min(embedding) AS e FROM symbols WHERE id IS NOT NULL AND " + VALID.format("embedding") + " GROUP BY id UNION ALL SELECT model_id, chunk_id, embedding FROM (SELECT *, row_number() OVER (PARTITION BY model_id, chunk_id ORDER BY coalesce(embedded_at_ms, -1) DESC, embedding DESC NULLS LAST) AS k FROM bulk_chunk_embedding_stage) q WHERE k = 1 AND model_id IS NOT NULL AND chunk_id IS NOT NULL AND " + VALID.format("embedding") + "), v AS (SELECT collection, id, list_transform(e::DOUBLE[], lambda x: x / sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]))) AS u FROM g), s AS (SELECT a.collection, a.id AS a, b.id AS b, list_dot_product(a.u, b.u) AS s FROM v a JOIN v b ON a.collection = b.collection AND a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY collection, a ORDER BY s DESC, b) AS k FROM s) SELECT DISTINCT collection, least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE k <= 10 AND s >= 0.9",
        "p1_form": "SELECT count(*) AS rows, count(content) AS texts, sum(length(content))::BIGINT AS chars, sum(length(content) - length(replace(content, chr(10), '')))::BIGINT AS line_ends FROM chunks",
        "p2_round_trip": "SELECT id, sha256(max(content)) AS hash, true AS within FROM chunks WHERE content IS NOT NULL GROUP BY id",
        "p2_found": "SELECT DISTINCT id FROM chunks WHERE ceil(length(content) / 3.0) > (SELECT limit_tokens FROM size_limits WHERE purpose = 'chunk_window')",
    }
