"""Data catalogues and artifacts: JSON catalogue, CSV columns, READS_ARTIFACT edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTIFACT = "map<string, struct<name: string, kind: string, bytes: bigint, rows: bigint, n_cols: bigint, manifest: string, source: string>>"


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A JSON catalogue (name to artifact) as rows."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", ARTIFACT)).alias("key", "a")).select("key", "a.*")


def summary(artifacts: DataFrame) -> DataFrame:
    """By kind: artifacts, rows, and those without a manifest."""
    return artifacts.groupBy("kind").agg(F.count("*").alias("artifacts"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if(F.coalesce(F.length("manifest"), F.lit(0)) == 0).alias("without_manifest"))


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The columns a CSV file names in its first line."""
    return spark.read.csv(path, header=True).columns


def reads_artifact(chunks: DataFrame, artifacts: DataFrame, most: int = 10_000) -> DataFrame:
    """Edges from the symbols whose chunk text names an artifact: source, target, rel.

    The names are searched in one pass over the texts; their number is checked against `most`, beyond which the words of the
    texts are joined with the names.
    """
    names = artifacts.select("name").where("length(name) > 0").distinct()
    own = chunks.where("source_id is not null and content is not null").select(F.col("source_id").alias("source"), "content")
    if names.count() <= most:
        hit = own.join(F.broadcast(names), F.col("content").contains(F.col("name")))
    else:
        words = own.select("source", F.explode(F.array_distinct(F.split("content", r"[^\w./\-]+"))).alias("name"))
        hit = words.join(names, "name")
    return hit.select("source", F.concat(F.lit("artifact:"), "name").alias("target"), F.lit("READS_ARTIFACT").alias("rel")).distinct()
