"""File inventories: scans, exclusion reasons, purges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders a scan leaves out, and suffixes it knows: fixed values.
NOISE = ("node_modules", ".git", "target", "_build", "deps", "dist", "vendor", "__pycache__", ".venv")
KNOWN = ("py", "rs", "ex", "exs", "ts", "tsx", "js", "jsx", "go", "java", "c", "h", "cpp", "sql", "md", "yaml", "yml", "json", "toml", "conf")
MAX_BYTES = 2_000_000


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a folder: path, size_bytes, mtime_ms. Contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return f.select("path", F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("mtime_ms"))


def exclusion(path: Column, size: Column) -> Column:
    """Why a file is left out: excluded_path, unsupported, oversized, empty; null where it is taken."""
    noise = r"(?:^|/)(?:" + "|".join(x.replace(".", r"\.") for x in NOISE) + ")/"
    known = r"\.(?:" + "|".join(KNOWN) + ")$"
    return F.when(path.rlike(noise), "excluded_path").when(~path.rlike(known), "unsupported").when(size > MAX_BYTES, "oversized").when(size == 0, "empty")


def reasons(files: DataFrame) -> DataFrame:
    """Files by reason of exclusion."""
    return files.groupBy(F.coalesce(exclusion(F.col("path"), F.col("size_bytes")), F.lit("eligible")).alias("reason")).agg(F.count("*").alias("files"))


def stale(files: DataFrame, present: DataFrame, since_ms: int) -> DataFrame:
    """Files not seen since a scan began that are gone, or are no longer eligible: path."""
    old = files.where(F.coalesce("last_seen_ms", F.lit(0)) < since_ms)
    gone = old.join(present.select("path"), "path", "left_anti").select("path")
    return gone.unionByName(old.where(exclusion(F.col("path"), F.col("size_bytes")).isNotNull()).select("path")).distinct()


def purge(paths: DataFrame, files: DataFrame, chunks: DataFrame, embeddings: DataFrame, symbols: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """What remains of each table once files are gone: their chunks, the chunks' embeddings, their symbols and all edges at those."""
    f = files.join(paths, "path", "left_anti")
    dead_chunks = chunks.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select(F.col("id").alias("chunk_id"))
    dead_symbols = symbols.withColumn("path", F.split("id", "::").getItem(1)).join(paths, "path", "left_semi").select("id")
    left = edges.join(dead_symbols.withColumnRenamed("id", "source"), "source", "left_anti").join(dead_symbols.withColumnRenamed("id", "target"), "target", "left_anti")
    return {
        "files": f, "chunks": chunks.join(dead_chunks.withColumnRenamed("chunk_id", "id"), "id", "left_anti"), "embeddings": embeddings.join(dead_chunks, "chunk_id", "left_anti"),
        "symbols": symbols.join(dead_symbols, "id", "left_anti"), "edges": left,
    }
