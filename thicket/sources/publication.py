"""Publishing a graph as Parquet, differences between publications, and upserts behind a pointer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def row_hash(df: DataFrame, key: list[str]) -> DataFrame:
    """key columns and hash: sixteen hexadecimal digits over all other columns by name."""
    rest = sorted(c for c in df.columns if c not in key)
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in rest]) if rest else F.lit("")
    return df.select(*key, F.substring(F.sha2(text, 256), 1, 16).alias("hash"))


def difference(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """State of every key: new, changed, deleted or skipped (unchanged)."""
    a, b = row_hash(before, key).withColumnRenamed("hash", "old"), row_hash(after, key).withColumnRenamed("hash", "new")
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "skipped").otherwise("changed")
    return a.join(b, key, "full").select(*key, state.alias("state"))


def publish(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes and edges as Parquet, and their counts by label and relation beside them."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    spark = nodes.sparkSession
    n, e = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    rows = [("node", r[0], r[1]) for r in n.groupBy("label").count().collect()] + [("edge", r[0], r[1]) for r in e.groupBy("relation_type").count().collect()]
    spark.createDataFrame(rows or [("node", None, 0)], "part string, name string, n long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def quarantine(df: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a condition, and the others (null counts as not met)."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The newest version of a versioned table, or None before the first."""
    fs, pointer = _fs(spark, f"{table}/CURRENT")
    if not fs.exists(pointer):
        return None
    version = json.loads(spark.read.text(f"{table}/CURRENT").first()[0])["version"]
    return spark.read.parquet(f"{table}/v{version}")


def upsert(spark: SparkSession, table: str, rows: DataFrame, key: list[str], at: str, add: tuple[str, ...] = ()) -> None:
    """Last writer by `at` wins, on ties the greater row hash; the columns of add are summed over all writers instead.

    The new version is written whole before the pointer is replaced in one rename, so readers see the old or the new one and never none.
    """
    old = current(spark, table)
    both = rows if old is None else old.unionByName(rows)
    hashed = both.withColumn("_h", F.xxhash64(*[F.col(c) for c in sorted(both.columns)]))
    sums = [F.sum(c).alias(f"_{c}") for c in add]
    best = hashed.groupBy(*key).agg(F.max_by(F.struct(*both.columns), F.struct(F.col(at), F.col("_h"))).alias("r"), *sums)
    best = best.select(*[F.col(f"_{c}").cast(both.schema[c].dataType).alias(c) if c in add else F.col("r")[c].alias(c) for c in both.columns])
    fs, pointer = _fs(spark, f"{table}/CURRENT")
    version = 1 if old is None else json.loads(spark.read.text(f"{table}/CURRENT").first()[0])["version"] + 1
    best.write.mode("overwrite").parquet(f"{table}/v{version}")
    _, tmp = _fs(spark, f"{table}/NEXT")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    jvm = spark._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(tmp), fs.makeQualified(pointer), how)


def bisect_bad(rows: list, write) -> list:
    """Write a batch of rows; where it fails, its halves, until single rows that fail are left: those are returned. The rows of one task's batch only."""
    try:
        write(rows)
        return []
    except Exception:  # noqa: BLE001
        if len(rows) == 1:
            return rows
        half = len(rows) // 2
        return bisect_bad(rows[:half], write) + bisect_bad(rows[half:], write)
