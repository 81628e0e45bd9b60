"""Joins, aggregates and window forms that the other operators and the gateway are made of.

Null keys never join; ties go to a total order that each function names; empty inputs give no rows unless a total is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by a total order: a lateral join with limit 1, or DISTINCT ON."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """left with the value of the last right row of its key that is not after it; null where there is none.

    One sort of both sides by key and time instead of a range join: equal times count, ties on the right go to the greatest value.
    """
    r = right.where(F.col(key).isNotNull() & F.col(since).isNotNull()).groupBy(key, since).agg(F.max(value).alias(value))
    names = left.columns
    both = left.withColumns({"_row": F.struct(*names), "_v": F.lit(None).cast(r.schema[value].dataType), "_side": F.lit(1)}).select(key, F.col(at).alias("_t"), "_side", "_v", "_row")
    both = both.unionByName(r.select(key, F.col(since).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True)
    last = F.last("_v", ignorenulls=True).over(Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_v", last).where("_side = 1").select("_row.*", F.col("_v").alias(value))


def close_pairs(vectors: DataFrame, keys: list[str], below: float) -> DataFrame:
    """Pairs a < b of rows that agree on keys and are nearer than a cosine distance: the candidates of a fusion of practices."""
    from thicket.operators.retrieval import similar_pairs

    return similar_pairs(vectors.withColumn("_g", F.to_json(F.struct(*keys))).where(F.coalesce(*[F.col(k).isNotNull() for k in keys])), "_g", below)


def json_rows(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """By key a JSON array of objects in the order of a column; suits groups of few rows, such as the projects of a dashboard."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    return df.groupBy(key).agg(F.to_json(F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in columns]))).alias("rows"))


def json_sum(df: DataFrame, array: str, kind: str, name: str) -> DataFrame:
    """Sum of a number over the elements of JSON arrays of objects; null and broken texts have no elements."""
    parsed = df.select(F.explode(F.from_json(array, kind)).alias("x"))
    return parsed.agg(F.coalesce(F.sum(F.col("x")[name]), F.lit(0)).alias("total"), F.count("*").alias("elements"))


def weighted_geometric_mean(df: DataFrame, key: list[str], value: str, weight: str) -> DataFrame:
    """exp(sum(w ln v) / sum(w)) by key; rows of weight 0 or a null value take no part, a value of 0 makes the mean 0, no rows make it null."""
    own = df.where((F.col(weight) > 0) & F.col(value).isNotNull())
    mean = F.exp(F.sum(F.col(weight) * F.ln(F.greatest(F.col(value), F.lit(1e-300)))) / F.sum(weight))
    return own.groupBy(*key).agg(F.when(F.min(value) <= 0, 0.0).otherwise(mean).alias("mean"))


def rubric(texts: DataFrame, key: str, text: str, wanted: list[tuple[str, float]], unwanted: list[str]) -> DataFrame:
    """Score of each text: the matched share of the weights of wanted patterns less half for each unwanted one, within 0 and 1."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    total = sum(w for _, w in wanted) or 1.0
    hit = sum((F.when(t.rlike(p), w).otherwise(0.0) for p, w in wanted), F.lit(0.0)) / total
    bad = sum((F.when(t.rlike(p), 0.5).otherwise(0.0) for p in unwanted), F.lit(0.0))
    return texts.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), hit - bad)).alias("score"))


def snapshot_changes(snapshots: DataFrame, key: str, at: str, counters: list[str]) -> DataFrame:
    """By key the last snapshot against the one before: counter, before, after, change; keys of one snapshot have none."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    s = snapshots.select(key, at, *counters, *[F.lead(c).over(w).alias(f"_{c}") for c in counters], F.row_number().over(w).alias("_k"), F.count("*").over(Window.partitionBy(key)).alias("_n")).where("_k = 1 and _n > 1")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(f"_{c}").cast("double").alias("before"), F.col(c).cast("double").alias("after")) for c in counters]))
    return s.select(key, rows.alias("x")).select(key, "x.counter", "x.before", "x.after", (F.col("x.after") - F.col("x.before")).alias("change"))


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """Rows offset to offset + size in an order, each with has_more: whether rows follow the page. Only offset + size + 1 rows are ever sorted out."""
    top = df.orderBy(*order).limit(offset + size + 1)
    numbered = top.withColumn("_k", F.row_number().over(Window.orderBy(*order)))
    more = numbered.agg((F.count("*") > offset + size).alias("has_more"))
    return numbered.where((F.col("_k") > offset) & (F.col("_k") <= offset + size)).crossJoin(F.broadcast(more)).drop("_k")
