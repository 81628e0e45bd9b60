"""Operational analytics: call statistics, decaying memory, mail, moving averages, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FACTOR, DECAY = 19 / 81, -0.5


def hourly_rollup(calls: DataFrame) -> DataFrame:
    """Count, sum and greatest latency by tool, project, status and hour."""
    return calls.groupBy("tool", "project_code", "status", F.date_trunc("hour", "ts").alias("bucket_hour")).agg(
        F.count("*").alias("call_count"), F.sum("latency_ms").alias("latency_sum_ms"), F.max("latency_ms").alias("latency_max_ms")
    )


def telemetry_report(rollup: DataFrame) -> DataFrame:
    """By tool: calls, errors, mean and greatest latency."""
    n = F.sum("call_count")
    return rollup.groupBy("tool").agg(
        n.alias("calls"), F.coalesce(F.sum(F.when(F.col("status") == "error", F.col("call_count"))), F.lit(0)).alias("errors"),
        F.round(F.sum("latency_sum_ms") / F.nullif(n, F.lit(0)), 1).alias("avg_ms"), F.max("latency_max_ms").alias("max_ms"),
    )


def nearest_rank_latency(calls: DataFrame, keys: list[str], percents: list[int], ranges: int = 64) -> DataFrame:
    """Nearest-rank percentiles by cumulative counts of distinct values.

    Rows are counted by value first; a key's values are cut into ranges of equal width, so the running count of a hot key goes over its ranges
    and then within each range, and no task sorts all rows of a key. Null values take no part.
    """
    v = calls.where("latency_ms is not null").groupBy(*keys, "latency_ms").agg(F.count("*").alias("c"))
    span = v.groupBy(*keys).agg(F.min("latency_ms").alias("lo"), F.max("latency_ms").alias("hi"), F.sum("c").alias("n"))
    v = v.join(span, keys)
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(ranges - 1), F.floor((F.col("latency_ms") - F.col("lo")) / (F.col("hi") - F.col("lo")) * ranges))).otherwise(0)
    v = v.withColumn("_b", b.cast("int"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    part = v.groupBy(*keys, "_b").agg(F.sum("c").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    within = Window.partitionBy(*keys, "_b").orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)
    v = v.join(part, [*keys, "_b"]).withColumn("upto", F.col("before") + F.sum("c").over(within))
    return v.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * p / 100), F.col("latency_ms"))).alias(f"p{p}") for p in percents])


def ewma(series: DataFrame, key: str, order: str, value: str, alpha: float = 0.3, k: float = 1.5) -> DataFrame:
    """Moving average e = a * v + (1 - a) * e' seeded by the first value, and the alert v > 0 and v > k * e' (never at the first).

    The series of a key comes to one row, so it suits bounded series such as waves of a layer pair.
    """
    step = lambda acc, x: F.struct(
        F.concat(acc["rows"], F.array(F.struct(x[order].alias(order), x[value].cast("double").alias(value), F.when(F.size(acc["rows"]) == 0, x[value].cast("double")).otherwise(alpha * x[value] + (1 - alpha) * acc["last"]).alias("ewma"), ((F.size(acc["rows"]) > 0) & (x[value] > 0) & (x[value] > k * acc["last"])).alias("alert")))).alias("rows"),
        F.when(F.size(acc["rows"]) == 0, x[value].cast("double")).otherwise(alpha * x[value] + (1 - alpha) * acc["last"]).alias("last"),
    )
    kind = series.schema[order].dataType.simpleString()
    start = F.struct(F.expr(f"cast(array() as array<struct<{order}:{kind},{value}:double,ewma:double,alert:boolean>>)").alias("rows"), F.lit(0.0).alias("last"))
    folded = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("s")).select(key, F.aggregate("s", start, step)["rows"].alias("r"))
    return folded.select(key, F.explode("r").alias("x")).select(key, f"x.{order}", f"x.{value}", "x.ewma", "x.alert")


def retrievability(days: Column, stability: Column) -> Column:
    return F.pow(1 + F.lit(FACTOR) * days / stability, F.lit(DECAY))


def recall_score(distance: Column, trust: Column, days: Column, stability: Column, durable: Column) -> Column:
    """max(0, 1 - distance) * (0.5 + 0.5 * trust) * R; durable rows do not decay with time."""
    return F.greatest(F.lit(0.0), 1 - distance) * (0.5 + 0.5 * trust) * F.when(durable, 1.0).otherwise(retrievability(days, stability))


def practice_tick(practices: DataFrame, decay: float = 0.05, prune_trust: float = 0.08, prune_recall: float = 0.05, grace: int = 14) -> DataFrame:
    """id, trust after decay, R, prune: rows of tier principle and durable ones stay, younger ones than the grace days too."""
    r = F.when(F.col("durable"), 1.0).otherwise(retrievability(F.col("days"), F.col("stability")))
    trust = F.when(F.col("durable"), F.col("trust")).otherwise(F.col("trust") * (1 - decay))
    prune = (F.col("tier") != "principle") & ~F.col("durable") & (F.col("days") > grace) & ((trust < prune_trust) | (r < prune_recall))
    return practices.select("id", trust.alias("trust"), r.alias("r"), prune.alias("prune"))


def unread(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """By recipient: messages after the reader's cursor, and the highest priority among them."""
    m = messages.join(cursors, "recipient", "left").where(F.col("message_id") > F.coalesce("cursor", F.lit(-1)))
    return m.groupBy("recipient").agg(F.count("*").alias("unread"), F.min("priority_rank").alias("top_priority"))


def sweep(messages: DataFrame, now: Column) -> DataFrame:
    """Messages past their time to live are archived, those of high priority never."""
    return messages.withColumn("archived", (F.col("ttl_at") < now) & (F.col("priority_rank") > 1))


def sessions_rate(events: DataFrame, seconds: int) -> DataFrame:
    """Events in the last so many seconds of the data, and their rate."""
    last = events.agg(F.max("ts").alias("last"))
    hit = events.crossJoin(F.broadcast(last)).where(F.unix_micros(F.col("ts").cast("timestamp")) > F.unix_micros(F.col("last").cast("timestamp")) - seconds * 1_000_000)
    return hit.agg(F.count("*").alias("events"), (F.count("*") / seconds).alias("per_second"))


def newest(df: DataFrame, key: list[str], at: str, *ties: str) -> DataFrame:
    """The last row of each key, by time and then by the given columns: an upsert of late and repeated rows."""
    order = [F.col(at).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in ties]]
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def truth_check(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """Counts of the same tables by two ways of reading: table, first, second, delta, drifted."""
    parts = None
    for name in sorted(a):
        x = a[name].agg(F.count("*").alias("first")).crossJoin(b[name].agg(F.count("*").alias("second"))).select(F.lit(name).alias("table"), "first", "second")
        parts = x if parts is None else parts.unionByName(x)
    return parts.withColumn("delta", F.abs(F.col("first") - F.col("second"))).withColumn("drifted", F.col("delta") > 0)
