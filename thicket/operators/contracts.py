"""Contracts: shape hashes, seals, adequacy and drift verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_KILL, LEAST_COVERAGE = 0.80, 1.0


def shape_hash(conditions: DataFrame, key: str = "contract", text: str = "condition") -> DataFrame:
    """SHA-256 over the sorted distinct conditions of each contract, separated by the unit separator: contract, shape.

    A contract's conditions are few by nature; they are the only thing gathered by key.
    """
    return conditions.where(F.col(text).isNotNull()).groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(text)), "\x1f"), 256).alias("shape"))


def adequacy(results: DataFrame) -> DataFrame:
    """adequate where killed mutants and covered conditions reach their shares; nothing measured is not adequate."""
    kill = F.col("killed") / F.nullif("mutants", F.lit(0))
    cover = F.col("covered") / F.nullif("conditions", F.lit(0))
    return results.withColumn("adequate", F.coalesce((kill >= LEAST_KILL) & (cover >= LEAST_COVERAGE), F.lit(False)))


def drift(contracts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Verdict of each contract(contract, symbol, kind, baseline, shape) against symbols(id, kind)."""
    j = contracts.join(symbols.select(F.col("id").alias("symbol"), F.col("kind").alias("now")).dropDuplicates(["symbol"]), "symbol", "left")
    verdict = (
        F.when(F.col("symbol").isNull(), "Unbound").when(F.col("now").isNull(), "SymbolMissing").when(F.col("now") != F.col("kind"), "KindMismatch")
        .when(F.col("baseline").isNull(), "NoBaseline").when(F.col("baseline") == F.col("shape"), "Aligned").otherwise("ShapeDrift")
    )
    return j.select("contract", verdict.alias("verdict"))
