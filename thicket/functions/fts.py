"""Full-text functions: weighted word vectors, stems, queries and ranks, as columns and plans.

A document's vector is one row per word with its positions and the weight of the field each stands in (A 1.0, B 0.4, C 0.2, D 0.1).
Stems are cut by suffix rules, an approximation of the English stemmer of the studied database; other languages use `simple`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weights by label, and the normalising constant (pi^2 / 6) of the plain rank: fixed values.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
LIMIT = 1.64493406685
#: Suffix rules in the order they are applied: fixed values.
RULES = [(r"sses$", "ss"), (r"ies$", "i"), (r"([^s])s$", "$1"), (r"(..)(?:ing|ed|ly)$", "$1"), (r"(...)(?:ation|ator|ations)$", "$1at"), (r"y$", "i")]


def stem(word: Column, config: str = "english") -> Column:
    """The stem of a lower-case word; `simple` leaves it as it is. Words of three letters or less stay."""
    if config == "simple":
        return word
    out = word
    for pattern, by in RULES:
        out = F.regexp_replace(out, pattern, by)
    return F.when(F.length(word) <= 3, word).otherwise(out)


def words(text: Column) -> Column:
    """Lower-case words of a text in their order; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_]+"), lambda w: w != "")


def vectors(docs: DataFrame, key: str, fields: dict[str, str], config: str = "english", only: list[str] | None = None) -> DataFrame:
    """id, lexeme, position, weight: every word of the fields (name to weight label), positions counted on over the fields.

    With only, stems of other words are dropped where they are read, so a query costs its own words and not the whole index.
    """
    def weighted(name: str, weight: float) -> Column:
        return F.transform(words(F.col(name)), lambda w: F.struct(w.alias("w"), F.lit(weight).alias("weight")))

    arrays = [weighted(c, WEIGHTS[label]) for c, label in fields.items()]
    rows = docs.select(F.col(key).alias("id"), F.posexplode(F.concat(*arrays)).alias("position", "x"))
    out = rows.select("id", stem(F.col("x.w"), config).alias("lexeme"), (F.col("position") + 1).alias("position"), F.col("x.weight").alias("weight"))
    return out if only is None else out.where(F.col("lexeme").isin(only))


def query_terms(spark, question: str, config: str = "english", stop: tuple[str, ...] = ()) -> list[str]:
    """Distinct stems of a question without stop words."""
    row = spark.range(1).select(F.array_sort(F.array_distinct(F.transform(F.filter(words(F.lit(question)), lambda w: ~w.isin(list(stop) or [""])), lambda w: stem(w, config)))).alias("t")).first()
    return row["t"]


def matches(vector: DataFrame, terms: list[str], every: bool = True) -> DataFrame:
    """id of documents that hold every term (or any)."""
    n = vector.where(F.col("lexeme").isin(terms)).groupBy("id").agg(F.countDistinct("lexeme").alias("n"))
    return n.where(F.col("n") >= (len(set(terms)) if every else 1)).select("id")


def rank(vector: DataFrame, terms: list[str]) -> DataFrame:
    """id, score: the plain rank for any of the terms.

    For a term whose weights at its positions are w1, w2, ... and whose greatest is wm at place m: (wm + sum of wj / j^2 - wm / m^2) / LIMIT;
    the mean of these over the terms of the query.
    """
    w = Window.partitionBy("id", "lexeme").orderBy("position")
    t = vector.where(F.col("lexeme").isin(terms)).withColumn("j", F.row_number().over(w))
    g = t.groupBy("id", "lexeme").agg(F.sum(F.col("weight") / (F.col("j") * F.col("j"))).alias("s"), F.max(F.struct("weight", -F.col("j"))).alias("m"))
    m = -F.col("m")["col2"]
    part = (F.col("m.weight") + F.col("s") - F.col("m.weight") / (m * m)) / F.lit(LIMIT)
    return g.groupBy("id").agg((F.sum(part) / len(set(terms))).alias("score"))


def _covers(pdf: pd.DataFrame, wanted: int) -> float:
    """Sum over the minimal intervals that hold all terms of their density."""
    rows = list(zip(pdf["position"].tolist(), pdf["lexeme"].tolist(), pdf["weight"].tolist(), strict=True))
    rows.sort()
    last: dict[str, int] = {}
    total, before = 0.0, -1
    for i, (_, lexeme, _) in enumerate(rows):
        last[lexeme] = i
        if len(last) < wanted:
            continue
        begin = min(last.values())
        if begin == before:
            continue  # a shorter interval with this beginning has been counted
        before = begin
        inside = rows[begin : i + 1]
        size, inverse = len(inside), sum(1 / w for _, _, w in inside)
        noise = rows[i][0] - rows[begin][0] - (size - 1)
        total += size / inverse / (1 + max(0, noise))
    return total


def cover_rank(vector: DataFrame, terms: list[str]) -> DataFrame:
    """id, score: the cover-density rank of documents that hold every term.

    The minimal intervals of positions that hold all terms count each words / sum(1 / weight), divided by one more than the words between.
    Only the postings of the query's words are grouped, by document.
    """
    n = len(set(terms))
    hits = vector.where(F.col("lexeme").isin(terms)).join(matches(vector, terms), "id", "left_semi")

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": pdf["id"].iloc[:1], "score": [_covers(pdf, n)]})

    return hits.groupBy("id").applyInPandas(score, f"id {vector.schema['id'].dataType.simpleString()}, score double")
