"""Context of a question: candidates of chunks and symbols from words, vectors and the graph, their order, and what fits a budget.

Distances are cosine distances, null where there is no vector; every order ends in the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.functions.scalars import cosine_distance, fuzzy

#: Distances below which a chunk, a symbol and an entry count as near: fixed values.
NEAR_CHUNK, NEAR_SYMBOL, NEAR_ENTRY = 0.55, 0.5, 0.5
SOURCES = ["entry_anchor", "same_file", "file_path", "lexical+semantic", "semantic", "lexical"]
#: Share of the token budget of each band of layered retrieval, in the order they are filled: fixed values.
BANDS = {"intent": 0.3, "code": 0.5, "recent": 0.2}


def _q(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def text_matches(chunks: DataFrame, wanted: str) -> DataFrame:
    """id, reason, rank: where a chunk holds a text: docstring 0, body 1, metadata 2, file path 3; the least counts."""
    w = wanted.lower()
    has = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(w)
    doc = F.lower(F.coalesce("content", F.lit(""))).rlike(r'(?s)("""|/\*\*|///|@doc).*?' + _escaped(w))
    rank = F.when(doc, 0).when(has("content"), 1).when(has("kind") | has("chunk_path"), 2).when(has("file_path"), 3)
    names = F.array(*[F.lit(x) for x in ("docstring", "body", "metadata", "file_path")])
    return chunks.select("id", rank.alias("rank")).where("rank is not null").select("id", F.element_at(names, F.col("rank") + 1).alias("reason"), "rank")


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)


def ann_plan(rows: int, k: int, ef: int | None = None, exact_below: int = 50_000) -> dict:
    """How nearest rows are sought: exact scan of small scopes, else an index with ef between 10 and 1000 and so many candidates."""
    ef = min(1000, max(10, ef if ef is not None else 4 * k))
    return {"exact": rows <= exact_below, "ef": ef, "candidates": max(3 * k, 30)}


def hybrid_chunks(chunks: DataFrame, embeddings: DataFrame, query: list[float], words: list[str], anchor: str | None = None, anchor_file: str | None = None, path: str | None = None, pool: int = 200, limit: int = 30) -> DataFrame:
    """Chunks near the query or holding one of its words: id, source_id, file_path, source, distance.

    The nearest `pool` embeddings below NEAR_CHUNK whose hash is still that of the chunk, united with the word and path matches;
    of a chunk found twice the row with a distance stays. Order: SOURCES, distance, id.
    chunks: id, source_id, file_path, content, content_hash, one row an id; embeddings: chunk_id, source_hash, embedding.
    """
    near = embeddings.select("chunk_id", "source_hash", cosine_distance(F.col("embedding"), _q(query)).alias("distance")).where("distance is not null")
    near = near.orderBy("distance", "chunk_id").limit(pool).where(F.col("distance") < NEAR_CHUNK)
    sem = chunks.join(F.broadcast(near.withColumnRenamed("chunk_id", "id")), "id").where("source_hash = content_hash").select(*chunks.columns, "distance")
    no = F.lit(False)
    entry = F.coalesce(F.col("source_id") == anchor, no) if anchor else no
    same = F.coalesce(F.col("file_path") == anchor_file, no) if anchor_file else no
    on_path = F.coalesce(F.lower("file_path").contains(path.lower()), no) if path else no
    lexical = no
    for w in words:
        lexical = lexical | F.coalesce(F.lower("content").contains(w.lower()), no)
    lex = chunks.where(entry | same | on_path | lexical).withColumn("distance", F.lit(None).cast("double"))
    both = sem.unionByName(lex).groupBy("id").agg(F.min_by(F.struct("source_id", "file_path", "content", "distance"), F.coalesce("distance", F.lit(1e9))).alias("x")).select("id", "x.*")
    rank = F.when(entry, 0).when(same, 1).when(on_path, 2).when(lexical & F.col("distance").isNotNull(), 3).when(F.col("distance").isNotNull(), 4).otherwise(5)
    ranked = both.withColumn("source_rank", rank).orderBy("source_rank", F.col("distance").asc_nulls_last(), "id").limit(limit)
    return ranked.select("id", "source_id", "file_path", F.element_at(F.array(*[F.lit(s) for s in SOURCES]), F.col("source_rank") + 1).alias("source"), "source_rank", "distance", "content")


def rerank_chunks(rows: DataFrame, words: list[str], exact: str | None = None, anchor: str | None = None, anchor_file: str | None = None, open_question: bool = False) -> DataFrame:
    """id, score, place: additive weights over the columns of hybrid_chunks.

    1.5 for each word in the content and 2 in the path, 5 for the exact name and for the anchor, 3.5 for its file, 3 * (1 - distance), less 2 for tests and 1 for vendored
    paths. On open questions, where any row is nearer than NEAR_ENTRY, rows with a distance come first, by it.
    """
    text, path = F.lower(F.coalesce("content", F.lit(""))), F.lower(F.coalesce("file_path", F.lit("")))
    score: Column = F.lit(0.0)
    for w in words:
        score = score + F.when(text.contains(w.lower()), 1.5).otherwise(0.0) + F.when(path.contains(w.lower()), 2.0).otherwise(0.0)
    if exact:
        score = score + F.when(text.rlike(r"(^|\W)" + _escaped(exact.lower()) + r"($|\W)"), 5.0).otherwise(0.0)
    if anchor:
        score = score + F.when(F.col("source_id") == anchor, 5.0).otherwise(0.0)
    if anchor_file:
        score = score + F.when(F.col("file_path") == anchor_file, 3.5).otherwise(0.0)
    score = score + F.coalesce(3 * (1 - F.col("distance")), F.lit(0.0))
    score = score - F.when(path.rlike(r"(^|/)(tests?|scripts)/|_test\.|\.test\."), 2.0).otherwise(0.0) - F.when(path.rlike("node_modules|vendor/|/dist/|_build"), 1.0).otherwise(0.0)
    out = rows.select("id", "distance", F.round(score, 6).alias("score"))
    if open_question:
        nearest = out.agg(F.min("distance").alias("nearest"))
        out = out.crossJoin(F.broadcast(nearest))
        first = F.when((F.col("nearest") < NEAR_ENTRY) & F.col("distance").isNotNull(), F.col("distance"))
        w = Window.orderBy(first.asc_nulls_last(), F.desc("score"), "id")
    else:
        w = Window.orderBy(F.desc("score"), "id")
    return out.withColumn("place", F.row_number().over(w)).select("id", "score", "place")


def rerank_entries(symbols: DataFrame, words: list[str], exact: str) -> DataFrame:
    """id, score, place of symbols that may be the entry of an answer: 2 for each word in the name, 5 for the exact name, 3 * (1 - distance), 1 less for tests.

    symbols: id, name, file_path, distance (null without a vector).
    """
    name, path = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("file_path", F.lit("")))
    score = F.when(name == exact.lower(), 5.0).otherwise(0.0) + F.coalesce(3 * (1 - F.col("distance")), F.lit(0.0))
    for w in words:
        score = score + F.when(name.contains(w.lower()), 2.0).otherwise(0.0)
    score = F.round(score - F.when(path.rlike(r"(^|/)tests?/"), 1.0).otherwise(0.0), 6)
    return symbols.select("id", score.alias("score")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def symbol_hybrid(symbols: DataFrame, vectors: DataFrame, edges: DataFrame, wanted: str, query: list[float], pool: int = 400, limit: int = 20) -> DataFrame:
    """Symbols by name or nearness and, behind them, their graph neighbours: id, distance, via (match or neighbour), place.

    symbols: id, name; vectors: id (of a symbol), embedding, of which the nearest `pool` count, each symbol by its least distance.
    """
    near = vectors.select("id", cosine_distance(F.col("embedding"), _q(query)).alias("distance")).where("distance is not null").orderBy("distance", "id").limit(pool)
    near = near.groupBy("id").agg(F.min("distance").alias("distance"))
    hit = symbols.select("id", "name").join(near, "id", "left").where(fuzzy(F.col("name"), wanted) | (F.col("distance") < NEAR_SYMBOL))
    top = hit.orderBy(F.col("distance").asc_nulls_last(), "name", "id").limit(limit).select("id", "distance", F.lit("match").alias("via"))
    e = edges.select(F.col("source").alias("x"), F.col("target").alias("y")).unionAll(edges.select("target", "source"))
    beside = e.join(top.select(F.col("id").alias("x")), "x").select(F.col("y").alias("id")).distinct().join(top.select("id"), "id", "left_anti").join(symbols.select("id"), "id", "left_semi")
    rows = top.unionByName(beside.select("id", F.lit(None).cast("double").alias("distance"), F.lit("neighbour").alias("via")))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("via", F.col("distance").asc_nulls_last(), "id")))


def fits(rows: DataFrame, key: list[str], order: list[Column], size: str, budget: Column) -> DataFrame:
    """The rows of each key, in order, whose running size stays within a budget: a prefix, by one window."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum(size).over(w)).where(F.col("upto") <= budget)


def layered(bands: dict[str, DataFrame], budget: int) -> DataFrame:
    """Bands of candidates, each filled within its share of the token budget: band, id, tokens, upto. Each band: id, score, tokens."""
    rows = None
    for name, df in bands.items():
        own = df.select(F.lit(name).alias("band"), "id", "score", F.col("tokens").cast("long").alias("tokens"), F.lit(int(budget * BANDS[name])).alias("room"))
        # a band can hold no more rows than its room has tokens
        own = own.where("tokens > 0 and tokens <= room").orderBy(F.desc("score"), "id").limit(int(budget * BANDS[name]))
        rows = own if rows is None else rows.unionByName(own)
    return fits(rows, ["band"], [F.desc("score"), F.col("id")], "tokens", F.col("room")).select("band", "id", "tokens", "upto")


def contradictions(statements: DataFrame, claim: str, query: list[float], k: int = 10, judge=None, threshold: float = 0.5) -> DataFrame:
    """Statements near a claim that speak against it: id, distance, verdict (contradiction, support, neutral), score.

    A shortlist of the min(3k, 60) nearest is judged; judge(claim, texts) gives a score of contradiction for each, from -1 (support) to 1. The default compares negations
    over shared words, a stand-in for a trained model that can be plugged in.
    """
    import pandas as pd

    near = statements.select("id", "text", cosine_distance(F.col("embedding"), _q(query)).alias("distance")).where("distance is not null")
    short = near.orderBy("distance", "id").limit(min(3 * k, 60))
    rate = judge or negation_judge

    def judged(texts):
        return pd.Series(rate(claim, texts.fillna("").tolist()), dtype=float)

    score = F.pandas_udf(judged, "double", F.PandasUDFType.SCALAR)
    s = short.withColumn("score", score("text"))
    verdict = F.when(F.col("score") >= threshold, "contradiction").when(F.col("score") <= -threshold, "support").otherwise("neutral")
    return s.select("id", "distance", verdict.alias("verdict"), "score")


#: Words that turn a statement round: fixed values.
NEGATIONS = frozenset("not no never without cannot none nobody nothing neither nor ne pas jamais nicht kein keine nie nunca".split())


def negation_judge(claim: str, texts: list[str]) -> list[float]:
    """The share of common words, with its sign turned where one of both is negated and the other is not: above 0 they differ."""
    import re

    parse = lambda t: set(re.findall(r"[^\W\d_]{2,}", t.lower()))
    own = parse(claim)
    out = []
    for t in texts:
        other = parse(t)
        a, b = own - NEGATIONS, other - NEGATIONS
        share = len(a & b) / max(1, len(a))
        differ = bool(own & NEGATIONS) != bool(other & NEGATIONS)
        out.append(share if differ else -share)
    return out
