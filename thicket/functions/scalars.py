"""Column functions the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words a question's terms leave out: fixed values.
STOP_WORDS = "the and for with from that this what which when where who why how does are was were has have can into not you".split()


def fuzzy(name: Column, wanted: str) -> Column:
    """Substring; with separators as blanks; with separators as wildcards; without separators."""
    w = wanted.lower()
    n = F.lower(name)
    wild = "%" + "%".join(x for x in w.replace("_", " ").replace("-", " ").replace(":", " ").split()) + "%"
    bare = lambda c: F.regexp_replace(c, r"[_\-: ]", "")
    return n.contains(w) | F.translate(n, "_-:", "   ").contains(w) | n.like(wild) | bare(n).contains("".join(ch for ch in w if ch not in "_-: "))


def relevance(name: Column, wanted: str) -> list[Column]:
    """Order of matches: equal, prefix, place, length, name."""
    n = F.lower(name)
    w = wanted.lower()
    return [(n == w).desc(), n.startswith(w).desc(), F.nullif(F.instr(n, w), F.lit(0)).asc_nulls_last(), F.length(name), name]


def in_scope(df: DataFrame, project: str) -> DataFrame:
    """Rows of a project; all of them for an empty name or a star."""
    return df if project in ("", "*") else df.where(F.col("project_code") == project)


def terms(question: Column) -> Column:
    """Distinct words of three letters or more without the stop words, in their order."""
    words = F.split(F.lower(question), r"[^a-z0-9_]+")
    return F.array_distinct(F.filter(words, lambda x: (F.length(x) >= 3) & ~x.isin(STOP_WORDS)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is null, empty, of another length or zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0), 1 - dot / (norm(a) * norm(b)))


def tokens(text: Column) -> Column:
    """A text's length in characters over three, rounded up."""
    return F.ceil(F.length(text) / 3).cast("int")
