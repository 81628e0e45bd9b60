"""Table functions of the graph inside gateway statements: impact, callers_of, why_chain, path, blast_radius.

A call in a FROM or JOIN clause becomes a temporary view of the operator's plan, so Catalyst plans the statement around it as around
any table. Arguments are literals: strings, numbers, null.
"""

from __future__ import annotations

import ast
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from thicket.functions import sqlgate
from thicket.operators import graph

EDGES = "edges"
_CALL = re.compile(r"\b(from|join|,)(\s+)(?:ist\.)?(impact|callers_of|why_chain|path|blast_radius)\s*\(([^()]*)\)", re.IGNORECASE)
FUNCTIONS = {"impact": graph.impact, "callers_of": graph.callers_of, "why_chain": graph.why_chain, "path": graph.shortest_path, "blast_radius": graph.blast_radius}


def register(spark: SparkSession, edges: DataFrame) -> None:
    """The graph that the functions walk: source, target, rel."""
    edges.createOrReplaceTempView(EDGES)


def arguments(text: str) -> list:
    """Literals of a call; '' in a string is one quote."""
    if not text.strip():
        return []
    out = []
    for part in re.findall(r"'(?:[^']|'')*'|[^,]+", text):
        p = part.strip()
        if p.lower() == "null":
            out.append(None)
        elif p.startswith("'"):
            out.append(p[1:-1].replace("''", "'"))
        else:
            value = ast.literal_eval(p)
            if not isinstance(value, (int, float)):
                raise ValueError(f"a literal is needed, not {p}")
            out.append(value)
    return out


def run(spark: SparkSession, text: str, args: list | dict | None = None) -> DataFrame:
    """One read-only statement whose table functions are replaced by the plans of the graph operators."""
    if not sqlgate.is_read_only(text):
        raise PermissionError("only reading statements are allowed")

    def put(m: re.Match) -> str:
        name = f"call_{uuid.uuid4().hex}"
        FUNCTIONS[m[3].lower()](spark.table(EDGES), *arguments(m[4])).createOrReplaceTempView(name)
        return f"{m[1]}{m[2]}{name}"

    return sqlgate.run(spark, _CALL.sub(put, text), args)
