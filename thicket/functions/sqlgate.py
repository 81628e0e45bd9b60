"""The read-only SQL gateway: guard, parameters, statement shapes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words a statement may begin with, and words none may hold outside quotes: fixed values.
BEGINS = ("select", "with", "pragma", "show", "describe", "explain")
WRITES = ("insert", "delete", "merge", "into", "update", "create", "drop", "alter", "truncate", "cache", "uncache", "refresh", "set", "reset", "add", "load", "analyze", "msck", "use")
_QUOTED = re.compile(r"--[^\n]*|/\*.*?\*/|\$(\w*)\$.*?\$\1\$|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`", re.DOTALL)


def skeleton(text: str) -> str:
    """The statement without comments, strings and quoted names."""
    return _QUOTED.sub(" ", text)


def is_read_only(text: str) -> bool:
    """Every statement begins with a reading word and holds no writing one; FOR [NO KEY] UPDATE is a lock, not a write."""
    parts = [p for p in skeleton(text).split(";") if p.strip()]
    if not parts:
        return False
    for p in parts:
        words = re.findall(r"[a-z_]\w*", re.sub(r"\bfor\s+(?:no\s+key\s+)?update\b", " ", p.lower()))
        if not words or words[0] not in BEGINS or any(w in WRITES for w in words):
            return False
    return True


def bind(text: str, args: list | dict | None) -> None:
    """Check that the parameters are scalars and as many as the statement asks for."""
    values = list(args.values()) if isinstance(args, dict) else list(args or [])
    for v in values:
        if v is not None and not isinstance(v, (bool, int, float, str)):
            raise TypeError(f"a parameter must be null, a boolean, a number or a string, not {type(v).__name__}")
    plain = skeleton(text)
    if isinstance(args, dict):
        names = set(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", plain))
        if names != set(args):
            raise ValueError(f"parameters {sorted(args)} given, {sorted(names)} asked for")
    elif plain.count("?") != len(values):
        raise ValueError(f"{len(values)} parameters given, {plain.count('?')} asked for")


def named(text: str) -> str:
    """$name, outside quotes and comments, as :name."""
    out, at = [], 0
    for m in _QUOTED.finditer(text):
        out += [re.sub(r"(?<![\w$])\$([A-Za-z_]\w*)", r":\1", text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, re.sub(r"(?<![\w$])\$([A-Za-z_]\w*)", r":\1", text[at:])])


def run(spark: SparkSession, text: str, args: list | dict | None = None) -> DataFrame:
    """One read-only statement with named (:name or $name) or positional (?) parameters."""
    text = named(text)
    if not is_read_only(text):
        raise PermissionError("only reading statements are allowed")
    bind(text, args)
    return spark.sql(text, args=args) if args else spark.sql(text)


def shape(text: Column) -> Column:
    """Literals and numbers that are no part of a name become ?, white space one blank, all lower case."""
    t = F.regexp_replace(text, r"'(?:[^']|'')*'", "?")
    t = F.regexp_replace(t, r"(?<![A-Za-z0-9_])\d+(?:\.\d+)?", "?")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def shape_hash(text: Column) -> Column:
    """Sixteen hexadecimal digits of a statement's shape."""
    return F.substring(F.sha2(shape(text), 256), 1, 16)
