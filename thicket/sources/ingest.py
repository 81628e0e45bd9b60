"""Ingestion of source files: admission, symbols by pattern, chunks within a token budget, embeddings, text-index queue, coalescing.

Texts are judged, cut and embedded where they are read; only keys and small rows are shuffled. Null and empty contents are kept as
rows of their own state and give no symbols or chunks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Greatest size in bytes of a file, and mean length of a line from which code is taken as minified.
MOST_BYTES, MINIFIED_LINE = 2_000_000, 400
GENERATED = r"(?i)^(?:\s*(?:#|//|/\*|--|;|<!--)[^\n]*\n){0,20}\s*(?:#|//|/\*|--|;|<!--)[^\n]*(?:code generated|do not edit|auto-?generated|@generated)"
#: Declarations of each language by extension: pattern of a line with the name as its first group, and the kind: fixed values.
DECLARATIONS = {
    "py": [(r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", "function"), (r"^\s*class\s+([A-Za-z_]\w*)", "class")],
    "rs": [(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+([A-Za-z_]\w*)", "function"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+([A-Za-z_]\w*)", "struct"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+([A-Za-z_]\w*)", "interface")],
    "go": [(r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", "function"), (r"^type\s+([A-Za-z_]\w*)\s+struct\b", "struct"), (r"^type\s+([A-Za-z_]\w*)\s+interface\b", "interface")],
    "ex": [(r"^\s*defp?\s+([a-z_]\w*[?!]?)", "function"), (r"^\s*defmodule\s+([A-Z][\w.]*)", "module")],
    "js": [(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", "function"), (r"^\s*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)", "class")],
    "java": [(r"^\s*(?:public\s+|final\s+|abstract\s+)*class\s+([A-Za-z_]\w*)", "class"), (r"^\s*(?:public\s+)?interface\s+([A-Za-z_]\w*)", "interface")],
}
DECLARATIONS["ts"] = [*DECLARATIONS["js"], (r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)", "interface")]
#: Neighbours of fewer tokens are fused where the budget allows; characters of a token.
FUSE_TOKENS, TOKEN_CHARS = 100, 3


def prepare(files: DataFrame) -> DataFrame:
    """path, content_hash, state of each read file: missing, empty, oversized, binary, minified, generated or ready; the first that holds.

    files: path, content.
    """
    text = F.col("content")
    lines = F.length(text) - F.length(F.regexp_replace(text, "\n", "")) + 1
    state = (
        F.when(text.isNull(), "missing").when(text == "", "empty").when(F.octet_length(text) > MOST_BYTES, "oversized").when(text.contains("\x00"), "binary")
        .when(F.length(text) / lines > MINIFIED_LINE, "minified").when(text.rlike(GENERATED), "generated").otherwise("ready")
    )
    return files.select("path", F.sha2(text, 256).alias("content_hash"), state.alias("state"))


def symbols(files: DataFrame) -> DataFrame:
    """path, line, name, kind: declarations of a line of code, by the patterns of the path's extension. Other extensions have none."""
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    lines = files.where(ext.isin(list(DECLARATIONS)) & F.col("content").isNotNull()).select("path", ext.alias("e"), F.posexplode(F.split("content", r"\r?\n")).alias("line", "t"))
    found = F.lit(None).cast("struct<name:string,kind:string>")
    for e, patterns in DECLARATIONS.items():
        for pattern, kind in reversed(patterns):
            found = F.when((F.col("e") == e) & F.col("t").rlike(pattern), F.struct(F.regexp_extract("t", pattern, 1).alias("name"), F.lit(kind).alias("kind"))).otherwise(found)
    return lines.select("path", (F.col("line") + 1).alias("line"), found.alias("x")).where("x is not null").select("path", "line", "x.name", "x.kind")


def break_lines(sizes: list[int], clean: list[bool], budget: int) -> list[tuple[int, int]]:
    """Ranges of lines, each within the budget, of the least cost: the squared room left in each but the last, and a quarter of the squared
    budget for a cut that is not before a clean line. A line over the budget is a range of its own. Small neighbours are fused at the end."""
    n = len(sizes)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        total, i = 0, j
        while i > 0:
            i -= 1
            total += sizes[i]
            if total > budget and j - i > 1:
                break
            room = 0 if j == n else max(0, budget - total) ** 2
            cost = best[i] + room + (0 if j == n or clean[j] else budget * budget / 4)
            if cost < best[j]:
                best[j], back[j] = cost, i
            if total > budget:
                break
    out, j = [], n
    while j > 0:
        out.append((back[j], j))
        j = back[j]
    fused: list[tuple[int, int]] = []
    for a, b in reversed(out):
        if fused and sum(sizes[fused[-1][0] : b]) <= budget and min(sum(sizes[slice(*fused[-1])]), sum(sizes[a:b])) < FUSE_TOKENS:
            fused[-1] = (fused[-1][0], b)
        else:
            fused.append((a, b))
    return fused


def chunk_text(text: str, budget: int) -> list[tuple[int, int, str]]:
    """First line, last line (from 1) and text of each chunk; a line over the budget is cut into windows of it. The chunks joined are the text."""
    lines = text.splitlines(keepends=True)
    sizes = [-(-len(x) // TOKEN_CHARS) for x in lines]
    clean = [not x.strip() or not x[0].isspace() for x in lines]
    out = []
    for a, b in break_lines(sizes, clean, budget):
        part = "".join(lines[a:b])
        if b - a == 1 and sizes[a] > budget:
            width = budget * TOKEN_CHARS
            out += [(a + 1, b, part[k : k + width]) for k in range(0, len(part), width)]
        else:
            out.append((a + 1, b, part))
    return out


CHUNKS = "path string, part int, parts int, start_line int, end_line int, tokens int, content string"


def chunk_files(files: DataFrame, budget: int = 512) -> DataFrame:
    """Chunks of each file within a token budget, without a shuffle: path, part (from 1), parts, start_line, end_line, tokens, content."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = chunk_text(text, budget)
                rows += [(path, k, len(parts), a, b, -(-len(t) // TOKEN_CHARS), t) for k, (a, b, t) in enumerate(parts, 1)]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])

    return files.select("path", "content").where("content <> ''").mapInArrow(cut, CHUNKS)


def hash_vector(text: str, dim: int) -> list[float]:
    """A unit vector of hashed words, a deterministic stand-in for a model; an empty text points along the first axis."""
    v = np.zeros(dim)
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    if not v.any():
        v[0] = 1.0
    return (v / np.linalg.norm(v)).tolist()


def embed(chunks: DataFrame, key: str, text: str, dim: int = 64, model: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """key, embedding: vectors of texts in batches by a model (the hashed words by default). A vector of another length is an error; null texts give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = model or (lambda texts: [hash_vector(t, dim) for t in texts])
        for batch in batches:
            texts = batch.column(1).to_pylist()
            made = iter(rate([t for t in texts if t is not None]))
            rows = [None if t is None else next(made) for t in texts]
            if any(r is not None and len(r) != dim for r in rows):
                raise ValueError(f"the model does not give vectors of {dim} elements")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=pa.list_(pa.float32()))], names=["key", "embedding"])

    src = chunks.select(F.col(key).alias("key"), F.col(text).alias("t"))
    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, embedding array<float>").withColumnRenamed("key", key)


def admitted(spark: SparkSession, folder: str, schema: str, memory_bytes: int, row_bytes: int = 1 << 20) -> DataFrame:
    """A stream over Parquet files that takes in each trigger no more than a share of memory holds: files by their count, bytes by Spark's own limit."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, memory_bytes // (8 * row_bytes)))
    return reader.parquet(folder)


def coalesce_events(events: DataFrame, key: str, at: str, window_ms: int = 50) -> DataFrame:
    """One notice for the events of a key within a window: key, window_start, events, last. Works on streams (add a watermark) and tables."""
    w = F.window(at, f"{window_ms} milliseconds")
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("events"), F.max(at).alias("last")).select(key, F.col("w.start").alias("window_start"), "events", "last")


def index_batches(changes: DataFrame, folder: str, key: str, fields: dict[str, str], checkpoint: str):
    """A stream of changed rows whose word vectors are written batch by batch: each batch overwrites its own folder, so a repeated one adds nothing."""
    from thicket.functions import fts

    def write(batch: DataFrame, number: int) -> None:
        fts.vectors(batch, key, fields).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
