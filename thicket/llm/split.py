"""Splitting oversized texts by content-defined chunking.

A rolling hash over the text marks landmarks that depend only on the characters around them. A piece
ends at the first landmark after its minimum size, snapped to the nearest natural boundary (paragraph,
line, sentence, word) that keeps the piece within the limit. As neither landmarks nor boundaries look
back to the beginning of the text, an edit changes only the pieces near it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3
WINDOW = 24
#: A landmark every so many characters on average.
LANDMARK_EVERY = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Natural boundaries with the distance in characters that one of them may be farther away than a word end.
PARAGRAPH, LINE, SENTENCE, WORD = 400, 240, 120, 0

PIECES = "part_index int, part_count int, start_char long, end_char long, token_count int, piece string"


def tokens_of(text: Column) -> Column:
    """Tokens of a text: its code points divided by three, rounded up."""
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("int")


def landmarks(codes: np.ndarray) -> np.ndarray:
    """Positions p such that the window of WINDOW characters that ends before p hashes to a landmark."""
    n = len(codes)
    if n < WINDOW:
        return np.empty(0, dtype=np.int64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * _BASE
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x100000001B3) + mixed[k : k + len(h)]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return np.flatnonzero(h % np.uint64(LANDMARK_EVERY) == 0) + WINDOW


def boundaries(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a text may be cut, and the worth of each in characters."""
    nl, space = codes == 10, (codes == 32) | (codes == 9)
    worth = np.full(len(codes) + 1, -1, dtype=np.int32)
    after = worth[1:]
    after[space] = WORD
    stop = (codes == 46) | (codes == 33) | (codes == 63) | (codes == 59)
    after[1:][space[1:] & stop[:-1]] = SENTENCE
    after[nl] = LINE
    after[1:][nl[1:] & nl[:-1]] = PARAGRAPH
    after[2:][nl[2:] & (codes[1:-1] == 13) & nl[:-2]] = PARAGRAPH  # a blank line of CR LF
    at = np.flatnonzero(worth >= 0)
    return at, worth[at]


def cut_points(text: str, limit_chars: int, overlap_chars: int) -> list[tuple[int, int]]:
    """Start and end of each piece: at most limit_chars long, each after the first repeats the last
    overlap_chars characters of the one before. An empty text is one empty piece."""
    if overlap_chars < 0 or limit_chars <= overlap_chars:
        raise ValueError("the overlap must be smaller than the limit")
    n = len(text)
    if n <= limit_chars:
        return [(0, n)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    marks, (at, worth) = landmarks(codes), boundaries(codes)
    fresh = limit_chars - overlap_chars
    least = max(1, fresh // 3)
    pieces, start, begun = [], 0, 0
    while n - begun > limit_chars:
        # begun: where the piece begins with its overlap; start: where its new text begins
        low, high = start + least, min(begun + limit_chars, n - least)  # the last piece has its minimum too
        i = np.searchsorted(marks, low)
        aim = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        a, b = np.searchsorted(at, low), np.searchsorted(at, high, side="right")
        end = aim
        if b > a:
            score = np.abs(at[a:b] - aim) - worth[a:b]
            end = int(at[a + int(np.argmin(score))])
        pieces.append((begun, end))
        start, begun = end, end - overlap_chars
    pieces.append((begun, n))
    return pieces


def split_oversized(
    df: DataFrame, key: str, text: str, limit_tokens: int, overlap_tokens: int, whole: bool = True
) -> DataFrame:
    """One row per piece of each text: key, part_index (from 1), part_count, start_char, end_char, token_count, piece.

    Texts within the limit pass through as one piece without leaving the JVM (whole=False leaves them
    out); only oversized ones are cut, in Arrow batches, without any shuffle. Null texts give no row, an
    empty text one empty piece. Rows with the same key and text, as from a repeated record, give equal
    pieces; other columns of df are not carried along, so their names cannot clash.
    """
    limit, overlap = limit_tokens * CHARS_PER_TOKEN, overlap_tokens * CHARS_PER_TOKEN
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    big = src.where(F.length("t") > limit)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = cut_points(t, limit, overlap)
                for i, (a, b) in enumerate(parts, 1):
                    for column, v in zip(out, (k, i, len(parts), a, b, -(-(b - a) // CHARS_PER_TOKEN), t[a:b]), strict=True):
                        column.append(v)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            names = ["k", "part_index", "part_count", "start_char", "end_char", "token_count", "piece"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=x) for c, x in zip(out, kinds, strict=True)], names=names)

    kind = src.schema["k"].dataType.simpleString()
    pieces = big.mapInArrow(cut, f"k {kind}, {PIECES}")
    if whole:
        small = src.where(F.length("t") <= limit).select(
            "k", F.lit(1).alias("part_index"), F.lit(1).alias("part_count"), F.lit(0).cast("long").alias("start_char"),
            F.length("t").cast("long").alias("end_char"), tokens_of(F.col("t")).alias("token_count"), F.col("t").alias("piece"),
        )
        pieces = small.unionByName(pieces)
    return pieces.withColumnRenamed("k", key)
