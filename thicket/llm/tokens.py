"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file; a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text into the words the byte pairs are merged in; a fixed value of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def encoder(path: str = VOCABULARY):
    """The tiktoken encoding of a vocabulary file, loaded once per process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    """Tokens of a whole text, 0 for an empty one. Merging takes little more than linear time, also in the length of one word."""
    return len(encoder(path).encode_ordinary(text))


def with_tokens(df: DataFrame, keep: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """The columns keep of df and tokens int: the tokens of each text, 0 for null. No shuffle."""
    src = df.select(*keep, F.col(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            sizes = pa.array([count_tokens(t, path) if t else 0 for t in texts], type=pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], sizes], names=[*keep, "tokens"])

    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep) + ", tokens int"
    return src.mapInArrow(count, schema)
