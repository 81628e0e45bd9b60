"""Filling containers of a fixed capacity: cost-balanced packing.

The cost of a document of n tokens is estimated as LINEAR * n + QUADRATIC * n^2, the linear layers and the
attention of a model over it. Documents go in descending order to the sequence of the lowest cost
among those whose remaining capacity holds them. A group opens only as many sequences as its tokens need
at least, plus what no open sequence could hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Documents of one group, packed by one task; the groups are independent, each by a hash of the key.
GROUP_ROWS = 20_000
PACKED = "purpose string, container string, position int, doc_key string, piece int, first_token long, tokens int"


class _Open:
    """Open sequences by remaining capacity; lowest cost among those with room, by a tree of minima."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [(math.inf, -1)] * (2 * self.leaves)
        self.heaps: list[list] = [[] for _ in range(self.leaves)]

    def _lift(self, room: int) -> None:
        i = room + self.leaves
        self.tree[i] = self.heaps[room][0] if self.heaps[room] else (math.inf, -1)
        i >>= 1
        while i:
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])
            i >>= 1

    def put(self, room: int, cost: float, number: int) -> None:
        heappush(self.heaps[room], (cost, number))
        if self.heaps[room][0][1] == number:
            self._lift(room)

    def fill(self, room: int, count: int) -> None:
        self.heaps[room] = [(0.0, n) for n in range(count)]
        heapify(self.heaps[room])
        self._lift(room)

    def take(self, size: int) -> tuple[int, float, int] | None:
        """The cheapest sequence with room for size: its room, cost and number."""
        low, high, best = size + self.leaves, 2 * self.leaves, (math.inf, -1)
        at = -1
        while low < high:
            if low & 1:
                if self.tree[low] < best:
                    best, at = self.tree[low], low
                low += 1
            if high & 1:
                high -= 1
                if self.tree[high] < best:
                    best, at = self.tree[high], high
            low >>= 1
            high >>= 1
        if at < 0 or best[1] < 0:
            return None
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] == best else 2 * at + 1
        room = at - self.leaves
        cost, number = heappop(self.heaps[room])
        self._lift(room)
        return room, cost, number


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item (sizes up to the capacity): numbers from 0."""
    order = np.argsort(-sizes, kind="stable")
    least = -(-int(sizes.sum()) // capacity) if len(sizes) else 0
    space, result, opened = _Open(capacity), np.zeros(len(sizes), dtype=np.int64), max(1, least)
    space.fill(capacity, opened)
    for i in order:
        n = int(sizes[i])
        found = space.take(n)
        if found is None:
            found, opened = (capacity, 0.0, opened), opened + 1
        room, cost, number = found
        result[i] = number
        space.put(room - n, cost + LINEAR * n + QUADRATIC * n * n, number)
    return result


def pack_documents(
    sized: DataFrame, key: str, tokens: str, capacities: dict[str, int], group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Container and position of each document for each capacity: one row per document, or per piece of one
    that alone exceeds the capacity.

    sized: key (unique), tokens (null counts as 0). Rows with a null key are left out. An oversized document
    is cut into full pieces, each a container of its own, and a rest that is packed like a document. A
    document of no tokens takes a position like any other. Containers are named <group>-<number>; the
    groups come from a hash of the key, about group_rows documents each, so no task grows with the data and
    at most a few containers of each group stay partly empty.
    """
    src = sized.select(F.col(key).cast("string").alias("k"), F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long").alias("n")).where(F.col("k").isNotNull())
    rows = src.count()
    groups = max(1, math.ceil(rows / group_rows))
    purposes = sorted(capacities.items())

    def fill(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("k")
        keys, n = np.asarray(t["k"].to_pylist(), dtype=object), t["n"].to_numpy()
        g = group[0].as_py()
        for purpose, capacity in purposes:
            whole, rest = n // capacity, n % capacity
            whole[(rest == 0) & (whole > 0)] -= 1
            rest = n - whole * capacity
            number = pack(rest, capacity)
            used = np.unique(number, return_inverse=True)[1] if len(number) else number
            base = int(used.max()) + 1 if len(used) else 0
            full = np.repeat(np.arange(len(n)), whole)
            piece = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
            at = np.concatenate([np.arange(len(n)), full])
            box = np.concatenate([used, base + np.arange(len(full))])
            size = np.concatenate([rest, np.full(len(full), capacity)])
            part = np.concatenate([whole, piece])
            order = np.lexsort((at, -size, box))
            at, box, size, part = at[order], box[order], size[order], part[order]
            first = np.flatnonzero(np.concatenate([[True], box[1:] != box[:-1]])) if len(box) else np.empty(0, int)
            place = np.arange(len(box)) - np.repeat(first, np.diff(np.append(first, len(box))))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([purpose] * len(at)), pa.array([f"{g}-{b}" for b in box.tolist()]), pa.array(place.astype(np.int32)),
                    pa.array(keys[at].tolist(), type=pa.string()), pa.array(part.astype(np.int32)), pa.array(part.astype(np.int64) * capacity), pa.array(size.astype(np.int32)),
                ],
                names=["purpose", "container", "position", "doc_key", "piece", "first_token", "tokens"],
            )

    grouped = src.withColumn("g", F.pmod(F.xxhash64("k"), F.lit(groups)).cast("int"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(fill(key, iter(table.to_batches()))))

    # a number of partitions that is asked for is not coalesced: groups stay spread over tasks
    return grouped.repartition(2 * groups, "g").groupBy("g").applyInArrow(run, PACKED)


def utilisation(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """By purpose: documents, containers, tokens, unused tokens and the share of the room that is used."""
    limit = F.create_map(*[F.lit(x) for kv in capacities.items() for x in kv])
    per = packed.groupBy("purpose").agg(
        F.countDistinct("doc_key").alias("documents"), F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")
    )
    room = F.col("containers") * limit[F.col("purpose")]
    return per.withColumn("unused_tokens", room - F.col("tokens")).withColumn("used_share", F.col("tokens") / room)
