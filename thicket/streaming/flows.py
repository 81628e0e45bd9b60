"""Streams: hourly rollups, first sightings of contents, debounced changes, upserts per micro-batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from thicket.sources.publication import upsert


def hourly(calls: DataFrame, late: str = "2 hours") -> DataFrame:
    """Calls, latency sum and maximum by tool, project, status and hour; rows later than `late` are dropped."""
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = timed.groupBy(F.window("ts", "1 hour"), "tool", "project_code", "status")
    out = g.agg(F.count("*").alias("call_count"), F.sum("latency_ms").alias("latency_sum_ms"), F.max("latency_ms").alias("latency_max_ms"))
    return out.select("tool", "project_code", "status", F.col("window.start").alias("bucket_hour"), "call_count", "latency_sum_ms", "latency_max_ms")


def sliding_rate(events: DataFrame, width: str = "60 seconds", step: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "events")


def first_contents(files: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Each (path, content_hash) once within the watermark."""
    return files.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(["path", "content_hash"])


def debounce_events(events: list[tuple[float, str]], cooldown: float) -> list[tuple[float, str]]:
    """Leading edge at once, one trailing edge after the cooldown if more came; a delete replaces what waits.

    events: (seconds, kind) in order; the result likewise. The pure form of the stateful stream.
    """
    out: list[tuple[float, str]] = []
    until, waiting = -1.0, ""
    for t, kind in events:
        if waiting and t >= until:
            out.append((until, waiting))
            until, waiting = until + cooldown, ""
        if t >= until:
            out.append((t, kind))
            until = t + cooldown
        else:
            waiting = "delete" if "delete" in (kind, waiting) and kind != "create" else kind
    if waiting:
        out.append((until, waiting))
    return out


def debounce_step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState, cooldown_ms: int) -> Iterator[pd.DataFrame]:
    """One call for a path: its state is what waits (empty for nothing) and when the cooldown ends. A trailing edge begins a new cooldown."""
    rows: list[tuple[str, str, str]] = []
    waiting, until = state.get if state.exists else ("", -1)
    now = state.getCurrentProcessingTimeMs()
    if state.hasTimedOut:
        if not waiting:
            state.remove()
            yield pd.DataFrame([], columns=["path", "kind", "edge"])
            return
        rows.append((key[0], waiting, "trailing"))
        waiting, until = "", now + cooldown_ms
    else:
        for b in batches:
            for kind in b.sort_values("ts")["kind"]:
                if now >= until:
                    if waiting:
                        rows.append((key[0], waiting, "trailing"))
                        waiting, until = "delete" if kind == "delete" else kind, now + cooldown_ms
                        continue
                    rows.append((key[0], kind, "leading"))
                    until = now + cooldown_ms
                else:
                    waiting = "delete" if "delete" in (kind, waiting) and kind != "create" else kind
    state.update((waiting, until))
    state.setTimeoutDuration(max(1, until - now))
    yield pd.DataFrame(rows, columns=["path", "kind", "edge"])


def debounce(changes: DataFrame, cooldown_ms: int = 500) -> DataFrame:
    """The stateful stream: changes(path, kind, ts) to path, kind, edge (leading or trailing)."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return debounce_step(key, batches, state, cooldown_ms)

    return changes.groupBy("path").applyInPandasWithState(step, "path string, kind string, edge string", "waiting string, until long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_stream(stream: DataFrame, table: str, key: list[str], at: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream into a versioned table, one version per micro-batch; a repeated batch changes nothing."""
    w = stream.writeStream.foreachBatch(lambda df, _: upsert(df.sparkSession, table, df, key, at)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
