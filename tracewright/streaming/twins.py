"""Structured Streaming twins: one pass over arriving logs, late rows bounded by watermarks, state by session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """V1: lines of the logs that arrive in a folder, parsed; lines that are no object are left out."""
    lines = spark.readStream.text(folder, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    return lines.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("record")).filter("record is not null")


def once(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """V4: rows whose keys have come before within the delay are dropped; ts is the event time."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def idle_sessions(events: DataFrame, gap: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """V2: a user's events up to a gap as one session window; works on tables as on streams."""
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    found = events.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    return found.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "size")


def monthly_counts(events: DataFrame) -> DataFrame:
    """V5, V7: running counts by calendar month and model, for update mode."""
    return events.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "model").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def _chains(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The running failure chain of one session: its length and first idx are all that is kept."""
    length, start = state.get if state.exists else (0, -1)
    out = []
    if not state.hasTimedOut:
        rows = pd.concat(list(frames)).sort_values("idx", ignore_index=True)
        result, ok = rows.kind == "tool_result", rows.ok.fillna(False).astype(bool)
        ends, failed = (rows.kind == "user_msg") | (result & ok), result & ~ok
        # The chain that runs on from before is island 0; each end begins the next.
        island = ends.cumsum()
        found = rows[failed].groupby(island[failed]).idx.agg(["size", "min"]).reindex(range(int(island.iloc[-1]) + 1))
        found["size"] = found["size"].fillna(0).astype(int)
        if length:
            found.loc[0] = (found["size"][0] + length, start)
        closed = found.iloc[:-1]
        out = [(key[0], int(r["min"]), int(r["size"])) for _, r in closed[closed["size"] >= 3].iterrows()]
        length = int(found["size"].iloc[-1])
        start = int(found["min"].iloc[-1]) if length else -1
    if state.hasTimedOut:
        if length >= 3:
            out.append((key[0], start, length))
        state.remove()
    else:
        state.update((length, int(start)))
        state.setTimeoutDuration(3_600_000)
    yield pd.DataFrame(out, columns=["session_id", "first_idx", "failures"])


def failure_chains(events: DataFrame) -> DataFrame:
    """V3, V6: failure chains as they end, or when a session has been silent for an hour.

    Takes a stream of session_id, idx, kind, ok whose rows of a session come in order of idx between batches."""
    rows = events.select("session_id", "idx", "kind", "ok")
    return rows.groupBy("session_id").applyInPandasWithState(
        _chains, "session_id long, first_idx long, failures long", "length long, start long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
