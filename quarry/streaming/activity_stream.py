"""Structured Streaming forms of the stateful operators.

``file_state_stream`` and ``debounce_stream`` keep keyed state; ``refresh``
re-indexes changed files with an exactly-once upsert per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.sources.chunk_table import ChunkTable


def file_state_stream(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Counts and last times per session and file in hourly windows; late events beyond the watermark are left out."""
    timed = events.withWatermark("ts", watermark)
    return timed.groupBy(F.window("ts", "1 hour"), "session_id", "file_path").agg(
        F.count_if(F.col("activity") == "edit").alias("edits"),
        F.count_if(F.col("activity") == "open").alias("opens"),
        F.max("ts").alias("last_seen"),
    )


def debounce_stream(events: DataFrame, quiet_seconds: float = 5.0) -> DataFrame:
    """(session_id, ts): leading-edge triggers, at most one in ``quiet_seconds`` a session, across micro-batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        times = sorted(t for frame in frames for t in frame["ts"])
        fired = []
        for t in times:
            now = t.timestamp()
            if now - last > quiet_seconds:
                last = now
                fired.append(t)
        state.update((last,))
        yield pd.DataFrame({"session_id": [key[0]] * len(fired), "ts": pd.Series(fired, dtype="datetime64[ns]")})

    return events.select("session_id", F.col("ts").cast("timestamp").alias("ts")).groupBy("session_id").applyInPandasWithState(step, "session_id long, ts timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def session_cache_stream(questions: DataFrame) -> DataFrame:
    """(session_id, turns, last_query, previous_query): what a session cache holds after each micro-batch.

    ``questions`` has session_id, turn and query.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, last, previous = state.get if state.exists else (0, None, None)
        for row in sorted((r for frame in frames for r in frame.itertuples(index=False)), key=lambda r: r.turn):
            turns, last, previous = turns + 1, row.query, last
        state.update((turns, last, previous))
        yield pd.DataFrame({"session_id": [key[0]], "turns": [turns], "last_query": [last], "previous_query": [previous]})

    return questions.groupBy("session_id").applyInPandasWithState(step, "session_id long, turns long, last_query string, previous_query string", "turns long, last string, previous string", "update", GroupStateTimeout.NoTimeout)


def refresh(changed_files: DataFrame, table: ChunkTable, chunk_and_embed: Callable[[DataFrame], DataFrame], checkpoint: str, every: str = "5 seconds"):
    """Starts a query that replaces the chunks of changed files, one micro-batch at a time.

    The trigger's interval debounces bursts of changes.  A file's old chunks go
    with its new ones' arrival; replacing may be repeated, so a batch that is run
    again after a failure changes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        table.replace_files(chunk_and_embed(batch))

    return changed_files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
