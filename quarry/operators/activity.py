"""State that activity leaves behind: per file, per session, recent lists, debounced triggers.

Input: session_id, file_path, activity (edit, open or close), ts, time_spent and event_id (the order at equal times).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_state(events: DataFrame, by: list[str]) -> DataFrame:
    """Last edit and open, their numbers and the time spent, for each key of ``by``."""
    kind = lambda k, value: F.when(F.col("activity") == k, value)
    return events.groupBy(*by).agg(
        F.max(kind("edit", F.col("ts"))).alias("last_edited"),
        F.max(kind("open", F.col("ts"))).alias("last_opened"),
        F.count_if(F.col("activity") == "edit").alias("edit_frequency"),
        F.count_if(F.col("activity") == "open").alias("open_frequency"),
        F.sum(kind("close", F.col("time_spent"))).alias("time_spent"),
    )


def recent_files(events: DataFrame, most: int = 10) -> DataFrame:
    """(session_id, file_path, position): the files touched last in each session, position 0 first."""
    last = events.groupBy("session_id", "file_path").agg(F.max(F.struct("ts", "event_id")).alias("at"))
    order = Window.partitionBy("session_id").orderBy(F.desc("at"))
    return last.withColumn("position", (F.row_number().over(order) - 1).cast("long")).where(F.col("position") < most).select("session_id", "file_path", "position")


def newest(events: DataFrame, by: str, most: int) -> DataFrame:
    """The newest ``most`` events of each key: a bounded log."""
    order = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def evict_oldest(sessions: DataFrame, capacity: int, share: float = 0.2) -> DataFrame:
    """Sessions that stay: all while below ``capacity``, else all but the oldest ``share`` of the capacity."""
    gone = int(capacity * share)
    if sessions.count() < capacity:
        return sessions
    oldest = sessions.orderBy("ts", "session_id").limit(gone)
    return sessions.join(oldest.select("session_id"), "session_id", "left_anti")


def clean_up(state: DataFrame, now: Column, max_age_days: int = 30) -> DataFrame:
    """Drops files neither edited nor opened since the cutoff that were never edited."""
    cutoff = now - F.expr(f"INTERVAL {max_age_days} DAYS")
    old = lambda c: F.coalesce(F.col(c) < cutoff, F.lit(True))
    return state.where(~(old("last_edited") & old("last_opened") & (F.col("edit_frequency") == 0)))


def _leading_edges(quiet: int):
    """Of rows sorted by key and time (microseconds) those that fire; one key's last trigger is all that is held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            times, fired = batch.column(2).to_numpy(), []
            edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                key = (batch.column(0)[a].as_py(),)
                at = a if key != held else a + int(np.searchsorted(times[a:b], last + quiet, side="right"))
                held = key
                while at < b:
                    fired.append(at)
                    last = times[at]
                    at += int(np.searchsorted(times[at:b], last + quiet, side="right"))
            yield batch.select([0, 1]).take(pa.array(fired, pa.int64()))

    return run


def debounced(events: DataFrame, by: str, quiet_seconds: int = 5) -> DataFrame:
    """(by, ts): leading-edge triggers; one fires only if more than ``quiet_seconds`` passed since the last that fired.

    Whether an event fires depends on all before it, so a key's events pass one
    task in order; they stream through a sort that may spill, and only the last
    trigger is held, however long a key goes without a pause.
    """
    timed = events.select(by, "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("_t")).where("_t is not null")
    ordered = timed.repartition(by).sortWithinPartitions(by, "_t")
    kinds = dict(timed.dtypes)
    return ordered.mapInArrow(_leading_edges(quiet_seconds * 1_000_000), f"{by} {kinds[by]}, ts {kinds['ts']}")


def session_counts(events: DataFrame, by: str = "session_id") -> DataFrame:
    """Per key and event the counts so far, as a cache entry would carry them from one question to the next."""
    order = Window.partitionBy(by).orderBy("ts", "event_id")
    return events.withColumn("turn", F.row_number().over(order).cast("long")).withColumn("previous_event", F.lag("event_id").over(order))
