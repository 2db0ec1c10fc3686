"""Exact duplicates by a tree-merge of sorted digest runs.

1. Every row is reduced to a *digest row*: SHA-256 of the text without white
   space, an independent 64-bit check hash, the number of code points and the
   id.  The texts themselves are never shuffled.
2. Each Arrow batch of digest rows becomes a sorted run with one entry per
   digest: the winner so far (most code points, then smallest id) and a count.
3. Runs meet in rounds.  In each round, ``fan_in`` neighbouring runs (a power of
   two: so many binomial levels at once) of one digest shard are merged by a
   multiway merge; only entries whose check hash agrees as well are united, and
   the winner is verified again at every level.  Shards are ranges of the
   digest, so a group never holds more than its shard, however many copies a
   text has: a copy group is one entry per run.
4. The surviving entries are joined to the digest rows.

Nulls count as empty texts.  Rows with a null id take part; such an id loses
against every other.  Rows repeated under one id are copies of each other and
share their fate.  Empty tables give empty results.  Only the two named columns
are read, so extra columns may have any names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, unique_join, write_shared

SPACE = b" \t\n\x0b\x0c\r"
DIGEST = "doc_id long, n_chars long, digest binary"
RUN = "shard long, run long, digest binary, keep_n long, keep_id long, group_size long"


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, code points, SHA-256 and 64-bit check as 40 bytes)."""
    for batch in batches:
        lengths, keys = [], []
        for raw in batch.column(1).cast(pa.binary()).to_pylist():
            raw = raw or b""
            bare = raw.translate(None, SPACE)
            lengths.append(len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace")))
            keys.append(hashlib.sha256(bare).digest() + xxhash.xxh64_digest(bare))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "n_chars", "digest"])


def _rank(n: int, doc_id: int | None) -> tuple:
    """Orders candidates of one digest: most code points, then smallest id, null ids last."""
    return (-n, doc_id is None, doc_id or 0)


def _run_of(rows: Iterable[tuple]) -> list[tuple]:
    """Sorted entries (digest, n, id, count), one per digest; the input must be sorted by digest."""
    out: list[tuple] = []
    for key, n, doc_id, count in rows:
        if out and out[-1][0] == key:
            _, held_n, held_id, held = out[-1]
            best = min((held_n, held_id), (n, doc_id), key=lambda x: _rank(*x))
            out[-1] = (key, *best, held + count)
        else:
            out.append((key, n, doc_id, count))
    return out


def _run_batch(shard: list[int], run: list[int], entries: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*entries, strict=True)) if entries else [[], [], [], []]
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
    arrays = [pa.array(shard, pa.int64()), pa.array(run, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, ["shard", "run", "digest", "keep_n", "keep_id", "group_size"])


def _first_runs(shards: int):
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, keys, part = (c.to_pylist() for c in batch.columns)
            entries = _run_of(sorted(zip(keys, lengths, ids, [1] * len(ids), strict=True), key=lambda x: x[0]))
            yield _run_batch([int.from_bytes(e[0][:8], "big") * shards >> 64 for e in entries], [part[0]] * len(entries) if part else [], entries)

    return build


def _merge(table: pa.Table) -> pa.Table:
    """Multiway merge of the runs in one group, whose place is the merged run's number; entries of a run arrive in any order."""
    shard, run, *rest, place = (c.to_pylist() for c in table.columns)
    runs: dict[int, list[tuple]] = {}
    for r, entry in zip(run, zip(*rest, strict=True), strict=True):
        runs.setdefault(r, []).append(entry)
    for entries in runs.values():
        entries.sort(key=lambda e: e[0])
    merged = _run_of(heapq.merge(*runs.values(), key=lambda e: e[0]))
    return pa.Table.from_batches([_run_batch([shard[0]] * len(merged), [place[0]] * len(merged), merged)])


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, code points of the text, 40-byte digest of the bare text."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_digests, DIGEST)


def merge_runs(digests: DataFrame, fan_in: int = 8, shard_rows: int = 400_000) -> DataFrame:
    """Entries (digest, keep_n, keep_id, group_size), one per distinct digest, by tree-merge."""
    spark = digests.sparkSession
    total = digests.count()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_rows))
    part = F.spark_partition_id().cast("long")
    runs = digests.select("doc_id", "n_chars", "digest", part.alias("part")).mapInArrow(_first_runs(shards), RUN)
    left = max(1, digests.rdd.getNumPartitions())
    while True:  # one round at least: it also unites the batches of one partition
        left = -(-left // fan_in)
        # the last round takes all that is left of a shard, whatever its numbers
        place = F.floor(F.col("run") / fan_in) if left > 1 else F.lit(0).cast("long")
        runs = runs.withColumn("place", place).groupBy("shard", "place").applyInArrow(_merge, RUN)
        if left == 1:
            return runs.select("digest", "keep_n", "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, dropped ones too.

    Returns doc_id, keep_id, group_size, kept, text_sha256 (of the text without
    white space) and n_chars (code points of the whole text).
    """
    digests = write_shared(digest_rows(docs, id_col, text_col), "digests")
    groups = write_shared(merge_runs(digests).select("digest", "keep_id", "group_size"), "groups")
    # a text's copies may be a third of all rows: such digests are split
    joined = unique_join(digests, groups, ["digest"], ["doc_id", "n_chars"], sizes=groups.select("digest", F.col("group_size").alias("n")))
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"),
        "n_chars",
    )
