"""Helpers that the operators of this subpackage share.

Texts cross into Python as Arrow batches and stay UTF-8 bytes for as long as
possible: one batch is viewed as one byte array plus offsets, so hashing and
counting run as array operations over many documents at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import BATCH_BYTES, bounded_batches, write_scratch  # noqa: F401 - the operators take their bounds from here

#: Bytes of text that one array step handles; a longer document is a step of its own.
STEP_BYTES = 1 << 20


def write_shared(df: DataFrame, label: str) -> DataFrame:
    """The table, written to the shared folder and read again (see ``write_scratch``)."""
    return write_scratch(df, label)


#: At most so many keys count as hot, whatever the table: a key is hot beyond this share of the rows.
HOT_KEYS = 10_000


def unique_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner", sizes: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """``left`` joined to ``right``, which has one row a key, though one key may hold a third of ``left``.

    ``left`` must be a written table, as it is counted first, unless ``rows`` gives its count.  Keys with more than
    max(512, rows / ``HOT_KEYS``) rows are split by a hash of the ``spread`` columns, and
    their row of ``right`` is repeated once a part.  At most ``HOT_KEYS`` keys can
    be that frequent, so their list is broadcast at every size.  ``sizes`` may give
    the rows of each key as (keys, n); they are counted otherwise.
    """
    limit = max(512, (left.count() if rows is None else rows) // HOT_KEYS)
    sizes = left.groupBy(*keys).agg(F.count("*").alias("n")) if sizes is None else sizes
    hot = F.broadcast(sizes.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("_parts")))
    part = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")), F.lit(0)).cast("int")
    dealt = left.join(hot, keys, "left").withColumn("_part", part).drop("_parts")
    copies = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies.hint("merge"), [*keys, "_part"], how).drop("_part")


def crc_remainder(id_col: str, divisor: int) -> Column:
    """``crc32(id as text) mod divisor``; a null id counts as remainder -1 (never held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor, F.lit(-1))


def steps(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = byte_view(batch.column(batch.schema.get_field_index(text)))[1][1:]
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column) or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - (ends[0] if len(ends) else 0)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def texts_of(column: pa.Array) -> list[str]:
    """The rows as Python strings (null: empty)."""
    return [x or "" for x in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur-style), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Odd base of the polynomial word hash modulo 2**64, and its inverse.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


#: Powers that are kept between calls; those of longer texts are made anew.
_KEPT_POWERS = (1 << 20) + 1


def _powers(n: int, which: int) -> np.ndarray:
    """The first n powers of the base (0) or of its inverse (1)."""
    if len(_POWERS[which]) < n:
        made = np.full(max(n, min(2 * n, _KEPT_POWERS)), (_BASE, _INVERSE)[which] & ((1 << 64) - 1), np.uint64)
        made[0] = 1
        np.multiply.accumulate(made, out=made)
        if n > _KEPT_POWERS:
            return made[:n]
        _POWERS[which] = made
    return _POWERS[which][:n]


def byte_classes(members: Iterable[int], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Tables over the 256 bytes: is it part of a word, and its value once A-Z is lower-cased."""
    inside = np.zeros(256, bool)
    inside[list(members)] = True
    value = np.arange(256, dtype=np.uint8)
    if lower:
        value[65:91] += 32
    return inside, value


#: Words between white space (space and the five controls from tab to carriage return).
SPACE_WORDS = byte_classes(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: Words of ASCII letters and digits and of every byte of longer code points.
LETTER_WORDS = byte_classes({*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)})


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all maximal runs of word bytes, and the row that each lies in.

    A run never crosses a row's end.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    flag = np.zeros(len(data) + 1, bool)
    flag[:-1] = inside[data]
    begin = flag[:-1].copy()
    begin[1:] &= ~flag[:-2]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    begin[cuts] |= flag[cuts]
    end = flag[:-1] & ~flag[1:]
    before = cuts[cuts > 0] - 1
    end[before] |= flag[before]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def prefix_hashes(data: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Cumulative polynomial sums; ``span_hashes`` reads any span's hash off them."""
    total = np.zeros(len(data) + 1, np.uint64)
    terms = total[1:]
    terms[:] = value[data]
    terms += np.uint64(1)
    terms *= _powers(len(data) + 1, 0)[: len(data)]
    np.cumsum(terms, out=terms)
    return total


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand."""
    inverse = _powers(len(prefix), 1)
    return mix64((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def anti_join_ids(docs: DataFrame, gone: DataFrame, key: str = "doc_id", limit: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone``; rows with a null key stay.

    The ids are broadcast only after a count has shown at most ``limit`` of
    them (16 MB or so); beyond it both sides are shuffled.
    """
    gone = gone.select(key).where(F.col(key).isNotNull()).distinct()
    return docs.join(F.broadcast(gone) if gone.count() <= limit else gone.hint("merge"), key, "left_anti").select(*docs.columns)


def semi_join_ids(docs: DataFrame, wanted: DataFrame, key: str, limit: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is in ``wanted[key]`` (distinct ids).

    The ids are broadcast only after a count has shown at most ``limit`` of
    them; beyond it both sides are shuffled.
    """
    ids = wanted.select(F.col(key).alias("doc_id"))
    return docs.join(F.broadcast(ids) if ids.count() <= limit else ids.hint("merge"), "doc_id", "left_semi").select(*docs.columns)


def keep_marked(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``docs`` without the ids that ``marked`` (doc_id, kept) drops.

    An id is dropped if none of its rows is kept.  Of rows that repeat under one
    id with the same text one stays.  Rows with a null id cannot be named, so
    their texts decide: of those with the same text one stays, and none if a row with an id has that text.
    """
    marked = write_shared(marked.select("doc_id", "kept"), "marked")
    by_id = marked.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    left = anti_join_ids(docs, by_id.where("not kept"))
    repeated = by_id.where("kept and n > 1").select("doc_id")
    if not repeated.isEmpty():
        left = anti_join_ids(left, repeated).unionByName(semi_join_ids(left, repeated, "doc_id").dropDuplicates(["doc_id", "text"]))
    if marked.where("doc_id is null").isEmpty():
        return left
    named = docs.where("doc_id is not null").select(F.sha2("text", 256).alias("_text"))
    nameless = docs.where("doc_id is null").withColumn("_text", F.sha2("text", 256)).dropDuplicates(["_text"])
    return left.where("doc_id is not null").unionByName(nameless.join(named, "_text", "left_anti").select(*docs.columns))
