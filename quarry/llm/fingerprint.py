"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Three triplet shapes slide over the UTF-8 bytes of the whole text (adjacent,
and two that leave one byte out).  Each hashed triplet counts into one of 256
buckets; a bucket is written as the quartile that its count lies in (two bits),
and a logarithmic length code comes first.  ``likeness`` turns the bounded
difference of two digests (sum of bucket distances, opposite quartiles counting
double, plus the length codes' distance) into a number from 0 to 1.

Equal texts have equal digests; null counts as empty, and the empty text has
the all-zero digest.  Buckets of equal count get the same quartile, the lowest
that holds one of them.  An empty table gives an empty result.  Texts of one or two bytes count as they are padded with
zero bytes.  ``edited_pairs`` needs each document's successor by ascending id:
documents are dealt by ranges whose borders are ids that occur, so a range
needs just one foreign row, the head of the next range, and each text is
shuffled once (heads twice).  Rows without an id have no place in that order:
for them the next document is empty.  Rows repeated under one id follow in the
order of their texts.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches

BUCKETS = 256
#: The difference at which two digests count as wholly unlike: what two independent ones have on
#: average (1.25 for each bucket, and 0.375 more as opposite quartiles count double).
BOUND = 13 * BUCKETS // 8
LENGTH_BASE, LENGTH_WEIGHT = 1.25, 4
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_RANDOM = np.random.default_rng(20240229)
_TABLES = [[_RANDOM.permutation(256).astype(np.uint8) for _ in range(3)] for _ in SHAPES]


def bucket_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Quartile codes (n x 256, values 0 to 3) and length codes (n) of the texts."""
    n = len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    padded = [t if not 0 < len(t) < 3 else t.ljust(3, b"\0") for t in texts]
    data = np.frombuffer(b"".join(padded), np.uint8)
    sizes = np.array([len(t) for t in padded], np.int64)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    counts = np.zeros(n * BUCKETS, np.int64)
    for shape, tables in zip(SHAPES, _TABLES, strict=True):
        reach = shape[-1]
        if len(data) <= reach:
            continue
        hashed = tables[0][data[:-reach]] ^ tables[1][data[shape[1] : len(data) - reach + shape[1]]] ^ tables[2][data[reach:]]
        within = row[:-reach] == row[reach:]
        counts += np.bincount(row[:-reach][within].astype(np.int64) * BUCKETS + hashed[within], minlength=n * BUCKETS)
    counts = counts.reshape(n, BUCKETS)
    ordered = np.sort(counts, axis=1)
    codes = np.zeros((n, BUCKETS), np.uint8)
    for quarter in (1, 2, 3):
        codes += counts > ordered[:, quarter * BUCKETS // 4 - 1, None]
    return codes, np.round(np.log1p(lengths) / np.log(LENGTH_BASE)).astype(np.uint8)


def hex_digests(codes: np.ndarray, lengths: np.ndarray) -> list[str]:
    """Two hex digits of length code, then the buckets, four to a byte."""
    packed = codes[:, 0::4] << 6 | codes[:, 1::4] << 4 | codes[:, 2::4] << 2 | codes[:, 3::4]
    return [bytes([k]).hex() + row.tobytes().hex() for k, row in zip(lengths.tolist(), packed, strict=True)]


def parse(digest: str) -> tuple[np.ndarray, int]:
    """The quartile codes and the length code of a digest."""
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    return np.stack([raw[1:] >> s & 3 for s in (6, 4, 2, 0)], axis=1).reshape(-1), int(raw[0])


def likeness(a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 at or beyond the bound; row by row."""
    apart = np.abs(a.astype(np.int16) - b.astype(np.int16))
    apart += 3 * (apart == 3)
    score = apart.sum(axis=1) + LENGTH_WEIGHT * np.abs(length_a.astype(np.int64) - length_b.astype(np.int64))
    return 1.0 - np.minimum(score, BOUND) / BOUND


def compare(a: str, b: str) -> float:
    """Likeness of two digests as text."""
    (x, m), (y, n) = parse(a), parse(b)
    return float(likeness(x[None], y[None], np.array([m]), np.array([n]))[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for each row; no rows move."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quarry.llm.common import steps

        for batch in steps(batches):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hex_digests(*bucket_codes(texts)), pa.string())], ["doc_id", "fingerprint"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: Bytes of text that one range should hold.
RANGE_BYTES = 32 << 20


def _range_heads(docs: DataFrame) -> tuple[list[int], int]:
    """First ids of ranges of about equal numbers of rows, all of which occur in the table, and the number of partitions.

    There are as many as the texts' bytes ask for, at least one for each shuffle partition.
    """
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("least")).first()
    parts = max(least, -(-(size["bytes"] or 0) // RANGE_BYTES))
    if size["least"] is None:
        return [], parts
    probs = [k / parts for k in range(1, parts)] or [0.5]
    cuts = docs.agg(F.percentile_approx("doc_id", probs, min(2_000_000, max(10_000, 20 * parts)))).first()[0]
    return sorted({size["least"], *cuts}), parts


def _keys_of(spark: SparkSession, parts: int) -> np.ndarray:
    """For each range a number that the shuffle's hash sends to the partition of that range alone."""
    tries = int(parts * (np.log(parts + 1) + 8)) + 1
    place = F.pmod(F.hash("id"), F.lit(parts))
    found = spark.range(tries).groupBy(place.alias("part")).agg(F.min("id").alias("key")).toArrow()
    keys = np.arange(tries, tries + parts)  # a range without one, all but never, shares a partition
    keys[found["part"].to_numpy()] = found["key"].to_numpy()
    return keys


def _deal(heads: list[int], keys: np.ndarray):
    """Adds the key of each row's range, and once more each range's head as the tail of the range before."""
    edges = np.array(heads, np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            # rows without an id go round all partitions
            part = np.where(known, np.maximum(np.searchsorted(edges, values, side="right") - 1, 0), np.arange(len(values)) % len(keys))
            names = ["doc_id", "text", "part", "tail"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys[part]), pa.array(np.zeros(len(part), bool))], names)
            if len(edges) and (at := np.flatnonzero(known & np.isin(values, edges))).size:
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(keys[(part[at] - 1) % len(edges)]), pa.array(np.ones(len(at), bool))], names)

    return run


def _score(rows: list[tuple], following: list[int]) -> pa.RecordBatch:
    """Results of ``rows[i]`` with its successor ``rows[following[i]]``."""
    texts = [t for _, t in rows]
    edited = []
    for k, nxt in enumerate(following):
        n = len(texts[k])
        edited.append((texts[k][: n - n // 4] + texts[nxt][: n // 4]).encode())
    codes, lengths = bucket_codes([t.encode() for t in texts])
    edited_codes, edited_lengths = bucket_codes(edited)
    n, nxt = len(following), np.array(following, np.int64)
    columns = [
        pa.array([r[0] for r in rows[:n]], pa.int64()),
        pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        pa.array(hex_digests(codes[:n], lengths[:n]), pa.string()),
        pa.array(hex_digests(edited_codes, edited_lengths), pa.string()),
        pa.array(likeness(codes[:n], edited_codes, lengths[:n], edited_lengths), pa.float64()),
        pa.array(likeness(codes[:n], codes[nxt], lengths[:n], lengths[nxt]), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _EDITED.split(", ")])


def _pair_up(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, then id, the next range's head last: pairs every row with the next one."""
    held: list[tuple] = []  # rows whose successor may still come
    nameless: list[tuple] = []
    at, size, nameless_size = None, 0, 0

    def alone() -> pa.RecordBatch:
        return _score([*nameless, (None, "")], [len(nameless)] * len(nameless))

    for batch in batches:
        for doc_id, text, part, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = (doc_id, text or "")
            if doc_id is None:
                nameless.append(row)
                nameless_size += len(row[1])
                if nameless_size >= limit:
                    yield alone()
                    nameless, nameless_size = [], 0
                continue
            if part != at:
                held, at, size = [], part, 0
            if tail and not held:
                continue  # a head that occurs repeatedly: the first one was the successor
            held.append(row)
            size += len(row[1])
            if tail or size >= limit and len(held) > 1:
                yield _score(held, list(range(1, len(held))))
                held, size = [] if tail else held[-1:], len(row[1])
    if nameless:
        yield alone()


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    The edited text replaces the last quarter of the code points by as many of
    the next document's first ones (or all that it has).
    """
    spark = docs.sparkSession
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    heads, parts = _range_heads(rows)
    dealt = rows.mapInArrow(_deal(heads, _keys_of(spark, parts)), "doc_id long, text string, part long, tail boolean")
    ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", "tail", F.asc_nulls_last("doc_id"), "text")
    return ordered.mapInArrow(_pair_up, _EDITED)
