"""Exact vector search: metrics as column expressions, filters, single and batched top-k."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import write_scratch


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def literal_vector(values: Iterable[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


#: How each metric scores: higher is nearer.
METRICS = {"cosine": cosine, "dot_product": dot, "euclidean": lambda a, b: -euclidean(a, b), "manhattan": lambda a, b: -manhattan(a, b)}


def matches(filters: dict) -> Column:
    """A filter dict as a predicate: scalars are equalities, dicts ranges; null operands do not match."""
    found = F.lit(True)
    tests = {"$gte": lambda c, v: c >= v, "$lte": lambda c, v: c <= v, "$gt": lambda c, v: c > v, "$lt": lambda c, v: c < v}
    for name, wanted in filters.items():
        if isinstance(wanted, dict):
            for sign, value in wanted.items():
                if sign in tests:
                    found = found & tests[sign](F.col(name), F.lit(value))
        else:
            found = found & (F.col(name) == F.lit(wanted))
    return F.coalesce(found, F.lit(False))


def top_k(vectors: DataFrame, query: Iterable[float], k: int, metric: str = "cosine", filters: dict | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest rows to one query, ties by key; filters apply before the search."""
    rows = vectors.where(matches(filters)) if filters else vectors
    scored = rows.where(F.col(vector).isNotNull()).withColumn("score", METRICS[metric](F.col(vector), literal_vector(query)))
    return scored.where("score is not null and not isnan(score)").orderBy(F.desc("score"), F.asc(key)).limit(k)


def post_filtered_top_k(vectors: DataFrame, query: Iterable[float], k: int, filters: dict, over_fetch: int = 3, **options) -> DataFrame:
    """Filters only the ``over_fetch`` * k nearest rows: may return fewer than k."""
    near = top_k(vectors, query, over_fetch * k, **options)
    return near.where(matches(filters)).orderBy(F.desc("score"), F.asc(options.get("key", "vec_id"))).limit(k)


#: Bytes of question vectors that one scan of the vectors serves, and questions and rows scored at once.
SCAN_BYTES, BLOCK, STEP_ROWS = 64 << 20, 2048, 1_000
#: Pairs of a question and a row that are scored in order at once.
PAIRS = 1 << 14

#: The terms that each metric adds up.
_TERMS = {"cosine": np.multiply, "dot_product": np.multiply, "euclidean": lambda x, y: (x - y) * (x - y), "manhattan": lambda x, y: np.abs(x - y)}


def _in_order(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of ``x`` and ``y`` the sum of its terms from the first place to the last, as ``_sum`` and SQL add them."""
    total = np.zeros(len(x))
    for at in range(0, len(x), PAIRS):
        for term in np.ascontiguousarray(_TERMS[metric](x[at : at + PAIRS], y[at : at + PAIRS]).T):
            total[at : at + PAIRS] += term
    return total


def _nearest(queries: np.ndarray, ids: np.ndarray, k: int, metric: str, kind: pa.DataType, block: int):
    """The k best of each partition for each query, scored in blocks of queries.

    A matrix product's last digits depend on its shape and on the machine, which breaks or makes ties.  So it only
    finds the pairs that can be among the best within its error; these are scored again in order of the places.
    """
    slack = 4 * (queries.shape[1] + 4) * np.finfo(np.float64).eps

    def near(rows: np.ndarray, asked: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of queries x rows, and how far they may be off."""
        if metric in ("cosine", "dot_product"):
            found = asked @ rows.T
            return (found / scale, np.full((1, 1), slack)) if metric == "cosine" else (found, slack * scale)
        out = np.empty((len(asked), len(rows)))
        for j, q in enumerate(asked):
            out[j] = -(np.abs(rows - q).sum(axis=1) if metric == "manhattan" else np.sqrt(((rows - q) ** 2).sum(axis=1)))
        return out, slack * np.abs(out)

    def best_of(parts: list[tuple]) -> tuple:
        """Of (query, score, key) the k best of each query, and the score that the next one must reach."""
        row, best, keys = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((keys, -best, row))
        row, best, keys = row[order], best[order], keys[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        floor = np.full(block, -np.inf)
        floor[row[rank == k - 1]] = best[rank == k - 1]
        return (row[rank < k], best[rank < k], keys[rank < k]), floor

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [slice(at, at + block) for at in range(0, len(ids), block)]
        held: list[tuple | None] = [None] * len(blocks)
        length = np.sqrt(_in_order("dot_product", queries, queries))
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                rows = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                names = np.array(part.column(0).to_pylist())
                size = np.sqrt(_in_order("dot_product", rows, rows))
                if metric == "cosine":  # without length there is no angle
                    rows, names, size = rows[size != 0], names[size != 0], size[size != 0]
                if not len(rows):
                    continue
                for b, z in enumerate(blocks):
                    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                        scale = length[z][:, None] * size[None]
                        found, off = near(rows, queries[z], scale)
                        # k rows of this step reach ``least``, and k rows held so far ``floor``: no row below both errors can be among the best
                        low = np.where(np.isnan(found), -np.inf, found - off)
                        least = np.partition(low, -k, axis=1)[:, -k] if len(rows) >= k else np.full(len(low), -np.inf)
                        floor = held[b][1][: len(low)] if held[b] is not None else least
                        row, column = np.nonzero(~(found + off < np.maximum(least, floor)[:, None]))
                        best = np.empty(len(row))
                        for n in range(0, len(row), PAIRS):
                            pairs = slice(n, n + PAIRS)
                            best[pairs] = _in_order(metric, rows[column[pairs]], queries[z][row[pairs]])
                        if metric == "cosine":
                            best /= scale[row, column]
                        elif metric != "dot_product":
                            best = -(np.sqrt(best) if metric == "euclidean" else best)
                    fine = np.isfinite(best)
                    fresh = (row[fine], best[fine], names[column[fine]])
                    held[b] = best_of([fresh] if held[b] is None else [held[b][0], fresh])
        for z, kept in zip(blocks, held, strict=True):
            if kept is not None:
                row, best, keys = kept[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[z][row].tolist(), kind), pa.array(keys.tolist(), kind), pa.array(best)], ["query_id", "id", "score"])

    return run


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block: int = BLOCK, vector: str = "embedding", key: str = "vec_id", scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """(query_id, id, score, ord): the k nearest rows for every query, exact; keys are numbers or strings.

    One scan of the vectors serves ``scan_bytes`` of questions, which go out with
    its tasks and are scored in blocks by matrix products; each partition keeps k
    rows a question, so only queries x partitions x k rows are shuffled.  More
    questions are dealt into written parts, one scan each: the driver never
    holds more than one.
    """
    kind = "string" if dict(vectors.dtypes)[key] == "string" else "long"
    asked = queries.select(F.col(key).cast(kind).alias(key), vector).where(F.col(vector).isNotNull())
    size = asked.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("width")).first()
    parts = max(1, -(-size["n"] * (size["width"] or 0) * 8 // scan_bytes))
    if parts > 1:
        asked = write_scratch(asked.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts))), "questions")
    found = None
    for p in range(parts):
        here = (asked.where(F.col("_part") == p) if parts > 1 else asked).select(key, vector).toArrow()
        ids = np.array(here[key].to_pylist())
        matrix = np.array(here[vector].to_pylist(), np.float64).reshape(len(ids), -1)
        run = _nearest(matrix, ids, k, metric, pa.string() if kind == "string" else pa.int64(), block)
        part = vectors.select(F.col(key).cast(kind), vector).mapInArrow(run, f"query_id {kind}, id {kind}, score double")
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("ord", F.row_number().over(order).cast("long")).where(F.col("ord") <= k)
