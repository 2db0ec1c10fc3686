"""Retrievals over vectors with many scores that are equal or differ in the last digit only, against their SQL."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest

from quarry.operators import vector
from quarry.plans import catalog
from tests.test_oracles import rows_of


def in_order(metric, x, y):
    pairs = [(float(a), float(b)) for a, b in zip(x, y, strict=True)]
    total = aa = bb = 0.0
    for a, b in pairs:
        total += {"euclidean": (a - b) * (a - b), "manhattan": abs(a - b)}.get(metric, a * b)
        aa, bb = aa + a * a, bb + b * b
    if metric == "cosine":
        return total / (math.sqrt(aa) * math.sqrt(bb)) if aa * bb else math.nan
    return total if metric == "dot_product" else -math.sqrt(total) if metric == "euclidean" else -total


@pytest.mark.parametrize("metric", sorted(vector.METRICS))
def test_batch_scores_are_sums_in_order(metric):
    """To the last bit, whatever the steps: copies tie, and permuted and scaled vectors are ordered as in plain sums."""
    pick = np.random.default_rng(3)
    base = np.round(pick.normal(size=(30, 16)), 1).astype(np.float32)
    rows = np.concatenate([base[pick.integers(0, 30, 400)], np.zeros((2, 16), np.float32), base * 3, base[:, ::-1], base[:, pick.permutation(16)], pick.normal(size=(700, 16)).astype(np.float32)])
    names = [int(n) for n in pick.permutation(len(rows))]
    asked = np.concatenate([base[:9], np.zeros((1, 16))]).astype(np.float64)
    scored = [sorted(((-s, names[k]) for k, r in enumerate(rows) if not math.isnan(s := in_order(metric, r, q)))) for q in asked]
    batches = [pa.RecordBatch.from_arrays([pa.array(names[at : at + 1050]), pa.array([r.tolist() for r in rows[at : at + 1050]], pa.list_(pa.float32()))], ["id", "embedding"]) for at in range(0, len(rows), 1050)]
    for k in (1, 7, 2000):
        found = {n: [] for n in range(len(asked))}
        for batch in vector._nearest(asked, np.arange(len(asked)), k, metric, pa.int64(), 4)(batches):
            for r in batch.to_pylist():
                found[r["query_id"]].append((-r["score"], r["id"]))
        assert [sorted(f) for f in found.values()] == [s[:k] for s in scored]


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """1,500 chunks and 30 questions; vectors are made of three values, so many scores are nearly equal."""
    folder, pick, n = tmp_path_factory.mktemp("tied"), np.random.default_rng(11), 1500
    words = ["class", "def", "Data", "Find", "Node", "process", "words", "tokens", "example", "test", "usage", "error"]
    texts = [" ".join(pick.choice(words, pick.integers(1, 40))) for _ in range(n)]
    duck = duckdb.connect()
    tables = {
        "documents": pa.table({"doc_id": range(n), "text": texts, "lang": ["en"] * n, "source": [f"s{k % 20}" for k in range(n)], "n_chars": [len(t) for t in texts]}),
        "embeddings": pa.table({"vec_id": range(n), "label": [0] * n, "embedding": pa.array(pick.choice([-0.1, 0.1, 0.3], (n, 64)).tolist(), pa.list_(pa.float32()))}),
        "conversations": pa.table({"conv_id": range(30), "turn": [0] * 30, "role": ["user"] * 30, "text": [" ".join(pick.choice(words, 4)) for _ in range(30)]}),
    }
    for name, made in tables.items():
        pa.parquet.write_table(made, f"{folder}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), duck


@pytest.mark.parametrize("name", ["flagship_context", "r5_multi_stage_retrieval"])
def test_retrievals_keep_the_order_of_their_sql(spark, tied, name):
    folder, duck = tied
    frame = catalog.QUERIES[name](spark, folder)
    expected = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in expected.description]
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(names, expected.fetchall())


@pytest.mark.parametrize("name", ["x2_expansion_aggressive", "x2_expansion_conservative", "x2_expansion_moderate"])
def test_chosen_chunks_do_not_hang_on_a_product_s_last_digit(spark, tmp_path, name):
    """98 vectors with the same values in other places are equally near to both questions, but for the last digit of the sums."""
    pick, n, duck = np.random.default_rng(4), 100, duckdb.connect()
    values = (np.abs(pick.normal(size=64)) + 0.1).astype(np.float32)
    vectors = [[0.5] * 64 if k % 50 == 0 else pick.permutation(values).tolist() for k in range(n)]
    tables = {
        "documents": pa.table({"doc_id": range(n), "text": [f"words of text {k}" for k in range(n)], "lang": ["en"] * n, "source": [f"s{k % 20}" for k in range(n)], "n_chars": [0] * n}),
        "embeddings": pa.table({"vec_id": range(n), "label": [0] * n, "embedding": pa.array(vectors, pa.list_(pa.float32()))}),
        "conversations": pa.table({"conv_id": [0, 1], "turn": [0, 0], "role": ["user"] * 2, "text": ["find process", "usage error"]}),
    }
    for table, made in tables.items():
        pa.parquet.write_table(made, f"{tmp_path}/{table}.parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    frame = catalog.QUERIES[name](spark, str(tmp_path))
    expected = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in expected.description]
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(names, expected.fetchall())
