"""Retrievals whose first user turn has no text, against their SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest

from quarry.plans import catalog
from tests.test_oracles import rows_of


@pytest.mark.parametrize("name", ["flagship_context", "r5_multi_stage_retrieval", "x2_expansion_aggressive", "x2_expansion_conservative", "x2_expansion_moderate"])
def test_a_turn_without_text_asks_nothing(spark, tmp_path, name):
    """SQL's arg_min passes over a first turn without text and takes the next that has one; conversation 1 has none at all."""
    pick, n, duck = np.random.default_rng(5), 100, duckdb.connect()
    words = ["class", "def", "Data", "Find", "Node", "process", "words", "tokens", "error", "zebra", "quartz"]
    texts = [" ".join(pick.choice(words, pick.integers(1, 12))) for _ in range(n)]
    tables = {
        "documents": pa.table({"doc_id": range(n), "text": texts, "lang": ["en"] * n, "source": [f"s{k % 5}" for k in range(n)], "n_chars": [len(t) for t in texts]}),
        "embeddings": pa.table({"vec_id": range(n), "label": [0] * n, "embedding": pa.array(pick.normal(size=(n, 16)).astype(np.float32).tolist(), pa.list_(pa.float32()))}),
        "conversations": pa.table({"conv_id": [0, 0, 0, 1], "turn": [0, 2, 4, 0], "role": ["user"] * 4, "text": [None, "zebra quartz Node error", "late words", None]}),
    }
    for table, made in tables.items():
        pa.parquet.write_table(made, f"{tmp_path}/{table}.parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    frame = catalog.QUERIES[name](spark, str(tmp_path))
    expected = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in expected.description]
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(names, expected.fetchall())
