"""Every registered query of the engine against its DuckDB SQL, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from quarry.plans import catalog

DATA = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        path = f"{DATA}/{name}"
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def plain(value):
    if value is None or isinstance(value, float | np.floating) and math.isnan(value):
        return ""
    if isinstance(value, float | np.floating):
        return f"{round(float(value), 6) + 0.0:.6f}"
    if isinstance(value, int | np.integer) and not isinstance(value, bool):
        return f"{float(value):.6f}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(row[k]) for k in order) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    frame = catalog.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in frame.collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    expected = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows_of(frame.columns, rows) == rows_of(names, expected.fetchall())
