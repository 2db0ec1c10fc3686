import pyarrow.parquet as pq
import pytest

DATA = "/root/testdata/sf0.001"
#: Columns with names that operators use inside; no operator may trip over them.
CLASHING = ["part", "tail", "rep", "band", "hash", "score", "digest", "key", "h", "k", "n", "kept"]


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def texts():
    table = pq.read_table(f"{DATA}/documents.parquet")
    return dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))


ODD_ROWS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two three"),
    (5, "one two three"),
    (5, "one two three"),
    (None, "one two three"),
    (6, "Größe straße İstanbul ΣΑΣ 北京 \U0001f600 " * 3),
    (7, "word " * 40_000),
    (8, "x" * 150_000),
    (9, 'token = "abcdefghijklmnop" <|endoftext|> idiot'),
]


def odd(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ODD_ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def odd_docs(spark):
    return odd(spark)


@pytest.fixture(scope="session")
def no_docs(spark):
    return odd(spark).where("false")
