"""A cleaning and packing pipeline over ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all rows of ``docs`` (the table that its predecessor kept, written as
Parquet and read again) and returns a DataFrame.  All but the last return the
columns of ``documents``:

* toxicity drops the documents that the conditional random field rejects;
* exact_dedup keeps one document of each group of equal texts;
* near_dedup keeps one document of each near-duplicate component;
* secret_scan keeps every document and redacts the secrets in its text;
* packing cuts and packs all that is left into training sequences.

Null texts count as empty and stay null until packing, where they are one end
token; exact_dedup keeps one of all texts without a visible character.  Of rows
repeated under one id with one text, one stays.  Rows without an id cannot be
named: toxicity judges them like others, then one stays of those that share a
text, and none if a row with an id has it; near_dedup compares no further.  Ties
go to the smaller id.  Very long texts are read whole.  Empty tables pass through
every stage.  Columns beyond those of ``documents`` are kept until packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import exact_dedup, near_dedup, packing, secret_scan, toxicity
from quarry.llm.common import crc_remainder, keep_marked, write_shared


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more; null and empty texts score as texts without tokens."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(crc_remainder("doc_id", 5) != 0))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts equal but for white space: the longest, then the smallest id."""
    return keep_marked(docs, exact_dedup.exact_groups(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each near-duplicate component; empty texts are linked with nothing and stay."""
    return keep_marked(docs, near_dedup.near_duplicates(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced; n_chars follows, null texts stay null."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence; a null or empty text is one end token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Training, components and tokenizers cannot be written in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
