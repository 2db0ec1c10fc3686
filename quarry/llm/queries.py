"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, exact_dedup, fingerprint, html_extract, language_id, lm_score, near_dedup, packing, secret_scan, toxicity
from quarry.llm.common import crc_remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents over as many tasks as the cluster has cores: a small table may be one file split."""
    docs, cores = _table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _held_out(divisor: int, remainder: int):
    return (crc_remainder("doc_id", divisor) == remainder).alias("held_out")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language_id.train(docs.where(~_held_out(4, 2)))
    return language_id.predict(docs, model).select("doc_id", _held_out(4, 2), "lang_pred", "score", "ambiguous", "runner_up")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_documents(spark, sf_dir), keep=False)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~_held_out(5, 0)))
    return toxicity.score(docs, model).select("doc_id", _held_out(5, 0), "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model, counts = lm_score.train(docs.where(~_held_out(7, 2)))
    return lm_score.score(docs, model, counts).select("doc_id", _held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_near_dedup": op2_near_dedup,
    "op3_bpe": op3_bpe,
    "op4_packing": op4_packing,
    "op5_fingerprint": op5_fingerprint,
    "op6_toxicity": op6_toxicity,
    "op7_lm_score": op7_lm_score,
    "op8_html_extract": op8_html_extract,
    "op9_secret_scan": op9_secret_scan,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES = {
    "op2_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS shingles
            FROM w),
        u AS (SELECT doc_id, unnest(shingles) AS shingle, len(shingles) AS n FROM s),
        met AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common, any_value(a.n) + any_value(b.n) AS both_sizes
            FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM met WHERE 100 * common >= 75 * (both_sizes - common)
            UNION ALL SELECT y, x FROM met WHERE 100 * common >= 75 * (both_sizes - common)),
        reached AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other)
        SELECT s.doc_id, CAST(len(any_value(shingles)) AS BIGINT) AS n_shingles, min(other) AS component_id, s.doc_id = min(other) AS kept
        FROM s JOIN reached USING (doc_id) GROUP BY s.doc_id
    """,
    "op10_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        g AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256, n_chars FROM g
    """,
}
