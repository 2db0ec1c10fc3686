"""How queries over the driver's tables are registered, and the views that they share.

Reference concepts map onto the tables as follows: a *file* is a row of
``documents`` (path from doc_id, project from source), a *chunk* a window of its
lines, a *vector store* the ``embeddings`` table, *questions* the user turns of
``conversations`` and *activity* the ``events`` table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.chunking import line_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, and its DuckDB SQL if there is any."""

    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_path() -> Column:
    """The path that stands for a document."""
    return F.concat(F.lit("src/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files: file_path, project_path, language, content."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(file_path().alias("file_path"), F.col("source").alias("project_path"), F.col("lang").alias("language"), F.coalesce("text", F.lit("")).alias("content"))


#: The same as DuckDB CTEs; a query's SQL goes on after them.
FILES = """
files AS (
    SELECT 'src/' || source || '/doc_' || doc_id || '.txt' AS file_path, source AS project_path, lang AS language, coalesce(text, '') AS content
    FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str, size: int = 8) -> DataFrame:
    """Chunks of ``size`` lines over all files, with a score that stands for a retrieval score."""
    cut = line_windows(files(spark, sf_dir), size, 0.2)
    return cut.withColumn("score", (F.length("content") % 997) / F.lit(997.0))


def chunks_sql(size: int = 8) -> str:
    step = max(1, size - int(size * 0.2))
    return f"""{FILES},
cut AS (
    SELECT *, string_split(content, chr(10)) AS ls FROM files),
chunks AS (
    SELECT md5(concat_ws('_', file_path, 'text', 'text', CAST(i + 1 AS VARCHAR), CAST(least(i + {size}, len(ls)) AS VARCHAR))) AS id,
           file_path, project_path, language, array_to_string(ls[i + 1 : i + {size}], chr(10)) AS content, 'text' AS chunk_type,
           CAST(i + 1 AS BIGINT) AS start_line, CAST(least(i + {size}, len(ls)) AS BIGINT) AS end_line, CAST(i // {step} AS BIGINT) AS ord,
           (length(array_to_string(ls[i + 1 : i + {size}], chr(10))) % 997) / 997.0::DOUBLE AS score
    FROM cut, unnest(range(0, len(ls), {step})) AS t(i))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns: session_id, turn, query."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select(F.col("conv_id").alias("session_id"), "turn", F.coalesce("text", F.lit("")).alias("query"))


QUESTIONS = """
questions AS (SELECT conv_id AS session_id, turn, coalesce(text, '') AS query FROM conversations WHERE role = 'user')"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity: session_id, file_path, activity (edit, open, close), ts, time_spent."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "open").when(F.col("event_type") == "purchase", "edit").otherwise("close")
    file = F.concat(F.lit("src/file_"), F.get_json_object("props", "$.k"), F.lit(".py"))
    return events.select("event_id", F.col("user_id").alias("session_id"), file.alias("file_path"), kind.alias("activity"), "ts", F.coalesce("value", F.lit(0.0)).alias("time_spent"))


ACTIVITY = """
activity AS (
    SELECT event_id, user_id AS session_id, 'src/file_' || json_extract_string(props, '$.k') || '.py' AS file_path,
           CASE WHEN event_type IN ('view', 'click') THEN 'open' WHEN event_type = 'purchase' THEN 'edit' ELSE 'close' END AS activity,
           ts, coalesce(value, 0.0) AS time_spent
    FROM events)"""


def embedded_sql(rows: str, keys: str, text: str, dimension: int) -> str:
    """CTEs that end in ``embedded``: keys, and the sum of (place + 1) x value over a text's hashed vector."""
    digit = lambda n: f"(strpos('0123456789abcdef', substring(m, {n}, 1)) - 1)"
    place = " + ".join(f"{16 ** (4 - n)} * {digit(n)}" for n in range(1, 5))
    return rf"""
asked_texts AS (SELECT {keys}, {text} AS t FROM {rows}),
ws AS (SELECT {keys}, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+')) AS w FROM asked_texts),
grams AS (SELECT {keys}, md5(w) AS m FROM ws UNION ALL SELECT {keys}, md5(substring(w, k, 3)) FROM (SELECT {keys}, w, unnest(range(1, length(w) - 1)) AS k FROM ws)),
cells AS (SELECT {keys}, ({place}) % {dimension} AS b, sum(CASE WHEN {digit(5)} >= 8 THEN 1 ELSE -1 END) AS x FROM grams GROUP BY ALL),
sums AS (SELECT {keys}, sum((b + 1) * x) / nullif(sqrt(sum(x * x)), 0) AS total FROM cells GROUP BY ALL),
embedded AS (SELECT {keys}, round(coalesce(total, 0), 3) AS total FROM asked_texts LEFT JOIN sums USING ({keys}))"""


def vector_total(vector: Column) -> Column:
    """The same of a made vector."""
    places = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(places, F.lit(0.0), lambda a, x: a + x), 3)
