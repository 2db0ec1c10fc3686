"""Reading and writing records: CSV, JSON, table backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a header; all columns are strings unless a schema is given."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def backup(df: DataFrame, path: str) -> None:
    """As JSON lines; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def restore(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A backup with its schema; records that do not fit it are errors."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved state; a missing or unreadable file gives an empty table."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


HISTORY = "owner string, history array<string>, saved_at timestamp, total_calculations long"


def save_history(entries: DataFrame, path: str, saved_at) -> None:
    """One JSON row an owner: its entries (owner, at, entry) in order, their number and the time."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "entry"))), lambda x: x["entry"])
    rows = entries.groupBy("owner").agg(ordered.alias("history"), F.count("*").alias("total_calculations"))
    rows.select("owner", "history", F.lit(saved_at).cast("timestamp").alias("saved_at"), "total_calculations").write.mode("overwrite").json(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """The saved rows; none where nothing was saved."""
    return read_state(spark, path, HISTORY)


def file_info(spark: SparkSession, path: str) -> dict:
    """Does a file or folder exist, how many bytes has it, and when was it changed?"""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return {"exists": False}
    return {"exists": True, "size_bytes": fs.getContentSummary(place).getLength(), "modified": fs.getFileStatus(place).getModificationTime(), "filename": path}
