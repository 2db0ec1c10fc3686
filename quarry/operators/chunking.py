"""Cutting files into line chunks: windows, overlaps and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import estimated_tokens, lines


def chunk_id(path: Column, name: Column, kind: Column, start: Column, end: Column) -> Column:
    """A stable id: MD5 of path, name, kind and lines joined by underscores."""
    return F.md5(F.concat_ws("_", path, name, kind, start.cast("string"), end.cast("string")).cast("binary"))


def line_windows(files: DataFrame, size: int = 50, ratio: float = 0.2, path: str = "file_path", content: str = "content") -> DataFrame:
    """Windows of ``size`` lines, each starting ``size - int(size * ratio)`` lines after the last.

    Adds id, content (of the window), chunk_type, start_line and end_line
    (1-based, inclusive) and ``ord``; the last window may be a suffix of the one before.
    """
    step = max(1, size - int(size * ratio))
    cut = files.withColumn("_lines", lines(F.col(content)))
    cut = cut.withColumn("_at", F.explode(F.sequence(F.lit(0), F.size("_lines") - 1, F.lit(step))))
    start, end = F.col("_at") + 1, F.least(F.col("_at") + size, F.size("_lines"))
    kept = [c for c in files.columns if c != content]
    return cut.select(
        chunk_id(F.col(path), F.lit("text"), F.lit("text"), start, end).alias("id"),
        *kept,
        F.array_join(F.slice("_lines", start, F.lit(size)), "\n").alias("content"),
        F.lit("text").alias("chunk_type"),
        start.cast("long").alias("start_line"),
        end.cast("long").alias("end_line"),
        F.floor(F.col("_at") / step).cast("long").alias("ord"),
    )


def overlap_chunks(chunks: DataFrame, files: DataFrame, ratio: float = 0.2, path: str = "file_path") -> DataFrame:
    """A chunk over the border of each two consecutive chunks of a file.

    It runs from ``ratio`` before the first one's end to ``ratio`` past the
    second one's start, and exists only if it spans more than one line.
    """
    order = Window.partitionBy(path).orderBy("ord")
    pair = chunks.select(path, "ord", "start_line", "end_line", F.lead("start_line").over(order).alias("s2"), F.lead("end_line").over(order).alias("e2")).where("s2 is not null")
    span = lambda a, b: F.floor(F.lit(ratio) * (F.col(b) - F.col(a))).cast("long")
    start = F.greatest(F.col("start_line"), F.col("end_line") - span("start_line", "end_line"))
    end = F.least(F.col("e2"), F.col("s2") + span("s2", "e2"))
    found = pair.select(path, "ord", start.alias("start_line"), end.alias("end_line")).where("end_line > start_line")
    joined = found.join(files.select(path, lines(F.col("content")).alias("_lines")), path)
    content = F.array_join(F.slice("_lines", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    return joined.select(path, "ord", "start_line", "end_line", F.lit("overlap").alias("chunk_type"), content.alias("content"))


def quality_report(chunks: DataFrame, content: str = "content", tiny: int = 50, huge: int = 2000) -> DataFrame:
    """One row: counts, token figures, shares of tiny and huge chunks, and a score of at most 100."""
    tokens = estimated_tokens(F.col(content))
    base = chunks.select(tokens.alias("t")).agg(
        F.count("*").alias("chunks"),
        F.min("t").alias("min_tokens"),
        F.max("t").alias("max_tokens"),
        F.avg("t").alias("avg_tokens"),
        F.var_pop("t").alias("variance"),
        F.count_if(F.col("t") < tiny).alias("tiny"),
        F.count_if(F.col("t") > huge).alias("huge"),
    )
    share = F.coalesce(F.col("tiny") / F.nullif(F.col("chunks"), F.lit(0)), F.lit(0.0))
    score = F.lit(100) - F.when(share > 0.15, 30).otherwise(0) - F.when(F.col("huge") > 0, 20).otherwise(0) - F.when(F.col("variance") > 1_000_000, 10).otherwise(0)
    return base.withColumn("tiny_issue", share > 0.10).withColumn("score", F.greatest(F.lit(0), score).cast("long"))
