"""Widening results: lines around them, and more from their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import estimated_tokens, lines


def expand_windows(results: DataFrame, files: DataFrame, window_tokens: int = 300, most_tokens: int = 1500) -> DataFrame:
    """Each result with lines of its file before and after it, marked as expanded.

    The lines on each side are a twentieth of ``window_tokens``, ten at least.
    Results over ``most_tokens`` and those whose file is not there stay as they
    are.  ``base_id`` keeps the id that later steps de-duplicate by.
    """
    pad = max(10, window_tokens // 20)
    joined = results.join(files.select("file_path", lines(F.col("content")).alias("_lines")), "file_path", "left")
    small = (estimated_tokens(F.col("content")) <= most_tokens) & F.col("_lines").isNotNull()
    start, end = F.greatest(F.lit(1), F.col("start_line").cast("int") - pad), F.least(F.size("_lines"), F.col("end_line").cast("int") + pad)
    part = lambda a, b: F.array_join(F.slice("_lines", F.greatest(a, F.lit(1)), F.greatest(b - a + 1, F.lit(0))), "\n")
    before, after = part(start, F.col("start_line").cast("int") - 1), part(F.col("end_line").cast("int") + 1, end)
    shown = F.concat_ws(
        "\n",
        F.when(before != "", F.concat(F.lit("# --- Context Before ---\n"), before)),
        F.lit("# --- Main ---"),
        F.col("content"),
        F.when(after != "", F.concat(F.lit("# --- Context After ---\n"), after)),
    )
    changed = {
        "base_id": F.col("id"),
        "expanded": small,
        "content": F.when(small, shown).otherwise(F.col("content")),
        "id": F.when(small, F.concat("id", F.lit("_expanded"))).otherwise(F.col("id")),
        "start_line": F.when(small, start).otherwise(F.col("start_line")).cast("long"),
        "end_line": F.when(small, end).otherwise(F.col("end_line")).cast("long"),
    }
    return joined.withColumns(changed).drop("_lines")
