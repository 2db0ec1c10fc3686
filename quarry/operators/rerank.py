"""Re-scoring of results: lexical, by question type, by feedback, by activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import basename, fuzzy_contains, stem, words


def _any(text: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def lexical(score: Column, query: Column, chunk_type: Column, content: Column) -> Column:
    """Raised for classes and functions that the question names and for each of its words in the content; lowered for overlaps."""
    low, text = F.lower(query), F.lower(content)
    hits = F.size(F.filter(words(query), lambda w: F.contains(text, w)))
    return (
        score
        * F.when(F.contains(low, F.lit("class")) & (chunk_type == "class_complete"), 1.2).otherwise(1.0)
        * F.when(_any(low, ["function", "method", "def"]) & chunk_type.isin("function_definition", "method"), 1.15).otherwise(1.0)
        * F.when(chunk_type == "overlap", 0.9).otherwise(1.0)
        * (1 + 0.1 * hits)
    )


def by_question_type(score: Column, kind: Column, symbols: Column, chunk_type: Column, content: Column, path: Column) -> Column:
    """Factors for what a question of this type looks for, for a symbol in the content and for Python files."""
    text = F.lower(content)
    wanted = (
        F.when(kind == "DEFINITION", F.when(chunk_type == "class_complete", 1.3).when(chunk_type.isin("class_definition", "interface"), 1.2).otherwise(1.0))
        .when(kind == "IMPLEMENTATION", F.when(chunk_type.isin("function_definition", "method"), 1.15).when(chunk_type == "class_complete", 1.1).otherwise(1.0))
        .when(kind == "USAGE_EXAMPLES", F.when(_any(text, ["example", "test", "demo", "sample"]), 1.2).otherwise(1.0))
        .otherwise(1.0)
    )
    named = F.when(F.exists(symbols, lambda s: F.contains(content, s)), 1.1).otherwise(1.0)
    python = F.when(F.endswith(path, F.lit(".py")) & ((kind != "USAGE_EXAMPLES") | ~F.contains(path, F.lit("test"))), 1.05).otherwise(1.0)
    return score * wanted * named * python


def exact_symbol(score: Column, symbol: Column, content: Column) -> Column:
    """Null unless the content has the symbol; raised by half where it is defined there, by a fifth elsewhere."""
    defined = F.contains(content, F.concat(F.lit("class "), symbol)) | F.contains(content, F.concat(F.lit("def "), symbol))
    return F.when(F.contains(content, symbol), score * F.when(defined, 1.5).otherwise(1.2))


def feedback(results: DataFrame, positive: DataFrame, negative: DataFrame, key: str = "id") -> DataFrame:
    """Scores x 1.5 for ids found good, x 0.5 for ids found bad (good wins)."""
    good = positive.select(key).distinct().withColumn("_good", F.lit(True))
    bad = negative.select(key).distinct().withColumn("_bad", F.lit(True))
    joined = results.join(good, key, "left").join(bad, key, "left")
    return joined.withColumn("score", F.col("score") * F.when(F.col("_good"), 1.5).when(F.col("_bad"), 0.5).otherwise(1.0)).drop("_good", "_bad")


def clamped(score: Column, boost: Column, least: float = 0.5, most: float = 3.0) -> Column:
    """score x boost, but between ``least`` and ``most`` times the score."""
    return F.greatest(score * least, F.least(score * most, score * boost))


def symbol_relevance(name: Column, terms: Column) -> Column:
    """Sum over terms: 3 for the same name, 2 where it contains the term, 1 for a fuzzy match."""
    low = F.lower(name)
    value = lambda t: F.when(low == t, 3.0).when(F.contains(low, t), 2.0).when(fuzzy_contains(t, low), 1.0).otherwise(0.0)
    return F.aggregate(F.transform(terms, value), F.lit(0.0), lambda a, x: a + x)


def file_name_relevance(path: Column, terms: Column) -> Column:
    """Sum over terms: 10 for the file's name or stem, 3 where the name contains the term."""
    name, bare = F.lower(basename(path)), F.lower(stem(path))
    value = lambda t: F.when((name == t) | (bare == t), 10.0).when(F.contains(name, t), 3.0).otherwise(0.0)
    return F.aggregate(F.transform(terms, value), F.lit(0.0), lambda a, x: a + x)


def edit_recency(hours: Column) -> Column:
    """1.5 just after an edit, falling over a day to 1.05; 1 beyond and without an edit."""
    return F.when((hours >= 0) & (hours < 24), 1 + 0.5 * F.greatest(F.lit(0.1), 1 - hours / 24)).otherwise(1.0)


def open_recency(hours: Column) -> Column:
    return F.when(hours < 2, F.greatest(F.lit(1.0), 1.3 * (1 - hours / 2))).otherwise(1.0)


def recent_list(position: Column) -> Column:
    """By the zero-based place among the ten files opened last."""
    return F.when(position < 10, F.greatest(F.lit(1.0), 1.3 * (1 - position / 10))).otherwise(1.0)


def edit_frequency(edits: Column) -> Column:
    return F.when(edits > 3, F.least(F.lit(1.2), 1 + 0.05 * edits)).otherwise(1.0)


def name_patterns(path: Column, query: Column) -> Column:
    """Main files, configuration that the question is about, tests that it is not, names and parts that it mentions."""
    name, low, asked = F.lower(basename(path)), F.lower(path), F.lower(query)
    parts = F.filter(F.split(low, "/"), lambda p: p != "")
    return (
        F.when(_any(name, ["main", "index", "app", "server"]), 1.1).otherwise(1.0)
        * F.when(_any(name, ["config", "settings", ".env", "setup"]) & _any(asked, ["config", "setting", "env", "setup"]), 1.05).otherwise(1.0)
        * F.when(_any(low, ["test", "spec"]) & ~F.contains(asked, F.lit("test")), 0.9).otherwise(1.0)
        * F.when(F.contains(asked, F.lower(stem(path))), 1.3).otherwise(1.0)
        * F.when(F.exists(parts, lambda p: F.contains(asked, p)), 1.1).otherwise(1.0)
    )
