"""Column functions over text: tokens, lines, names, paths and fuzzy tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """The lines of a text, cut at line feeds only; null counts as one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def estimated_tokens(text: Column, floor_at_one: bool = True) -> Column:
    """A quarter of the characters, rounded down (at least 1 unless told otherwise)."""
    estimate = F.floor(F.length(text) / 4).cast("long")
    return F.greatest(F.lit(1).cast("long"), estimate) if floor_at_one else estimate


def numbered(content: Column, first_line: Column) -> Column:
    """Each line behind its right-aligned number."""
    shown = F.transform(lines(content), lambda line, i: F.concat(F.format_string("%4d", (first_line + i).cast("int")), F.lit(" | "), line))
    return F.array_join(shown, "\n")


def class_name(content: Column) -> Column:
    """The name after the first ``class `` up to a bracket, colon or line end; empty if there is none."""
    return F.trim(F.regexp_extract(content, r"class ([^(:\n]*)", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def directories(path: Column) -> Column:
    """The directory parts of a path, the file name left out."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def related_directories(a: Column, b: Column) -> Column:
    """Same parent, or all but at most one of the shared leading directories equal.

    With m parts in the shorter path, the first m - 1 positions are compared
    and at least m - 2 of them must agree (m > 1).
    """
    x, y = F.split(a, "/"), F.split(b, "/")
    shorter = F.least(F.size(x), F.size(y))
    head = F.greatest(shorter - 1, F.lit(0))
    equal = F.size(F.filter(F.zip_with(F.slice(x, 1, head), F.slice(y, 1, head), lambda p, q: p == q), lambda same: same))
    return (F.array_join(directories(a), "/") == F.array_join(directories(b), "/")) | ((shorter > 1) & (equal >= shorter - 2))


def project_match(a: Column, b: Column) -> Column:
    """Equal, either within the other, or either empty."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return (x == "") | (y == "") | F.contains(x, y) | F.contains(y, x)


def fuzzy_contains(term: Column, name: Column, least: int = 3) -> Column:
    """Some window of the name differs from the term in at most one character; terms shorter than ``least`` never match."""
    m, n = F.length(term), F.length(name)
    letters = F.sequence(F.lit(1), F.greatest(m, F.lit(1)))

    def close(start: Column) -> Column:
        return F.aggregate(letters, F.lit(0), lambda misses, k: misses + F.when(F.substring(term, k, F.lit(1)) != F.substring(name, start + k - 1, F.lit(1)), 1).otherwise(0)) <= 1

    windows = F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1)))
    return F.coalesce((m >= least) & (n >= m) & F.exists(windows, close), F.lit(False))


def fitting_lines(content: Column, budget: int) -> Column:
    """The leading whole lines whose characters, line feeds included, stay within the budget."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(state: Column, line: Column) -> Column:
        used = state["used"] + F.length(line) + 1
        fits = state["open"] & (used <= budget)
        return F.struct(F.when(fits, used).otherwise(state["used"]).cast("long").alias("used"), (state["n"] + F.when(fits, 1).otherwise(0)).cast("int").alias("n"), fits.alias("open"))

    return F.array_join(F.slice(lines(content), 1, F.aggregate(lines(content), zero, step)["n"]), "\n")


def truncate_at_lines(content: Column, budget: int, marker: str = "\n# ... (truncated)") -> Column:
    """The content if it fits ``budget`` characters, else its leading lines and a marker."""
    return F.when(F.length(content) <= budget, content).otherwise(F.concat(fitting_lines(content, budget), F.lit(marker)))


def summary_lines(content: Column, most: int = 3, among: int = 5) -> Column:
    """The first non-blank lines among the leading ones."""
    return F.array_join(F.slice(F.filter(F.slice(lines(content), 1, among), lambda x: F.trim(x) != ""), 1, most), "\n")


def words(text: Column) -> Column:
    """Lower-cased words between white space; no empty ones."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
