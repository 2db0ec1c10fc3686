"""Relations between chunks: containment, siblings, overlaps, expansion, dependencies.

All joins are equi-joins on the file (or on a derived key) with the range test
beside it; a hot file is split by AQE's skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import write_scratch

#: Factor on the score of a related chunk (fixed values).
FACTORS = {"parent": 0.9, "sibling": 0.7, "overlap": 0.8, "child": 0.85}


def _named(df: DataFrame, prefix: str, columns: list[str], *keep: str) -> DataFrame:
    return df.select(*keep, *(F.col(c).alias(f"{prefix}{c}") for c in columns))


def first_chunks(chunks: DataFrame, most: int, order: tuple[str, ...]) -> DataFrame:
    """The first ``most`` chunks of each file, with their place; a hot file is cut in every task before it is shuffled."""
    place = F.row_number().over(Window.partitionBy("file_path").orderBy(*order))
    return chunks.withColumn("_place", place).where(F.col("_place") <= most)


def related_chunks(seeds: DataFrame, chunks: DataFrame, fetched: int = 20, kept: int = 5, order: tuple[str, ...] = ("ord", "id"), by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., seed_id, id, relation, rel_ord): for each seed, related chunks of its file.

    Of the first ``fetched`` other chunks of the file, the first ``kept`` that
    are a parent, a sibling or an overlap.  Whole classes have no relations.
    ``by`` names further columns that tell seeds apart (a question).  Seeds meet only
    the first chunks of their file, so the join is bounded by seeds x ``fetched``.
    """
    side = first_chunks(chunks.select("file_path", "id", "chunk_type", "start_line", "end_line", *(c for c in order if c not in ("id", "start_line"))), fetched + 1, order)
    joined = _named(seeds.where("chunk_type <> 'class_complete'"), "s_", ["id", "chunk_type", "start_line", "end_line"], "file_path", *by).join(side, "file_path").where("id <> s_id")
    first = Window.partitionBy(*by, "s_id").orderBy("_place")
    joined = joined.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= fetched)
    relation = (
        F.when((F.col("chunk_type") == "class_complete") & (F.col("start_line") <= F.col("s_start_line")) & (F.col("end_line") >= F.col("s_end_line")), "parent")
        .when((F.abs(F.col("start_line") - F.col("s_start_line")) < 50) & (F.col("chunk_type") == F.col("s_chunk_type")), "sibling")
        .when((F.col("start_line") <= F.col("s_end_line")) & (F.col("end_line") >= F.col("s_start_line")), "overlap")
    )
    found = joined.withColumn("relation", relation).where("relation is not null")
    return found.withColumn("rel_ord", F.row_number().over(first).cast("long")).where(F.col("rel_ord") <= kept).select(*by, F.col("s_id").alias("seed_id"), "id", "relation", "rel_ord")


def with_related(seeds: DataFrame, related: DataFrame, chunks: DataFrame | None = None, cap: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., id, score, seed_ord, rel_ord): seeds and related chunks, first occurrence of an id, at most ``cap`` rows (for each ``by``).

    ``seeds`` has id, score and ord.  ``chunks``, if given, are the ids that exist.
    """
    factor = F.coalesce(F.create_map(*[F.lit(x) for pair in FACTORS.items() for x in pair])[F.col("relation")], F.lit(0.5))
    more = related.join(seeds.select(*by, F.col("id").alias("seed_id"), "score", F.col("ord").alias("seed_ord")), [*by, "seed_id"])
    if chunks is not None:
        more = more.join(chunks.select("id").distinct(), "id", "left_semi")
    own = seeds.select(*by, "id", "score", F.struct("ord", F.lit(0).cast("long").alias("k")).alias("at"))
    both = own.union(more.select(*by, "id", F.col("score") * factor, F.struct("seed_ord", "rel_ord")))
    first = both.groupBy(*by, "id").agg(F.min(F.struct("at", "score")).alias("f")).select(*by, "id", "f.score", "f.at")
    if cap is not None and by:
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("at", "id"))).where(F.col("_n") <= cap)
    elif cap is not None:
        first = first.orderBy("at", "id").limit(cap)
    return first.select(*by, "id", "score", F.col("at.ord").alias("seed_ord"), F.col("at.k").alias("rel_ord"))


#: Lines of one bucket in joins of line ranges.
BUCKET_LINES = 64


def _bucketed(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each bucket of lines that a range touches."""
    bucket = lambda c: F.floor(F.col(c) / BUCKET_LINES)
    return ranges.withColumn("_bucket", F.explode(F.sequence(bucket(start), F.greatest(bucket(start), bucket(end)))))


def parents(chunks: DataFrame) -> DataFrame:
    """(id, parent_id): the first other chunk, by start line, that contains a chunk's lines.

    A chunk meets those that touch the bucket of its first line, so a long file
    is not joined with itself.
    """
    side = _bucketed(_named(chunks, "p_", ["id", "start_line", "end_line", "ord"], "file_path"), "p_start_line", "p_end_line")
    child = chunks.select("file_path", "id", "start_line", "end_line", F.floor(F.col("start_line") / BUCKET_LINES).alias("_bucket"))
    inside = child.join(side, ["file_path", "_bucket"]).where("p_id <> id and p_start_line <= start_line and p_end_line >= end_line")
    return inside.groupBy("id").agg(F.min_by("p_id", F.struct("p_start_line", "p_ord", "p_id")).alias("parent_id"))


def siblings(chunks: DataFrame, parent_of: DataFrame) -> DataFrame:
    """(id, sibling_id): chunks of one file under one parent, both ways."""
    held = chunks.select("id", "file_path").join(parent_of, "id")
    other = _named(held, "o_", ["id"], "file_path", "parent_id")
    return held.join(other, ["file_path", "parent_id"]).where("id <> o_id").select("id", F.col("o_id").alias("sibling_id"))


def overlap_edges(chunks: DataFrame, shared_lines: int = 1) -> DataFrame:
    """(src_id, dst_id): chunks of one file whose line ranges share lines, both ways.

    Two ranges that share lines meet in the bucket of the later one's first line.
    """
    own = _bucketed(chunks.select("file_path", "id", "start_line", "end_line"), "start_line", "end_line")
    other = _named(own, "o_", ["id", "start_line", "end_line"], "file_path", "_bucket")
    joined = own.join(other, ["file_path", "_bucket"]).where("id < o_id and o_start_line <= end_line and start_line <= o_end_line")
    joined = joined.where(F.col("_bucket") == F.floor(F.greatest("start_line", "o_start_line") / BUCKET_LINES))
    found = joined.where(F.least("end_line", "o_end_line") - F.greatest("start_line", "o_start_line") + 1 >= shared_lines).select(F.col("id").alias("src_id"), F.col("o_id").alias("dst_id"))
    return found.union(found.select("dst_id", "src_id"))


def unseen(results: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Results whose id has not been shown before."""
    return results.join(seen.select(key).distinct(), key, "left_anti")


def same_file_expansion(seeds: DataFrame, chunks: DataFrame, fetched: int, kept: int, factor: float | None, fixed: float = 0.5) -> DataFrame:
    """(seed_id, id, score): per seed the first chunks of its file that are no seeds themselves.

    Of ``fetched`` chunks in file order ``kept`` are taken; the score is the
    seed's times ``factor``, or ``fixed`` where no factor is given.
    """
    order = Window.partitionBy("seed_id").orderBy("_place")
    first = seeds.select(F.col("id").alias("seed_id"), F.col("score").alias("seed_score"), "file_path").join(first_chunks(chunks.select("file_path", "id", "ord"), fetched, ("ord", "id")), "file_path")
    new = first.join(seeds.select("id"), "id", "left_anti").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= kept)
    return new.select("seed_id", "id", (F.col("seed_score") * factor if factor is not None else F.lit(fixed)).alias("score"))


def resolve_imports(imports: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = (".py", "/__init__.py", ".js", ".ts")) -> DataFrame:
    """(file_path, target): imports whose module path, with one of the suffixes, is a file.

    ``imports`` has file_path and module (dotted or slashed).
    """
    base = F.regexp_replace("module", r"\.", "/")
    candidates = imports.select("file_path", F.explode(F.array(*[F.concat(base, F.lit(s)) for s in suffixes])).alias("target"))
    return candidates.join(files.select(F.col("file_path").alias("target")).distinct(), "target", "left_semi").distinct().select("file_path", "target")


#: Most first characters of names that are broadcast; beyond it the same join shuffles.
KEY_LIMIT = 100_000


def symbol_references(symbols: DataFrame, imports: DataFrame, gram: int = 3, limit: int = KEY_LIMIT) -> DataFrame:
    """(file_path, name, defined_in): symbols whose name occurs anywhere in an import of another file.

    Names and imports meet on the name's first ``gram`` characters, which the import must
    hold, so the join is by equality and only such candidates are tested whole.  Each text is
    cut once, however many files have it.  The cuts are many times the imports and their size is
    not seen ahead, so they are never broadcast; those that begin no name go before any shuffle.
    """
    text = F.col("import_text")
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda at: F.array(*[F.substring(text, at, n) for n in range(1, gram + 1)]))))
    defined = write_scratch(symbols.where("name <> ''").select("name", F.col("file_path").alias("defined_in"), F.substring("name", 1, gram).alias("_key")).distinct(), "symbols")
    keys = defined.select("_key").distinct()
    cuts = imports.select("import_text").where("import_text is not null").distinct().select("import_text", F.explode(grams).alias("_key"))
    held = cuts.join(F.broadcast(keys) if keys.count() <= limit else keys.hint("merge"), "_key", "left_semi")
    named = held.hint("merge").join(defined, "_key").where("contains(import_text, name)").select("import_text", "name", "defined_in")
    found = imports.select("file_path", "import_text").join(named.hint("merge"), "import_text")
    return found.where("file_path <> defined_in").select("file_path", "name", "defined_in").distinct()


def dependency_context(items: DataFrame, dependencies: DataFrame, shown: DataFrame, key: str, importance: str, most: int) -> DataFrame:
    """The items that selected ones depend on and that are not shown yet: the ``most`` important."""
    wanted = items.join(dependencies.select(key).distinct(), key, "left_semi").join(shown.select(key).distinct(), key, "left_anti")
    return wanted.orderBy(F.desc(importance), key).limit(most)


def replaced_imports(relations: DataFrame, file: str, target: str, order: str) -> DataFrame:
    """(file, target): the import map after updates in ``order``; the last one of a file replaces its targets."""
    last = relations.groupBy(file).agg(F.max(order).alias(order))
    return relations.join(last, [file, order], "left_semi").select(file, target).distinct()


def neighbours(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, other): dependencies and dependents together."""
    return edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(b, a)).where("node <> other").distinct()


def band_pairs(events: DataFrame, width_seconds: int, key: str = "file_path", at: str = "ts", within: list[str] | None = None) -> DataFrame:
    """(a, b): keys with events less than ``width_seconds`` apart, both ways, each pair once.

    Each event lies in one bucket of that width and is met in its own and both
    neighbouring ones.  Within a bucket only each key's first and last event
    matter for the neighbours, so a busy bucket holds at most its keys.
    """
    scope = within or []
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / F.lit(1_000_000.0)
    timed = events.select(*scope, F.col(key).alias("k"), seconds.alias("t")).withColumn("bucket", F.floor(F.col("t") / width_seconds))
    # all events of one bucket lie within the width, so keys of one bucket pair freely; towards
    # the next bucket only the last event of this one and the first of that one can be closest
    ends = timed.groupBy(*scope, "bucket", "k").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    here = ends.select(*scope, "bucket", F.col("k").alias("a"), "last")
    same = here.join(ends.select(*scope, "bucket", F.col("k").alias("b")), [*scope, "bucket"])
    after = here.join(ends.select(*scope, (F.col("bucket") - 1).alias("bucket"), F.col("k").alias("b"), F.col("first").alias("next")), [*scope, "bucket"]).where(F.col("next") - F.col("last") < width_seconds)
    pairs = same.select(*scope, "a", "b").union(after.select(*scope, "a", "b")).where("a <> b")
    return pairs.union(pairs.select(*scope, F.col("b"), F.col("a"))).distinct()


