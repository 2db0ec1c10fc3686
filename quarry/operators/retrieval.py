"""Whole retrievals for a batch of questions: over-fetch, relations, re-ranking, stages, boosts, expansion and packing.

Questions travel as rows, so one plan serves any number of them.  ``asked`` has
question (its id), query (its text) and vector; ``rows`` are chunks with id,
file_path, chunk_type, start_line, end_line, content and embedding.  Contents
are joined for the few results only, never carried through a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import query as Q
from quarry.operators import expansion, fusion, relations, rerank, vector
from quarry.session import write_scratch

#: Order of a file's chunks.
PLACE = ("start_line", "id")

#: Gives further queries of a question their vectors: (question, part, query) to (question, part, query, vector).
Embed = Callable[[DataFrame], DataFrame]


def ranked(found: DataFrame, k: int | None = None, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """Adds ``ord`` by falling score within each question, and keeps the best ``k``."""
    order = Window.partitionBy("question").orderBy(F.desc("score"), *ties)
    out = found.withColumn("ord", F.row_number().over(order).cast("long"))
    return out if k is None else out.where(F.col("ord") <= k)


def nearest(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(question, id, score, ord): the nearest rows by cosine."""
    found = vector.batch_top_k(rows.select("id", "embedding"), asked.select(F.col("question").alias("id"), F.col("vector").alias("embedding")), k, key="id")
    return found.withColumnRenamed("query_id", "question")


def retrieve(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(question, id, file_path, chunk_type, start_line, end_line, content, score, ord).

    Twice as many nearest chunks, the related ones of their files, at most one and a half times
    ``k`` of both, re-ranked by the question's words and by its type; the best ``k`` stay.
    """
    lean = rows.select("id", "file_path", "chunk_type", "start_line", "end_line")
    seeds = nearest(asked, rows, 2 * k).join(lean, "id")
    related = relations.related_chunks(seeds, lean, order=PLACE, by=("question",))
    united = relations.with_related(seeds, related, cap=int(1.5 * k), by=("question",))
    found = united.join(rows.select(*lean.columns, "content"), "id").join(asked.select("question", "query"), "question")
    return ranked(rescored(found), k, ("seed_ord", "rel_ord", "id")).drop("seed_ord", "rel_ord", "query")


def rescored(found: DataFrame) -> DataFrame:
    """Scores by the words of ``query`` and by what it asks for."""
    c = F.col
    score = rerank.lexical(c("score"), c("query"), c("chunk_type"), c("content"))
    return found.withColumn("score", rerank.by_question_type(score, Q.query_type(c("query")), Q.symbols(c("query")), c("chunk_type"), c("content"), c("file_path")))


def _apart(more: DataFrame, embed: Embed) -> DataFrame:
    """Further queries (question, part, query) as questions of their own: owner, part, query, vector and a question key."""
    key = F.concat_ws("#", F.col("question").cast("string"), F.col("part").cast("string"))
    return embed(more).select(F.col("question").alias("owner"), "part", "query", "vector", key.alias("question"))


def _retrieved_apart(parts: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``retrieve`` for such questions; ids are text, as the questions are."""
    found = retrieve(parts, rows.withColumn("id", F.col("id").cast("string")), k)
    return found.join(parts.select("question", "owner", "part", F.col("query").alias("asked")), "question")


def _broader(asked: DataFrame) -> DataFrame:
    """Up to two follow-up queries of a question, as parts 3 and 4."""
    return asked.select("question", F.posexplode(F.slice(Q.broader_queries(F.col("query")), 1, 2)).alias("part", "query")).withColumn("part", F.col("part") + 3)


def _symbols(asked: DataFrame) -> DataFrame:
    """Up to three symbols of a question, as parts 0 to 2."""
    return asked.select("question", F.posexplode(F.slice(Q.symbols(F.col("query")), 1, 3)).alias("part", "query"))


def _broader_of(found: DataFrame, k: int) -> DataFrame:
    return found.where((F.col("part") >= 3) & (F.col("ord") <= max(1, k // 2))).withColumn("score", F.col("score") * 0.7)


def _exact_of(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    many = asked.select(F.col("question").alias("owner"), F.size(Q.symbols(F.col("query"))).alias("many"))
    share = F.greatest(F.floor(F.lit(k) / F.col("many")), F.lit(1))
    kept = found.where("part < 3").join(many, "owner").where(F.col("ord") <= share).drop("many")
    return kept.withColumn("score", rerank.exact_symbol(F.col("score"), F.col("asked"), F.col("content"))).where("score is not null")


def broader_stage(asked: DataFrame, rows: DataFrame, k: int, embed: Embed) -> DataFrame:
    """Results of up to two follow-up queries a question, half of ``k`` each, at seven tenths of their score."""
    return _broader_of(_retrieved_apart(_apart(_broader(asked), embed), rows, k), k)


def symbol_stage(asked: DataFrame, rows: DataFrame, k: int, embed: Embed) -> DataFrame:
    """Results that contain one of up to three symbols of a question, which share ``k``; raised where it is defined."""
    return _exact_of(_retrieved_apart(_apart(_symbols(asked), embed), rows, k), asked, k)


def multi_stage(asked: DataFrame, rows: DataFrame, k: int, embed: Embed) -> DataFrame:
    """(question, id, score, sightings, ord): exact-symbol, semantic and broader stages, in that order, fused by id."""
    stage = lambda df, owner, part: df.select(F.col(owner).cast("string").alias("question"), F.col("id").cast("string").alias("id"), "score", (part * 10_000 + F.col("ord")).cast("long").alias("ord"))
    # one search serves the queries of both outer stages
    further = write_scratch(_retrieved_apart(_apart(_symbols(asked).unionByName(_broader(asked)), embed), rows, k), "further")
    exact = stage(_exact_of(further, asked, k), "owner", F.col("part"))
    semantic = stage(retrieve(asked, rows, k), "question", F.lit(3))
    broader = stage(_broader_of(further, k), "owner", F.col("part") + 1)
    return ranked(fusion.fuse_scores(exact.unionByName(semantic).unionByName(broader), ["question", "id"]), k)


def boosted(asked: DataFrame, rows: DataFrame, state: DataFrame, now, k: int) -> DataFrame:
    """Twice the results, re-scored by recent work on their files (clamped), the best ``k``.

    ``state`` has file_path, last_edited, last_opened and edit_frequency.
    """
    found = retrieve(asked, rows, 2 * k).join(state, "file_path", "left").join(asked.select("question", "query"), "question")
    hours = lambda c: (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(c).cast("timestamp"))) / F.lit(3600e6)
    boost = rerank.edit_recency(hours("last_edited")) * rerank.open_recency(hours("last_opened")) * rerank.edit_frequency(F.coalesce("edit_frequency", F.lit(0))) * rerank.name_patterns(F.col("file_path"), F.col("query"))
    return ranked(found.withColumn("score", rerank.clamped(F.col("score"), boost)), k)


def expanded(asked: DataFrame, rows: DataFrame, k: int, level: str, embed: Embed) -> DataFrame:
    """(question, id, score, ord): results and what a level of expansion adds, first sighting of an id, best first.

    conservative: three more chunks of the files of the five best; moderate: two follow-up queries,
    four new results each; aggressive: fifteen chunks of the files of the three best, then moderate.
    """
    base = retrieve(asked, rows, k)
    lean = rows.select("id", "file_path", "start_line")
    first = relations.first_chunks(lean, 15 if level == "aggressive" else 8, PLACE)
    own = base.select("question", "id", "score", F.lit(0).alias("stage"))
    stages = [own]
    if level in ("conservative", "aggressive"):
        best, kept = (5, 3) if level == "conservative" else (3, 15)
        near = base.where(F.col("ord") <= best).select("question", F.col("id").alias("seed"), F.col("score").alias("seed_score"), "file_path").join(first, "file_path")
        fresh = near.join(own.select("question", "id"), ["question", "id"], "left_anti")
        few = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("question", "seed").orderBy("_place"))).where(F.col("_n") <= kept)
        score = F.col("seed_score") * 0.7 if level == "conservative" else F.lit(0.5)
        stages.append(few.groupBy("question", "id").agg(F.max(score).alias("score")).withColumn("stage", F.lit(1)))
    if level in ("moderate", "aggressive"):
        more = asked.select("question", F.posexplode(F.slice(Q.expansion_queries(F.col("query")), 1, 2)).alias("part", "query"))
        found = _retrieved_apart(_apart(more, embed), rows, 8)
        seen = own.select(F.col("question").alias("owner"), F.col("id").cast("string").alias("id"))
        fresh = found.join(seen, ["owner", "id"], "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy("question").orderBy("ord"))).where("_n <= 4")
        kind = dict(own.dtypes)["id"]
        again = fresh.groupBy(F.col("owner").alias("question"), F.col("id").cast(kind).alias("id")).agg((F.max("score") * 0.8).alias("score"))
        stages.append(again.withColumn("stage", F.lit(2)))
    together = stages[0]
    for stage in stages[1:]:
        together = together.unionByName(stage.select("question", "id", "score", "stage"))
    sighted = together.groupBy("question", "id").agg(F.min_by("score", "stage").alias("score"))
    return ranked(sighted)


def packed(found: DataFrame, max_tokens: int, files: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(question, context, tokens, chunks): results without what was ``seen``, windows widened in ``files``, repeats
    dropped, neighbours merged, packed in order of score."""
    if seen is not None:
        found = relations.unseen(found, seen)
    if files is not None:
        found = expansion.expand_windows(found, files)
    rows = ranked(found.drop("ord"))
    merged = fusion.merge_adjacent(fusion.drop_repeats(rows).select("question", "id").join(rows, ["question", "id"]), ["question", "file_path"])
    ordered = merged.withColumn("ord", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "file_path", "start_line")).cast("long"))
    headed = ordered.withColumn("content", F.concat(F.lit("# "), "file_path", F.lit(":"), "start_line", F.lit("-"), "end_line", F.lit("\n"), "content"))
    context = fusion.group_context(headed, "question", max_tokens)
    counts = ordered.groupBy("question").agg(F.sum("merged").alias("chunks"))
    return context.join(counts, "question").select("question", "context", F.col("used").alias("tokens"), "chunks")
