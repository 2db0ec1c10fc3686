"""Uniting, de-duplicating, merging and budgeting results.

Order-dependent folds run over the rows of one question (or one file of it), as
Catalyst aggregates over a sorted array: the group is a bounded result list,
never a corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import estimated_tokens, lines


def fuse_scores(sightings: DataFrame, by: list[str], bonus: float = 0.15) -> DataFrame:
    """(by..., score, sightings): the n-th sighting sets score = (score + new) / 2 * (1 + bonus * (n - 1)).

    ``sightings`` has the ``by`` columns, score and ord (order of arrival).
    """
    ordered = F.array_sort(F.collect_list(F.struct("ord", "score")))
    first = F.struct(F.get(F.col("_s"), F.lit(0))["score"].alias("score"), F.lit(1).alias("n"))

    def meet(state: Column, x: Column) -> Column:
        n = state["n"] + 1
        return F.struct((((state["score"] + x["score"]) / 2) * (1 + F.lit(bonus) * (n - 1))).alias("score"), n.alias("n"))

    folded = F.aggregate(F.slice("_s", F.lit(2), F.greatest(F.size("_s") - 1, F.lit(0))), first, meet)
    return sightings.groupBy(*by).agg(ordered.alias("_s")).select(*by, folded["score"].alias("score"), F.size("_s").cast("long").alias("sightings"))


def first_by_id(results: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return results.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def drop_repeats(results: DataFrame, question: str = "question") -> DataFrame:
    """Greedy, by question in order of ``ord``: drops rows whose trimmed content was seen, or that overlap a
    kept range of their file without being longer than it.

    Needs question, ord, id, file_path, content, start_line and end_line; adds nothing.
    """
    item = F.struct("ord", "id", "file_path", F.md5(F.trim("content").cast("binary")).alias("digest"), "start_line", "end_line")

    def decide(kept: Column, x: Column) -> Column:
        same = F.exists(kept, lambda k: k["digest"] == x["digest"])
        inside = F.exists(kept, lambda k: (k["file_path"] == x["file_path"]) & (k["start_line"] <= x["end_line"]) & (k["end_line"] >= x["start_line"]) & ((x["end_line"] - x["start_line"]) <= (k["end_line"] - k["start_line"])))
        return F.when(same | inside, kept).otherwise(F.concat(kept, F.array(x)))

    grouped = results.groupBy(question).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    empty = F.slice("_rows", 1, 0)
    kept = grouped.select(question, F.explode(F.aggregate("_rows", empty, decide)).alias("_k"))
    return kept.select(question, F.col("_k.id").alias("id"), F.col("_k.ord").alias("ord"))


def line_set(content: Column) -> Column:
    """The distinct stripped non-empty lines of the lower-cased content."""
    return F.array_distinct(F.filter(F.transform(lines(F.lower(content)), lambda x: F.trim(x)), lambda x: x != ""))


def drop_alike(results: DataFrame, question: str = "question", limit: float = 0.8, memory: int = 50, trimmed: int = 25) -> DataFrame:
    """Greedy, by question in order of ``ord``: drops rows whose line set is more than ``limit`` alike to a remembered one.

    Once more than ``memory`` rows are remembered, only the last ``trimmed`` are.
    """
    item = F.struct("ord", "id", line_set(F.col("content")).alias("lines"))
    start = F.struct(F.slice("_rows", 1, 0).alias("seen"), F.slice(F.transform("_rows", lambda r: r["id"]), 1, 0).alias("kept"))

    def decide(state: Column, x: Column) -> Column:
        def alike(k: Column) -> Column:
            union = F.size(F.array_union(k["lines"], x["lines"]))
            return F.when(union > 0, F.size(F.array_intersect(k["lines"], x["lines"])) / union).otherwise(F.lit(0.0)) > limit

        seen = F.concat(state["seen"], F.array(x))
        cut = F.when(F.size(seen) > memory, F.slice(seen, -trimmed, trimmed)).otherwise(seen)
        return F.when(F.exists(state["seen"], alike), state).otherwise(F.struct(cut.alias("seen"), F.concat(state["kept"], F.array(x["id"])).alias("kept")))

    grouped = results.groupBy(question).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    return grouped.select(question, F.posexplode(F.aggregate("_rows", start, decide)["kept"]).alias("pos", "id")).select(question, "id", F.col("pos").cast("long").alias("ord"))


def islands(results: DataFrame, by: list[str], gap: int = 5) -> DataFrame:
    """Adds ``island``: rows of one group join while they start at most ``gap`` lines past the greatest end so far."""
    order = Window.partitionBy(*by).orderBy("start_line", "ord")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start_line") > reach + gap, 1).otherwise(0)
    return results.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_fresh")


def merge_adjacent(results: DataFrame, by: list[str], gap: int = 5) -> DataFrame:
    """One row per island: lines spanned, greatest score, number of rows and merged content.

    Overlapping lines appear once; at most one missing line joins plainly, a
    wider gap leaves a marker.
    """
    item = F.struct("start_line", "ord", "end_line", "content")
    marked = islands(results, by, gap).groupBy(*by, "island").agg(F.array_sort(F.collect_list(item)).alias("_rows"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("score").alias("score"), F.count("*").alias("merged"))
    head = F.get(F.col("_rows"), F.lit(0))
    start = F.struct(head["content"].alias("text"), head["end_line"].alias("end"))

    def join(state: Column, x: Column) -> Column:
        shared = state["end"] - x["start_line"] + 1
        own = lines(x["content"])
        rest = F.array_join(F.slice(own, (shared + 1).cast("int"), F.greatest(F.size(own) - shared, F.lit(0)).cast("int")), "\n")
        cut = F.when(F.trim(rest) != "", F.concat(state["text"], F.lit("\n"), rest)).otherwise(state["text"])
        plain = F.concat(state["text"], F.lit("\n"), x["content"])
        text = F.when(x["start_line"] <= state["end"], F.when((shared > 0) & (shared < F.size(own)), cut).otherwise(plain)).when(x["start_line"] <= state["end"] + 2, plain).otherwise(F.concat(state["text"], F.lit("\n\n# ... (gap) ...\n\n"), x["content"]))
        return F.struct(text.alias("text"), F.greatest(state["end"], x["end_line"]).alias("end"))

    merged = F.aggregate(F.slice("_rows", F.lit(2), F.greatest(F.size("_rows") - 1, F.lit(0))), start, join)["text"]
    return marked.select(*by, "island", "start_line", "end_line", "score", "merged", merged.alias("content"))


def group_scores(results: DataFrame, by: list[str]) -> DataFrame:
    """Average score of each group, raised by 1.2 for a whole class and by a tenth for each row up to five."""
    made = results.groupBy(*by).agg(F.avg("score").alias("mean"), F.bool_or(F.col("chunk_type") == "class_complete").alias("whole"), F.count("*").alias("n"))
    score = F.col("mean") * F.when(F.col("whole"), 1.2).otherwise(1.0) * F.when(F.col("n") > 1, 1 + 0.1 * F.least("n", F.lit(5))).otherwise(1.0)
    return made.select(*by, "n", score.alias("group_score"))


def allocate_budget(groups: DataFrame, question: str, key: str, budget: int, reserve: int = 100, least: int = 200) -> DataFrame:
    """(question, key, tokens): groups by falling score each get their share of what remains, at least ``least``.

    Allocation stops when nothing remains; the last share may overdraw by less than ``least``.
    """
    item = F.struct((-F.col("group_score")).alias("order"), F.col(key).alias("key"), F.col("group_score").alias("score"))
    grouped = groups.groupBy(question).agg(F.array_sort(F.collect_list(item)).alias("_g"), F.sum("group_score").alias("_total"))
    none = F.transform(F.slice("_g", 1, 0), lambda g: F.struct(g["key"].alias("key"), F.lit(0).cast("long").alias("tokens")))
    start = F.struct(F.lit(max(0, budget - reserve)).cast("long").alias("left"), none.alias("given"))

    def give(state: Column, g: Column) -> Column:
        share = F.when(F.col("_total") > 0, F.floor(state["left"] * g["score"] / F.col("_total"))).otherwise(F.floor(state["left"] / F.size("_g"))).cast("long")
        tokens = F.greatest(F.lit(least).cast("long"), F.least(share, state["left"]))
        more = F.struct((state["left"] - tokens).alias("left"), F.concat(state["given"], F.array(F.struct(g["key"].alias("key"), tokens.alias("tokens")))).alias("given"))
        return F.when(state["left"] > 0, more).otherwise(state)

    given = grouped.select(question, F.posexplode(F.aggregate("_g", start, give)["given"]).alias("pos", "g"))
    return given.select(question, F.col("g.key").alias(key), F.col("g.tokens").alias("tokens"), F.col("pos").cast("long").alias("ord"))


def prefix_packing(results: DataFrame, question: str, budget: int, size: Column | None = None) -> DataFrame:
    """Rows in order while their running size stays within the budget (stops at the first that does not)."""
    size = F.length("content") if size is None else size
    order = Window.partitionBy(question).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("running", F.sum(size).over(order).cast("long")).where(F.col("running") <= budget)


def greedy_packing(items: DataFrame, question: str, budget: int) -> DataFrame:
    """(question, id, ord, tokens, truncated): items by falling relevance x importance.

    An item that does not fit is skipped and later, smaller ones may enter;
    but a *file* that does not fit while less than nine tenths are used is cut
    to the budget at a line's end, taken, and ends the packing.
    """
    tokens = estimated_tokens(F.col("content"))
    item = F.struct((-(F.col("relevance") * F.col("importance"))).alias("order"), F.col("ord"), F.col("id"), tokens.alias("tokens"), F.col("kind"), F.transform(lines(F.col("content")), lambda x: F.length(x)).alias("widths"))
    grouped = items.groupBy(question).agg(F.array_sort(F.collect_list(item)).alias("_i"))
    none = F.transform(F.slice("_i", 1, 0), lambda i: F.struct(i["id"].alias("id"), i["tokens"].alias("tokens"), F.lit(False).alias("truncated")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("done"), none.alias("taken"))

    def take(state: Column, i: Column) -> Column:
        room = (F.lit(budget) - state["used"]) * 4
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(True).alias("open"))
        whole = F.aggregate(i["widths"], zero, lambda a, w: F.struct(F.when(a["open"] & (a["n"] + w + 1 <= room), a["n"] + w + 1).otherwise(a["n"]).cast("long").alias("n"), (a["open"] & (a["n"] + w + 1 <= room)).alias("open")))["n"]
        entry = lambda n, cut: F.concat(state["taken"], F.array(F.struct(i["id"].alias("id"), n.alias("tokens"), F.lit(cut).alias("truncated"))))
        fits = state["used"] + i["tokens"] <= budget
        cut_tokens = F.greatest(F.lit(1).cast("long"), F.floor(whole / 4).cast("long"))
        cut = (i["kind"] == "file") & (state["used"] < 0.9 * budget) & (whole > 0)
        return (
            F.when(state["done"], state)
            .when(fits, F.struct((state["used"] + i["tokens"]).alias("used"), F.lit(False).alias("done"), entry(i["tokens"], False).alias("taken")))
            .when(cut, F.struct((state["used"] + cut_tokens).alias("used"), F.lit(True).alias("done"), entry(cut_tokens, True).alias("taken")))
            .otherwise(state)
        )

    packed = grouped.select(question, F.posexplode(F.aggregate("_i", start, take)["taken"]).alias("pos", "t"))
    return packed.select(question, F.col("t.id").alias("id"), F.col("pos").cast("long").alias("ord"), F.col("t.tokens").alias("tokens"), F.col("t.truncated").alias("truncated"))


def group_context(results: DataFrame, question: str, budget: int, least_rest: int = 50) -> DataFrame:
    """(question, context, used): rows in order until one overflows the budget; of that one the lines that still fit,
    if at least ``least_rest`` tokens are left."""
    tokens = estimated_tokens(F.col("content"))
    item = F.struct("ord", "content", tokens.alias("tokens"))
    grouped = results.groupBy(question).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("done"), F.transform(F.slice("_rows", 1, 0), lambda r: r["content"]).alias("parts"))

    def add(state: Column, r: Column) -> Column:
        room = (F.lit(budget) - state["used"]) * 4
        zero = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("n"), F.lit(True).alias("open"))
        seen = F.aggregate(lines(r["content"]), zero, lambda a, x: F.when(a["open"] & (a["size"] + F.length(x) + 1 <= room), F.struct((a["size"] + F.length(x) + 1).cast("long").alias("size"), (a["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(a["size"].alias("size"), a["n"].alias("n"), F.lit(False).alias("open"))))
        rest = F.array_join(F.slice(lines(r["content"]), F.lit(1), seen["n"]), "\n")
        grow = lambda text, used, done: F.struct(used.alias("used"), F.lit(done).alias("done"), F.concat(state["parts"], F.array(text)).alias("parts"))
        return (
            F.when(state["done"], state)
            .when(state["used"] + r["tokens"] <= budget, grow(r["content"], state["used"] + r["tokens"], False))
            .when((F.lit(budget) - state["used"] >= least_rest) & (seen["n"] > 0), grow(rest, state["used"] + F.floor(seen["size"] / 4).cast("long"), True))
            .otherwise(F.struct(state["used"].alias("used"), F.lit(True).alias("done"), state["parts"].alias("parts")))
        )

    folded = grouped.select(question, F.aggregate("_rows", start, add).alias("_f"))
    return folded.select(question, F.array_join("_f.parts", "\n\n").alias("context"), F.col("_f.used").alias("used"))


def symbol_map(symbols: DataFrame) -> DataFrame:
    """(symbol, file_path, n): the last file, by path, that defines a symbol, and how many do."""
    return symbols.groupBy("symbol").agg(F.max("file_path").alias("file_path"), F.count("*").alias("n"))


def symbols_by_file(symbols: DataFrame) -> DataFrame:
    """(file_path, symbols): a file's symbols in the order of their lines."""
    ordered = F.array_sort(F.collect_list(F.struct("start_line", "symbol")))
    return symbols.groupBy("file_path").agg(F.transform(ordered, lambda x: x["symbol"]).alias("symbols"))
