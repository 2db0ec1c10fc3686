"""Dependency graphs: importance scores, shortest paths, file relevance.

``nodes`` has key; ``edges`` has src and dst, "src depends on dst".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.rerank import file_name_relevance, symbol_relevance
from quarry.session import write_scratch


def importance(nodes: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """(key, importance): starts at 1; each round 0.15 + 0.85 * sum over dependents of score / out-degree.

    Not divided by the number of nodes, and nothing is redistributed from nodes
    without dependencies.  Edges get their source's out-degree once; then a round is
    one join and one partial aggregation, and one join that keeps nodes without dependents.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    weighted = write_scratch(edges.select("src", "dst").join(out, "src"), "weighted")
    scores = nodes.select("key").distinct().withColumn("importance", F.lit(1.0))
    for k in range(1, rounds + 1):
        gifts = weighted.join(scores.withColumnRenamed("key", "src"), "src").select(F.col("dst").alias("key"), (F.col("importance") / F.col("degree")).alias("gift"))
        received = gifts.groupBy("key").agg(F.sum("gift").alias("got"))
        scores = scores.select("key").join(received, "key", "left").select("key", ((1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("importance"))
        if k % cut_every == 0 and k < rounds:
            scores = write_scratch(scores, "importance")
    return scores


def shortest_paths(edges: DataFrame, source: str) -> DataFrame:
    """(key, distance, path): fewest steps from ``source``; among equals the least path as text.

    A breadth-first frontier: each round joins the frontier to the edges and
    keeps the nodes not reached before, until no node is new.
    """
    start = edges.sparkSession.createDataFrame([(source, 0, source)], "key string, distance int, path string")
    reached, frontier = start, start
    while True:
        step = frontier.join(edges, F.col("key") == F.col("src")).select(F.col("dst").alias("key"), (F.col("distance") + 1).alias("distance"), F.concat("path", F.lit(">"), "dst").alias("path"))
        fresh = step.groupBy("key").agg(F.min("distance").alias("distance"), F.min("path").alias("path")).join(reached.select("key"), "key", "left_anti")
        frontier = write_scratch(fresh, "frontier")
        if frontier.isEmpty():
            break
        reached = write_scratch(reached.union(frontier), "reached")
    return reached


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes by kind, dependencies in all and on average."""
    by_kind = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "symbol").alias("symbols"))
    total = edges.agg(F.count("*").alias("dependencies"))
    return by_kind.join(F.broadcast(total)).withColumn("average", F.coalesce(F.col("dependencies") / F.nullif(F.col("nodes"), F.lit(0)), F.lit(0.0)))


def relevant_files(files: DataFrame, symbols: DataFrame, exports: DataFrame, terms: list[str], most: int) -> DataFrame:
    """(file_path, score): symbols' relevance x importance, the file's name and half of the exports' relevance; above 0 only."""
    wanted: Column = F.array(*[F.lit(t) for t in terms])
    by_symbol = symbols.groupBy("file_path").agg(F.sum(symbol_relevance(F.col("name"), wanted) * F.col("importance")).alias("s"))
    by_export = exports.groupBy("file_path").agg(F.sum(0.5 * symbol_relevance(F.col("name"), wanted)).alias("e"))
    joined = files.select("file_path").distinct().join(by_symbol, "file_path", "left").join(by_export, "file_path", "left")
    score = F.coalesce("s", F.lit(0.0)) + F.coalesce("e", F.lit(0.0)) + file_name_relevance(F.col("file_path"), wanted)
    return joined.select("file_path", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "file_path").limit(most)


def most_depended(edges: DataFrame, most: int) -> DataFrame:
    """Per source kind the destinations with most dependents."""
    counted = edges.groupBy("dst").agg(F.count("*").alias("dependents"))
    return counted.orderBy(F.desc("dependents"), "dst").limit(most)


def rank_within(df: DataFrame, by: str, order: list, most: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
