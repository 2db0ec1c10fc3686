"""Connected components by alternating large-star and small-star.

Each half-step is one aggregation (the least neighbour of every node, combined
before the shuffle) and one join; no node's neighbours are ever gathered.  A
node may have very many neighbours: its rows are a few bytes each, and AQE splits
such a partition of the join by map outputs.  After each pair of steps the edges
are written to the shared folder, which cuts the lineage; the loop ends when
every component is a star round its least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import write_shared


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every greater neighbour of a node to the least of the node's neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    greater = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return greater.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its lesser neighbours to the least of them.  Every edge has u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Is every greater end in one edge only, and no lesser end of another?  Then lesser ends are the components' least nodes."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    by_node = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
    return by_node.where("leaf > 1 or leaf > 0 and root > 0").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each linked node reaches.

    Rows with a null end and loops are no links; repeated links count once.
    Nodes that are their component's least have a row too.  No links give an empty table.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    links = write_shared(links, "links")
    while not _is_star_forest(links):
        links = write_shared(_small_star(_large_star(links)), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
