"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is one aggregation and one join on a node; neighbour lists are never gathered, so a node of any degree is
pre-aggregated before its minimum is shuffled, and the join's large side may be split. Every round is a table in the shared
folder. The number of rounds grows with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b, or both directions for the large star."""
    low = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = edges.join(low, "a")
    if large:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    moved = met.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
    return moved.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b")


def _stars(edges: DataFrame) -> bool:
    """Whether every node but the roots has one edge (a > b), to a root: then the edges are the components."""
    rows, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("a")).head()
    return rows == nodes and edges.select(F.col("b").alias("a")).distinct().join(edges, "a", "left_semi").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node that it is connected with) for every node with an edge.

    edges: columns a and b of one orderable type, in any direction, repeats allowed; nulls and loops are left out. An empty
    table gives an empty result.
    """
    plain = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = workspace.stage(plain, "edges")
    while not _stars(now):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        grown = _star(both, large=True).distinct()
        now = workspace.stage(_star(grown, large=False).distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
