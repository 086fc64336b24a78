"""Connected components by alternating large and small stars, for edges of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's neighbours below it, and the node, are linked to the least of them. edges: a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    below = edges.join(least, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return below.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b), the root being the least node that is reachable from it.
    Each round is written to the shared folder. Stars shrink fast: the rounds are about the logarithm of the
    longest path. Edges with a = b and repeated edges do no harm; nulls must not occur."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    # exact sums, so that equal figures mean an equal set of edges but for hash collisions
    figures = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = materialize(edges, "edges")
    seen = figures(edges)
    for _ in range(most_rounds):
        edges = materialize(_small_star(_large_star(edges)), "edges")
        now = figures(edges)
        if now == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
