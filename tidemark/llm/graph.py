"""Connected components of an edge table by alternating large-star and small-star rounds.

Edges are rows (a, b) of longs. Each round is a few shuffles of the edges that are left, and is
written to shared storage, where it takes the place of the one before; rounds grow with the logarithm of the longest path. Nothing is collected
but two numbers a round, which tell whether anything changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    pairs = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return pairs.select("e.a", "e.b").where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the least node of its component, for every node with an edge except the roots."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    mark = None
    for _ in range(rounds):
        before, now = now, materialize(_small_star(_large_star(now)), "edges")
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
