"""Connected components of an edge table, by alternating large-star and small-star steps.

Edges stay in DataFrames: each step aggregates the smallest neighbour of every node, combining before
the shuffle, and joins it back, so that no task gathers a node's neighbours. Every round is written
to the shared folder. Rounds go on until the edges form stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage

MOST_ROUNDS = 60


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link neighbours b of a (large: those above a; small: those below, and a itself) to the smallest m of a and its neighbours."""
    least = pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    own = pairs.withColumnRenamed("a", "_a").join(least, F.col("_a") == F.col("a"))
    if large:
        out = own.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = own.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, component for every node of edges (columns a, b; no nulls): component is the smallest node reachable."""
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        large = _star(_both_ways(now), large=True)
        now = stage(_star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), large=False), "edges")
        # Stars: every a once, and no b that is an a. The sums tell whether a round changed anything.
        got = now.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(got) == seen:
            break
        seen = tuple(got)
    else:
        raise RuntimeError(f"no stars after {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
