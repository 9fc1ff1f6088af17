"""Connected components of an edge table, by DataFrame joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node and root (the smallest node of its component) of every node in edges (a, b); any comparable type.

    Each round hangs every neighbour that is larger than a node on the node's smallest neighbour, then does the same with
    the smaller ones. Components become stars in a number of rounds that grows with the logarithm of their size. Every round
    is a written table; minima are summed up before they are shuffled, and the joins have two plain sides, so that
    Spark can split the rows of a large star.
    """
    now = materialize(_ordered(edges), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(_ordered(large), "large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = materialize(_ordered(small), "edges")
        mark, old = _mark(now), mark
        if mark == old:
            break
    else:
        raise RuntimeError(f"components were not found in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges with the larger node first, without loops."""
    return edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]
