"""Distributed union-find over a table of links, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import Stages


def _settled(e: DataFrame) -> bool:
    """Whether every vertex hangs on one other, on which nothing else is above: a forest of stars."""
    if e.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        return False
    return not e.select(F.col("b").alias("a")).distinct().join(e, "a", "left_semi").limit(1).count()


def connected_components(edges: DataFrame, stages: Stages, max_rounds: int = 40) -> DataFrame:
    """Label every vertex of ``edges(a, b)`` with the smallest id it can reach.

    Returns ``(id, component)`` for vertices that occur in a link; self links,
    nulls and repeated links are ignored.  Alternates the large-star and the
    small-star step until nothing moves: each step hangs the neighbours of a
    vertex on the smallest of them, so every round is a minimum per vertex
    (combined before the shuffle, and written) and a join with these minima whose
    shuffle nothing else shares, so that AQE can broadcast them or split a hub.
    Each round is written to the shared folder.  Raises if ``max_rounds`` is not
    enough, rather than return unfinished labels.
    """
    e = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stages.write(e)  # a > b
    for turn in range(max_rounds + 1):
        if _settled(e):
            break
        if turn == max_rounds:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
        sym = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stages.write(sym.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        # large star: neighbours above u hang on the smallest of u and its neighbours
        big = sym.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = stages.write(big)
        # small star: u and its neighbours below u hang on the smallest of them
        least = stages.write(big.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"))
        small = big.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        nxt = stages.write(small.filter("a <> b").distinct())
        stages.drop(big, low, least, e)
        e = nxt
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
