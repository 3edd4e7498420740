"""Connected components of an edge table by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b: long); component is the smallest node that can be reached.

    Alternating star contraction: each node's neighbours are tied to the smallest of them, first the larger ones, then the
    smaller ones. The number of rounds grows with the logarithm of a component's size, and edges never exceed the input's.
    A node with very many neighbours is one group of a hash aggregate (a minimum, combined before the shuffle) and one key of
    an equi-join that adaptive execution can split; no list of neighbours is built.
    """

    def star(e: DataFrame, larger: bool) -> DataFrame:
        """Ties every neighbour of u (the larger ones, or those not above u) to the least node of u and its neighbours."""
        if larger:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        tied = both.join(least, "a")
        out = tied.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else tied.select("b", "m").union(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.filter("a <> b").distinct()

    now = materialize(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        now = materialize(star(star(now, True), False), "edges")
        # a forest of stars is a fixed point: its size, and sums of its ends, no longer change
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
