"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations with partial minima and joins on the node (whose
skew adaptive execution splits), written to the shared folder; no node's
neighbours are gathered in one task and nothing but two numbers a round reaches
the driver. Rounds grow with the logarithm of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import discard, written


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours v, for edges (u, v)."""
    return edges.groupBy("u").agg(F.min("v").alias("_v")).select(F.col("u").alias("_u"), F.least("u", "_v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    return both.filter("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    joined = edges.join(least, F.col("u") == F.col("_u"))
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, name: str = "stars", rows: int | None = None) -> DataFrame:
    """(u, v) with v the smallest node of u's component, for every node of an edge but the smallest ones.

    ``edges``: columns u and v of one integer type; loops, doubled and nulls don't matter. No edges give an empty table. ``rows``: at most so many edges, if that is known.
    """
    least, most = F.least("u", "v"), F.greatest("u", "v")
    now = written(edges.filter("u <> v").select(most.alias("u"), least.alias("v")).distinct(), name, rows=rows)
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
        if seen.n == 0 or mark == (seen.n, seen.s):
            return now
        mark = (seen.n, seen.s)
        before, now = now, written(_small_star(_large_star(now)), name, rows=2 * seen.n)
        discard(before)
