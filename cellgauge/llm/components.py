"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """Columns node, root: the smallest node each node of an edge can reach. ``edges`` has the two columns
    a and b of one type; loops, nulls, repeats and both directions are harmless, and no edge gives no row.

    Each node's smallest neighbour is an aggregate with map-side combine, and its edges meet it in a join
    that adaptive execution splits, so a node with a third of all edges is no hot task. The number of
    rounds grows with the logarithm of the longest path. Nothing but one count and one sum a round
    reaches the driver."""
    now = settle(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = _mark(now)
    while mark[0]:
        now = settle(_small_star(_large_star(now)), "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select("v", "v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node point to its smallest one (or the node itself)."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lower = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.union(least.select("u", "m")).distinct()
