"""Deterministic selection of n rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this many rows the per-task top-n and its merge stay small.
TOP_N_ROWS = 10_000


def take_by_hash(df: DataFrame, n: int, priority: Column, digest: Column, top_n_rows: int = TOP_N_ROWS) -> DataFrame:
    """The n rows with the lowest (priority, digest), where digest is a hex string.

    A small n is a per-task top-n. A large n never passes through one task: rows are counted per
    (priority, first three digits), which is at most a few thousand groups, and only rows of the one
    group that straddles the limit are ranked."""
    tagged = df.withColumn("_priority", priority).withColumn("_digest", digest)
    if n <= top_n_rows:
        picked = tagged.orderBy("_priority", "_digest").limit(n)
        return picked.drop("_priority", "_digest")

    group = ["_priority", "_slot"]
    tagged = tagged.withColumn("_slot", F.substring("_digest", 1, 3))
    running = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = (
        tagged.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_through", F.sum("_rows").over(running))
        .select(*group, (F.lit(n) - F.col("_through") + F.col("_rows")).alias("_left"), "_rows")
    )
    marked = tagged.join(F.broadcast(budget), group).where(F.col("_left") > 0)
    whole = marked.where(F.col("_rows") <= F.col("_left"))
    straddling = (
        marked.where(F.col("_rows") > F.col("_left"))
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy("_digest")))
        .where(F.col("_rank") <= F.col("_left"))
        .drop("_rank")
    )
    return whole.unionByName(straddling).drop("_priority", "_digest", "_slot", "_left", "_rows")
