"""Equi joins that stay safe when the small side grows or one key holds much of the big side.

Three ways, chosen by measured size:

* a small side proven to fit is broadcast, so the big side is neither shuffled nor skewed;
* otherwise both sides are shuffled on the key plus a salt, where only keys with more rows than one
  task should take get more than one salt. The other side's rows of such a key are repeated once
  per salt;
* with no hot key the salt is constant and the join is an ordinary shuffle join.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

# A broadcast side may have so many rows and, strings measured, so many bytes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
# Bytes of a row and of each column besides the bytes of strings.
ROW_BYTES, COLUMN_BYTES = 16, 16
# Rows of one key that a single task may take before the key is salted.
TASK_ROWS = 5_000_000
# Rows without a key match nothing and are dealt over so many salts.
NULL_SALTS = 10_000


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most max_rows rows and max_bytes bytes. One job that reads no more than one row
    past the limit. Tables with nested columns are not measured and never fit."""
    if any(isinstance(f.dataType, (ArrayType, MapType, StructType)) for f in df.schema):
        return False
    text = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, (StringType, BinaryType))]
    wide = F.lit(ROW_BYTES + COLUMN_BYTES * len(df.columns)).cast("long")
    for length in text:
        wide = wide + length
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(wide), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def hot_keys(df: DataFrame, on: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """All keys with more than task_rows rows and the number of salts they need: at most one row for
    every task_rows rows of df."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.where(F.col("_rows") > task_rows).select(
        *on, F.ceil(F.col("_rows") / task_rows).cast("int").alias("_salts")
    )


def spread_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str,
    salt_by: Column,
    max_rows: int = BROADCAST_ROWS,
    task_rows: int = TASK_ROWS,
    small_fits: bool | None = None,
) -> DataFrame:
    """Join ``big`` to ``small`` on equal column names. ``how`` may be any kind that keeps or drops
    rows of ``big`` (inner, left, left_semi, left_anti); repeating ``small`` is harmless for those.

    ``salt_by`` spreads the rows of a hot key and should vary within it. ``small_fits`` passes on an
    earlier answer of :func:`fits` for the same table."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join kind: {how}")
    if fits(small, max_rows) if small_fits is None else small_fits:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how, salt_by, task_rows)


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str, salt_by: Column, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Join on the key plus a salt. The salts of hot keys are broadcast if they fit; else both sides meet
    them by a shuffle."""
    hot = hot_keys(big, on, task_rows)
    if fits(hot):
        hot = F.broadcast(hot)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    no_key = reduce(or_, [F.col(k).isNull() for k in on])
    # A row without a key matches nothing, so it may go anywhere.
    left = (
        big.withColumn("_spread", F.xxhash64(salt_by))
        .join(hot, on, "left")
        .withColumn("_salt", F.pmod(F.col("_spread"), F.when(no_key, NULL_SALTS).otherwise(salts)).cast("int"))
        .drop("_spread", "_salts")
    )
    right = (
        small.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return left.join(right, [*on, "_salt"], how).drop("_salt")
