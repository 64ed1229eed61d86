"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgauge.operators.joins import fits, spread_join
from cellgauge.sources.lake import scratch_path

# Characters that part words: space and the six from tab to carriage return.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
# Buckets over which a group's rows are numbered. Fixed, so the table of their counts is bounded.
RANK_BUCKETS_LOG2 = 13


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the cluster's shared folder and read it back: lineage is cut, and a lost
    executor costs nothing that was done before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: Column) -> Column:
    """Hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def single(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """df with one row, the smallest, of rows that agree in ``keys``. Rows without a key stay.

    Keys alone are counted first: only rows that are repeated get shuffled whole, with map-side combine, and a table
    without repeats is passed on as it is."""
    keys = list(keys)
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    again = settle(counts.where("_n > 1").select(*keys), f"{name}-repeated")
    if again.isEmpty():
        return df
    small = fits(again)
    # Rows of one key may be equal in all columns, so their place spreads them.
    at = F.monotonically_increasing_id()
    held = spread_join(df, again, keys, "left_semi", at, small_fits=small)
    one = held.groupBy(*keys).agg(F.min(F.struct(*df.columns)).alias("_one")).select("_one.*")
    rest = spread_join(df, again, keys, "left_anti", at, small_fits=small).select(*df.columns)
    return (rest if small else settle(rest, f"{name}-rest")).unionByName(settle(one, f"{name}-single"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def numbered(df: DataFrame, by: Sequence[str], order: Column, ties: Sequence[Column] = (), out: str = "_row") -> DataFrame:
    """df with a column ``out``: each row's number in its group ``by``, gapless from 0, along the hash of
    ``order``. Rows with the same order are numbered along ``ties``.

    Two levels: rows are numbered within a hash bucket of their group, and a bucket starts where the
    smaller ones end. So a group with a third of all rows is spread over all tasks. The table of bucket
    counts has at most 2^13 rows a group."""
    keyed = df.withColumns(
        {"_order": F.xxhash64(order), "_group": F.xxhash64(*by) if by else F.lit(0).cast("long")}
    ).withColumn("_bucket", F.shiftrightunsigned(F.col("_order"), 64 - RANK_BUCKETS_LOG2))
    counts = keyed.groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_group", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_group", "_bucket").orderBy("_order", *ties)
    placed = keyed.withColumn("_n", F.row_number().over(inside) - 1)
    # The window has already dealt the rows by the keys of the join.
    return (
        placed.join(starts if by else F.broadcast(starts), ["_group", "_bucket"])
        .withColumn(out, F.col("_start") + F.col("_n"))
        .drop("_group", "_order", "_bucket", "_n", "_start")
    )


def ranked(df: DataFrame, order: Sequence[str], name: str, out: str = "_rank") -> DataFrame:
    """df with a column ``out``: each row's number in the whole table along ``order``, gapless from 0. Rows are dealt by
    ranges and written in their order; where a range starts is one number for each of them."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = settle(laid, name)
    part, start, starts = F.shiftright("_at", 33), 0, []
    for p, n in sorted(map(tuple, laid.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())):
        starts.append((p, start))
        start += n
    told = df.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    met = laid.withColumn("_part", part.cast("long")).join(F.broadcast(told), "_part")
    return met.withColumn(out, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", "_at")
