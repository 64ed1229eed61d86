"""Date-partitioned Parquet tables, dated file trees, alert snapshots and relational tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Mapping
from datetime import date
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PARTITION = "partition_date"
ZONES = ("raw", "staging", "curated")


def write_dates(df: DataFrame, path: str, sort_by: Iterable[str] = ("tower_id",)) -> None:
    """Replace the dates present in df and leave all others alone; writing a date again changes nothing.

    Rows are rebalanced by date, which gives one date few files but splits a date too large for one
    task. Sorting within files lets a reader of one tower skip most row groups."""
    balanced = df.hint("rebalance", F.col(PARTITION)).sortWithinPartitions(PARTITION, *sort_by)
    (
        balanced.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PARTITION)
        .parquet(path)
    )


def read_dates(
    spark: SparkSession, path: str, schema: StructType, first: date | None = None, last: date | None = None
) -> DataFrame:
    """Partitioned table, or the dates from first to last; other directories are not opened."""
    df = spark.read.schema(schema).parquet(path)
    if first is not None:
        df = df.where(F.col(PARTITION) >= F.lit(first))
    if last is not None:
        df = df.where(F.col(PARTITION) <= F.lit(last))
    return df


def row_count(spark: SparkSession, path: str, schema: StructType, day: date | None = None) -> int:
    """Rows of a table or of one date; answered from file footers, no column is read."""
    return read_dates(spark, path, schema, day, day).count()


def dated_path(root: str, zone: str, dataset: str, day: date, filename: str = "data.parquet") -> str:
    if zone not in ZONES:
        raise ValueError(f"Unknown zone: {zone}")
    return f"{root}/{zone}/{dataset}/{day:%Y/%m/%d}/{filename}"


def read_dated_tree(
    spark: SparkSession, root: str, zone: str, dataset: str, days: Iterable[date] | None, schema: StructType
) -> DataFrame:
    """Files laid out as zone/dataset/YYYY/MM/DD, with the date taken from the path. With ``days`` only
    those files are listed."""
    if days is None:
        paths = [f"{root}/{zone}/{dataset}/*/*/*/*.parquet"]
    else:
        paths = [dated_path(root, zone, dataset, d) for d in days]
    stored = StructType([f for f in schema.fields if f.name != PARTITION])
    files = spark.read.schema(stored).parquet(*paths)
    day = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4}/\d{2}/\d{2})/[^/]+$", 1)
    return files.withColumn(PARTITION, F.to_date(day, "yyyy/MM/dd"))


def write_dated_tree(df: DataFrame, root: str, zone: str, dataset: str) -> None:
    """Lay the rows out as zone/dataset/YYYY/MM/DD. All dates are written by one job next to the tree; their folders then move
    into it one by one, each replacing the date that was there."""
    if zone not in ZONES:
        raise ValueError(f"Unknown zone: {zone}")
    spark = df.sparkSession
    tree, aside = f"{root}/{zone}/{dataset}", f"{root}/{zone}/_{dataset}-{uuid.uuid4().hex}"
    day = F.date_format(PARTITION, "yyyy-MM-dd")
    df.withColumn("_day", day).drop(PARTITION).hint("rebalance", F.col("_day")).write.partitionBy("_day").parquet(aside)
    folder = spark._jvm.org.apache.hadoop.fs.Path
    fs = folder(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder(aside)):
        name = status.getPath().getName()
        if name.startswith("_day="):
            target = folder(f"{tree}/{name[5:].replace('-', '/')}")
            fs.delete(target, True)
            fs.mkdirs(target.getParent())
            fs.rename(status.getPath(), target)
    fs.delete(folder(aside), True)


def row_counts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(partition_date, row_count) of each date of a table. No column is read, only what the files say about themselves."""
    return read_dates(spark, path, schema).groupBy(PARTITION).agg(F.count(F.lit(1)).alias("row_count"))


def new_snapshot(df: DataFrame, root: str) -> str:
    """Write df to a directory of its own under root and return it. The path being read is never
    overwritten, so a failed run leaves the previous snapshot whole."""
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


@cache
def _local_dir() -> str:
    """One folder for this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="cellgauge-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in spark.checkpoint.dir. Only a local master,
    whose executors are this process, may do without; the session's settings are not touched."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir()


def scratch_path(spark: SparkSession, name: str, root: str | None = None) -> str:
    """New path for a table of intermediate results, under ``root`` or the shared folder."""
    return f"{root or shared_dir(spark)}/cellgauge/{name}-{uuid.uuid4().hex}"


def partition_dates(table: DataFrame) -> list[date]:
    """Dates of a date-partitioned file table, ascending, from its listing: no file is opened. Empty if the
    table does not come straight from such files."""
    found = (re.findall(rf"/{PARTITION}=(\d{{4}}-\d{{2}}-\d{{2}})/", f) for f in table.inputFiles())
    return sorted({date.fromisoformat(x[-1]) for x in found if x})


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str] | None = None,
    partition_column: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    partitions: int = 64,
) -> DataFrame:
    """Relational table; with a partition column it is read by that many tasks at once."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {}))
    if partition_column is not None:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", lower)
            .option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    return reader.load()


def write_table(
    df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None, mode: str = "append"
) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {})).mode(mode).save()
