"""The driver's tables seen as a cell network.

suppliers are towers, events are readings and sessions, customers are subscribers, orders are open
cell-site rows, nations are provinces. All of it is derived by Spark from the whole tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellgauge.functions.columns import hour_floor, sensor_fault
from cellgauge.network import Network
from cellgauge.operators.joins import fits, spread_join
from cellgauge.schemas import (
    ALERT_SCHEMA,
    SESSION_SCHEMA,
    SUBSCRIBER_SCHEMA,
    TELEMETRY_SCHEMA,
    TOWER_SCHEMA,
    default_thresholds,
)


@cache
def _schema(application: str, path: str) -> StructType:
    """Columns of a given table, asked for once by an application: Spark runs a job for them at each read."""
    return SparkSession.active().read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its files are listed anew each time; only its columns are taken as they were."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(spark.sparkContext.applicationId, path)).parquet(path)


def _pick(key: Column, values: list) -> Column:
    out = F.when(key == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:-1], 1):
        out = out.when(key == i, F.lit(v))
    return out.otherwise(F.lit(values[-1]))


def bind_towers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    places = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name", "r_name")
    )
    rows = table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    kind = (
        F.when(F.col("s_acctbal") < 1500, "urban").when(F.col("s_acctbal") <= 6000, "suburban").otherwise("rural")
    )
    return rows.select(
        k.cast("string").alias("tower_id"),
        _pick(k % 3, ["LTE", "UMTS", "GSM"]).alias("radio"),
        F.lit(510).alias("mcc"),
        _pick(k % 4, [1, 8, 11, 21]).alias("mnc"),
        (k % 100).cast("int").alias("area"),
        k.alias("cell"),
        (F.lit(106.0) + F.floor(k / 10) * 0.01).alias("lon"),
        (F.lit(-6.0) + (k % 10) * 0.01).alias("lat"),
        (k * 100 % 9000).cast("int").alias("range_m"),
        (k % 40).cast("int").alias("samples"),
        F.lit(1).alias("changeable"),
        kind.alias("cell_type"),
        F.col("n_name").alias("province_name"),
        F.col("r_name").alias("island_group"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("last_updated"),
        F.lit(None).cast("timestamp_ntz").alias("seeded_at"),
    ).select(*TOWER_SCHEMA.names)


def bind_telemetry(spark: SparkSession, sf_dir: str, towers: DataFrame, towers_fit: bool) -> DataFrame:
    """One reading per tower and hour, that of the smallest event id. A busy tower's events fold to its
    hours before the shuffle."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("tower_id"), hour_floor("ts").alias("event_hour"), "event_id", "value"
    )
    known = spread_join(
        events, towers.select("tower_id"), ["tower_id"], "left_semi", F.col("event_id"), small_fits=towers_fit
    )
    e = F.col("_e")
    return (
        known.groupBy("tower_id", "event_hour")
        .agg(F.min("event_id").alias("_e"), F.min_by("value", "event_id").alias("prb_utilization"))
        .select(
            "tower_id",
            "event_hour",
            "prb_utilization",
            (F.lit(40.0) + e % 21).alias("throughput_mbps"),
            (F.lit(5.0) + e % 60).alias("latency_ms"),
            ((e % 50) / F.lit(10.0)).alias("dropped_call_rate"),
            (e % 40).cast("int").alias("handover_count"),
            (e % 97 + 1).cast("int").alias("connected_subscribers"),
            sensor_fault("prb_utilization").alias("is_sensor_fault"),
            F.to_date("event_hour").alias("partition_date"),
        )
        .select(*TELEMETRY_SCHEMA.names)
    )


def bind_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("subscriber_id"),
        F.lower("c_mktsegment").alias("plan_tier"),
        F.col("c_nationkey").cast("string").alias("home_region"),
        F.lit(None).cast("timestamp_ntz").alias("seeded_at"),
    ).select(*SUBSCRIBER_SCHEMA.names)


def raw_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.floor("value").cast("int"))
    return table(spark, sf_dir, "events").select(
        (e % 2000).cast("string").alias("subscriber_id"),
        F.when(e % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).cast("string").alias("tower_id"),
        F.col("ts").alias("session_start"),
        (F.col("ts") + minutes).alias("session_end"),
        F.col("value").alias("session_duration_min"),
        F.when(F.col("event_type") == "error", "SMS")
        .when(F.col("event_type") == "signup", "voice")
        .otherwise("data")
        .alias("service_type"),
        (e * 1000).alias("bytes_transferred"),
        "event_id",
    )


def bind_sessions(
    spark: SparkSession, sf_dir: str, towers: DataFrame, subscribers: DataFrame, towers_fit: bool
) -> DataFrame:
    by_tower = spread_join(
        raw_sessions(spark, sf_dir),
        towers.select("tower_id"),
        ["tower_id"],
        "left_semi",
        F.col("event_id"),
        small_fits=towers_fit,
    )
    known = spread_join(
        by_tower, subscribers.select("subscriber_id"), ["subscriber_id"], "left_semi", F.col("event_id")
    )
    return known.withColumn("partition_date", F.to_date("session_start")).select(*SESSION_SCHEMA.names)


def dirty_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as delivered: hour and PRB as text, some without tower, number or counter."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.when(e % 89 != 0, F.col("user_id").cast("string")).alias("tower_id"),
        F.when(e % 101 == 0, "not a time").otherwise(hour_floor("ts").cast("string")).alias("event_hour"),
        F.when(e % 97 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("prb_utilization"),
        (F.lit(40.0) + e % 21).alias("throughput_mbps"),
        (F.lit(5.0) + e % 60).alias("latency_ms"),
        ((e % 50) / F.lit(10.0)).alias("dropped_call_rate"),
        # One in 211 is beyond a 32-bit counter.
        F.when(e % 83 != 0, F.when(e % 211 == 0, 3e9).otherwise((e % 40).cast("double"))).alias("handover_count"),
        (e % 97 + 1).cast("double").alias("connected_subscribers"),
        "event_id",
    )


def dirty_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as delivered, with repeated ones, missing fields and byte counts that no double holds."""
    e = F.col("event_id")
    large = F.when(e % 73 == 0, F.lit(9007199254740993)).otherwise(F.lit(0))
    clean = raw_sessions(spark, sf_dir).withColumn("bytes_transferred", F.col("bytes_transferred") + large)
    again = clean.where(e % 10 == 0).withColumns(
        {
            "service_type": F.when(e % 30 != 0, "voice"),
            "session_duration_min": F.col("session_duration_min") + 1,
            "session_end": F.when(e % 20 != 0, F.col("session_end")),
        }
    )
    return clean.unionByName(again).drop("event_id")


def bind_alerts(towers: DataFrame) -> DataFrame:
    """Alerts left by earlier runs: by tower number an active hotspot, a resolved one, an active pattern."""
    k = F.col("cell")
    kind = k % 3
    at = F.lit("2024-01-05").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (k % 10).cast("int"))
    return towers.select(
        (k + 1).alias("alert_id"),
        "tower_id",
        F.when(kind == 2, "PATTERN").when(k % 2 == 0, "CRITICAL").otherwise("WARN").alias("alert_type"),
        F.when(kind == 2, "PEAK_HOUR").otherwise("HOTSPOT").alias("alert_category"),
        F.when((kind != 2) & (k % 2 == 0), 3).otherwise(2).alias("severity"),
        F.concat(F.lit("Earlier alert "), "tower_id").alias("message"),
        at.alias("triggered_at"),
        F.when(kind == 1, at + F.expr("INTERVAL 1 DAY")).alias("resolved_at"),
        F.when(kind == 1, "RESOLVED").otherwise("ACTIVE").alias("status"),
    ).select(*ALERT_SCHEMA.names)


def bind_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open cell-site rows with repeats, foreign cells, weak cells and cells without place."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderpriority").isin("1-URGENT", "4-NOT SPECIFIED"), "LTE")
        .when(F.col("o_orderpriority") == "2-HIGH", "UMTS")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "GSM")
        .otherwise("CDMA")
        .alias("radio"),
        F.when(k % 7 == 0, 404).otherwise(510).alias("mcc"),
        _pick(c % 5, [1, 8, 11, 21, 89]).alias("net"),
        (c % 50).cast("int").alias("area"),
        (c * 3 + k % 3).alias("cell"),
        F.lit(0).alias("unit"),
        (F.lit(106.0) + (k * 7919 % 100003) / F.lit(20000.6)).alias("lon"),
        F.when(k % 29 != 0, F.lit(-9.0) + (k * 104729 % 100019) / F.lit(20003.8)).alias("lat"),
        F.when(k % 11 != 0, F.floor(F.col("o_totalprice") / 50).cast("int")).alias("range"),
        (k % 6).cast("int").alias("samples"),
        F.lit(1).alias("changeable"),
        F.lit(1600000000).cast("bigint").alias("created"),
        F.when(k % 13 != 0, day * 86400 + k % 86400).alias("updated"),
        F.lit(-85).alias("averageSignal"),
    )


def bind_provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(province_name, polygons): per nation a triangle, an L, or a square with a hole, on a 5 x 5 grid."""
    n = F.col("n_nationkey")
    x, y = (F.lit(106.0) + n % 5), (F.lit(-9.0) + F.floor(n / 5))

    def ring(*corners: tuple[float, float]) -> Column:
        return F.array(*(F.array(x + dx, y + dy) for dx, dy in corners))

    triangle = F.array(ring((0.0, 0.0), (1.0, 0.0), (0.5, 0.875), (0.0, 0.0)))
    corner = F.array(ring((0.0, 0.0), (1.0, 0.0), (1.0, 0.25), (0.25, 0.25), (0.25, 1.0), (0.0, 1.0), (0.0, 0.0)))
    frame = F.array(
        ring((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)),
        ring((0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75), (0.25, 0.25)),
    )
    shape = F.when(n % 3 == 0, triangle).when(n % 3 == 1, corner).otherwise(frame)
    name = _pick(n, ["Aceh", "Bali", "Banten", "Papua", None])
    return table(spark, sf_dir, "nation").select(
        F.coalesce(name, F.col("n_name")).alias("province_name"), F.array(shape).alias("polygons")
    )


def bind_network(spark: SparkSession, sf_dir: str) -> Network:
    towers = bind_towers(spark, sf_dir)
    # Towers are suppliers with a nation, so the suppliers bound them; that is measured once a query, without the joins.
    towers_fit = fits(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string")))
    return Network(
        towers=towers,
        thresholds=default_thresholds(spark),
        telemetry=lambda: bind_telemetry(spark, sf_dir, towers, towers_fit),
        sessions=lambda: bind_sessions(spark, sf_dir, towers, bind_subscribers(spark, sf_dir), towers_fit),
        unique_hours=True,
        towers_fit=towers_fit,
    )
