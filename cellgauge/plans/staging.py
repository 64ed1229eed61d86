"""Raw telemetry and sessions to cleaned tables.

One plan covers any number of days; the partition date comes from the data unless a single date is
given."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, StringType

from cellgauge.functions.columns import counter_overflow, sensor_fault, to_counter, to_number, to_timestamp_ntz
from cellgauge.operators.dedupe import keep_first
from cellgauge.operators.joins import spread_join
from cellgauge.schemas import SESSION_SCHEMA, TELEMETRY_SCHEMA

MEASURES = ("prb_utilization", "throughput_mbps", "latency_ms", "dropped_call_rate")
COUNTERS = ("handover_count", "connected_subscribers")


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, StringType)


def _kind(df: DataFrame, name: str) -> str:
    t = df.schema[name].dataType
    return "double" if isinstance(t, DoubleType) else "whole" if isinstance(t, IntegralType) else ""


def _stamp(partition_date: date | None, ts: str) -> Column:
    return F.to_date(ts) if partition_date is None else F.lit(partition_date)


def clean_telemetry(
    raw: DataFrame,
    towers: DataFrame,
    partition_date: date | None = None,
    dedupe: bool = False,
    towers_fit: bool | None = None,
) -> DataFrame:
    """Known towers only; measures as numbers or NULL, counters as whole numbers, missing = 0.

    The fault flag is set after the numbers are read, so a reading given as text is flagged too. Rows
    whose hour cannot be read or whose counter is out of range are left out; see :func:`rejected_telemetry`. ``dedupe`` keeps one row
    per tower and hour, which the source does not promise."""
    known = spread_join(
        raw, towers.select("tower_id"), ["tower_id"], "left_semi", F.col("event_hour"), small_fits=towers_fit
    )
    typed = known.select(
        "tower_id",
        to_timestamp_ntz("event_hour").alias("event_hour"),
        *(to_number(c, _is_text(raw, c)).alias(c) for c in MEASURES if c in raw.columns),
        *(F.lit(None).cast("double").alias(c) for c in MEASURES if c not in raw.columns),
        *(to_counter(c, _is_text(raw, c), kind=_kind(raw, c)).alias(c) for c in COUNTERS),
    ).where(F.col("event_hour").isNotNull() & F.col(COUNTERS[0]).isNotNull() & F.col(COUNTERS[1]).isNotNull())
    out = typed.withColumn("is_sensor_fault", sensor_fault("prb_utilization")).withColumn(
        "partition_date", _stamp(partition_date, "event_hour")
    )
    if dedupe:
        out = keep_first(out, ["tower_id", "event_hour"], [F.col(c) for c in (*MEASURES, *COUNTERS)])
    return out.select(*TELEMETRY_SCHEMA.names)


def rejected_telemetry(raw: DataFrame) -> DataFrame:
    """Raw rows whose hour is missing or unreadable, or with a counter out of range."""
    bad = to_timestamp_ntz("event_hour").isNull()
    for c in COUNTERS:
        bad |= counter_overflow(c, _is_text(raw, c), kind=_kind(raw, c))
    return raw.where(bad)


def clean_sessions(
    raw: DataFrame,
    towers: DataFrame,
    subscribers: DataFrame,
    partition_date: date | None = None,
    towers_fit: bool | None = None,
    subscribers_fit: bool | None = None,
) -> DataFrame:
    """Complete sessions of known towers and subscribers, one per (subscriber, tower, start).

    The end may be missing. Of several copies the one with the earliest (end, service, bytes) stays,
    a missing end first. Ids are checked first, straight off the scan, so that a shuffled check needs
    its key counts from one column of the input and not from deduplicated rows."""
    typed = raw.select(
        "subscriber_id",
        "tower_id",
        to_timestamp_ntz("session_start").alias("session_start"),
        to_timestamp_ntz("session_end").alias("session_end"),
        to_number("session_duration_min", _is_text(raw, "session_duration_min")).alias("session_duration_min"),
        "service_type",
        to_counter("bytes_transferred", _is_text(raw, "bytes_transferred"), "bigint", _kind(raw, "bytes_transferred")).alias("bytes_transferred"),
    ).dropna(subset=["subscriber_id", "tower_id", "session_start", "service_type", "bytes_transferred"])
    known = spread_join(
        typed, towers.select("tower_id"), ["tower_id"], "left_semi", F.col("subscriber_id"), small_fits=towers_fit
    )
    valid = spread_join(
        known,
        subscribers.select("subscriber_id"),
        ["subscriber_id"],
        "left_semi",
        F.col("session_start"),
        small_fits=subscribers_fit,
    )
    single = keep_first(
        valid,
        ["subscriber_id", "tower_id", "session_start"],
        [
            F.asc_nulls_first("session_end"),
            F.asc("service_type"),
            F.asc("bytes_transferred"),
            F.asc_nulls_first("session_duration_min"),
        ],
    )
    return single.withColumn("partition_date", _stamp(partition_date, "session_start")).select(*SESSION_SCHEMA.names)


def rejected_sessions(raw: DataFrame) -> DataFrame:
    """Raw rows with a required field missing, a start that cannot be read or bytes out of range."""
    return raw.where(
        F.col("subscriber_id").isNull()
        | F.col("tower_id").isNull()
        | F.col("service_type").isNull()
        | to_timestamp_ntz("session_start").isNull()
        | counter_overflow("bytes_transferred", _is_text(raw, "bytes_transferred"), "bigint", _kind(raw, "bytes_transferred"))
    )
