"""The seven marts.

Look-back windows count calendar dates back from the newest date, inclusive: "7 days" is 8 dates.
The newest date is a scalar subquery by default; pass ``F.lit(date)`` where it is known, and partition
pruning becomes static. Cleaned tables take the partition date from the hour, so a bound on hours is a
bound on dates too; for tables stamped with another date pass ``stamped=False``. Marts carry no row
order; reports sort what they show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from cellgauge.functions.columns import percent_of, ratio, round_half_up
from cellgauge.operators.intervals import sessions_in_hours
from cellgauge.plans.scoring import has_profile

# Columns of a congestion event, in order.
EVENT_COLUMNS = (
    "tower_id",
    "event_hour",
    "prb_utilization",
    "threshold_warn",
    "threshold_critical",
    "severity",
    "is_sensor_fault",
)


def from_day(df: DataFrame, day: Column, stamped: bool = True) -> DataFrame:
    """Partitions from a day on, where the table has them; a step before the bound on the hour itself."""
    return df.where(F.col("partition_date") >= day) if stamped and "partition_date" in df.columns else df


def last_valid_day(telemetry: DataFrame) -> Column:
    """Newest event date among readings without sensor fault."""
    newest = telemetry.where(~F.col("is_sensor_fault")).agg(F.max("event_hour"))
    return F.to_date(newest.scalar())


def last_partition(telemetry: DataFrame) -> Column:
    """Newest partition date among all readings, faulty ones too."""
    return telemetry.agg(F.max("partition_date")).scalar()


def congestion_events(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("severity").isNotNull()).select(*EVENT_COLUMNS)


def tower_hours(scored: DataFrame, unique_hours: bool) -> DataFrame:
    """One row per tower and hour: number of readings and of congested readings, sum and count of PRB."""
    prb = F.col("prb_utilization")
    if unique_hours:
        return scored.select(
            "tower_id",
            "event_hour",
            F.lit(1).cast("bigint").alias("readings"),
            F.col("severity").isNotNull().cast("bigint").alias("congested"),
            prb.alias("prb_sum"),
            prb.isNotNull().cast("bigint").alias("prb_count"),
        )
    return scored.groupBy("tower_id", "event_hour").agg(
        F.count(F.lit(1)).alias("readings"),
        F.count("severity").alias("congested"),
        F.sum(prb).alias("prb_sum"),
        F.count(prb).alias("prb_count"),
    )


def hotspot_summary(scored: DataFrame, as_of: Column, unique_hours: bool = False) -> DataFrame:
    """Congestion frequency over 7 and 30 days, mean PRB, most frequent congested hour, congested hours.

    This is the result of joining readings to their congestion events on tower and hour, worked out
    without the join: an hour with n readings of which c are congested gives n*c joined rows, or n when
    c is 0. ``unique_hours`` states that n is always 1 and saves the shuffle that would establish n."""
    # One column holds the age, so the newest date is asked for once.
    hours = tower_hours(scored, unique_hours).withColumn("age", F.datediff(as_of, F.to_date("event_hour")))
    hot = F.col("congested") > 0
    in_week, in_month = F.col("age") <= 7, F.col("age") <= 30
    windows = {
        "seen_7d": F.count_if(in_week),
        "hot_7d": F.count_if(in_week & hot),
        "seen_30d": F.count_if(in_month),
        "hot_30d": F.count_if(in_month & hot),
    }
    return hotspots_of_hours(hotspot_hours(hours.groupBy("tower_id", F.hour("event_hour").alias("hour_of_day")), windows))


def hotspot_hours(grouped: GroupedData, counts: dict[str, Column]) -> DataFrame:
    """Sums over tower-hours (see :func:`tower_hours`) that hotspots are made of, and the given counts."""
    copies = F.greatest(F.col("congested"), F.lit(1))
    return grouped.agg(
        *(c.alias(n) for n, c in counts.items()),
        F.count_if(F.col("congested") > 0).alias("hot_all"),
        F.sum(F.col("prb_sum") * copies).alias("prb_sum"),
        F.sum(F.col("prb_count") * copies).alias("prb_count"),
        F.sum(F.col("readings") * F.col("congested")).alias("weight"),
    )


def hotspots_of_hours(by_hour: DataFrame) -> DataFrame:
    """The hotspot mart from sums by tower and hour of day."""
    # Most frequent hour, the smallest on a tie: the weight decides, then the hour counts against it.
    votes = F.when(F.col("weight") > 0, F.col("weight") * 24 - F.col("hour_of_day"))
    by_tower = by_hour.groupBy("tower_id").agg(
        *(F.sum(c).alias(c) for c in ("seen_7d", "hot_7d", "seen_30d", "hot_30d", "hot_all", "prb_sum", "prb_count")),
        F.max_by("hour_of_day", votes).alias("peak_congestion_hour"),
    )
    return by_tower.select(
        "tower_id",
        F.coalesce(percent_of("hot_7d", "seen_7d"), F.lit(0.0)).alias("congestion_frequency_7d"),
        F.coalesce(percent_of("hot_30d", "seen_30d"), F.lit(0.0)).alias("congestion_frequency_30d"),
        F.coalesce(ratio("prb_sum", "prb_count"), F.lit(0.0)).alias("avg_prb_utilization"),
        "peak_congestion_hour",
        F.col("hot_all").alias("total_affected_subscriber_hours"),
    )


def peak_hour_patterns(scored: DataFrame, as_of: Column, stamped: bool = True) -> DataFrame:
    recent = from_day(scored, F.date_sub(as_of, 30), stamped).where((F.col("event_hour") >= F.date_sub(as_of, 30).cast("timestamp_ntz")) & has_profile())
    congested = F.coalesce(F.col("prb_utilization") >= F.col("threshold_warn"), F.lit(False))
    return recent.groupBy("tower_id", F.hour("event_hour").alias("hour_of_day")).agg(
        F.avg("prb_utilization").alias("avg_prb_utilization"),
        (F.avg(congested.cast("double")) * 100).alias("congestion_occurrence_rate"),
        F.count_if(congested).alias("days_congested"),
    )


def peaks_of_sums(sums: DataFrame) -> DataFrame:
    """The peak-hour mart from sums by tower and hour of day: profiled (readings), profiled_prb, profiled_prb_count, warm."""
    return sums.select(
        "tower_id",
        "hour_of_day",
        ratio("profiled_prb", "profiled_prb_count").alias("avg_prb_utilization"),
        (F.col("warm") / F.col("profiled") * 100).alias("congestion_occurrence_rate"),
        F.col("warm").alias("days_congested"),
    )


def network_health_snapshot(scored: DataFrame, as_of: Column) -> DataFrame:
    latest = scored.where((F.col("partition_date") == as_of) & has_profile())
    return latest.groupBy("tower_id").agg(
        round_half_up(F.avg("health_score")).alias("health_score"),
        F.max("connected_subscribers").alias("connected_subscribers"),
    )


def province_summary(
    towers: DataFrame, hotspots: DataFrame, health: DataFrame, congested_at: float = 30.0
) -> DataFrame:
    """Per province: towers, towers congested at least ``congested_at`` % of the week, mean health,
    congested hours. Both marts have one row per tower, so plain counts are distinct counts."""
    placed = towers.where(F.col("province_name").isNotNull()).select("tower_id", "province_name", "island_group")
    joined = placed.join(
        hotspots.select("tower_id", "congestion_frequency_7d", "total_affected_subscriber_hours"), "tower_id", "left"
    ).join(health.select("tower_id", "health_score"), "tower_id", "left")
    out = joined.groupBy("province_name").agg(
        F.max("island_group").alias("island_group"),
        F.count("tower_id").alias("tower_count"),
        F.count_if(F.col("congestion_frequency_7d") >= congested_at).alias("congested_tower_count"),
        round_half_up(F.avg("health_score")).alias("avg_health_score"),
        F.coalesce(F.sum("total_affected_subscriber_hours"), F.lit(0)).alias("total_affected_subscriber_hours_7d"),
    )
    return out.withColumn("congestion_rate", round_half_up(percent_of("congested_tower_count", "tower_count")))


def subscriber_impact(events: DataFrame, sessions: DataFrame, **join_options) -> DataFrame:
    """Per congestion event: distinct subscribers, session minutes, distinct subscribers by service.

    Sessions are first reduced to one row per event hour and subscriber. That spreads a busy tower-hour
    over its subscribers, and it makes every distinct count a plain count. A session counts in full in
    each hour it touches. Events without a session stay, with NULL minutes."""
    slim = sessions.select(
        "subscriber_id", "tower_id", "session_start", "session_end", "session_duration_min", "service_type"
    )
    met = sessions_in_hours(slim, events.select("tower_id", "event_hour"), **join_options)
    per_subscriber = met.groupBy("tower_id", "event_hour", "subscriber_id").agg(
        F.sum("session_duration_min").alias("_minutes"),
        *(
            F.max((F.col("service_type") == service).cast("int")).alias(f"_{service}")
            for service in ("voice", "data", "SMS")
        ),
    )
    # A NULL subscriber adds minutes but is not counted.
    known = F.col("subscriber_id").isNotNull()
    per_hour = per_subscriber.groupBy("tower_id", "event_hour").agg(
        F.count("subscriber_id").alias("_subscribers"),
        F.sum("_minutes").alias("_minutes"),
        *(F.count_if(known & (F.col(f"_{s}") == 1)).alias(f"_{s}") for s in ("voice", "data", "SMS")),
    )
    # Grouping after the join keeps its partitioning. Equal events add up their minutes.
    joined = events.select("tower_id", "event_hour", "severity").join(per_hour, ["tower_id", "event_hour"], "left")

    def counted(column: str) -> Column:
        return F.coalesce(F.max(column), F.lit(0))

    return joined.groupBy("tower_id", "event_hour", "severity").agg(
        counted("_subscribers").alias("subscriber_count_affected"),
        F.sum("_minutes").alias("degraded_session_minutes"),
        counted("_voice").alias("voice_sessions"),
        counted("_data").alias("data_sessions"),
        counted("_SMS").alias("sms_sessions"),
    )


def surges(events: DataFrame, telemetry: DataFrame, pairs: DataFrame, surge: float = 1.5) -> DataFrame:
    """(source_tower_id, neighbour_tower_id, source_handovers, neighbour_handovers, event_hour) where a neighbour took over
    more than ``surge`` times the handovers of a congested tower in the same hour.

    The readings are shuffled once on tower and hour and serve both joins."""
    readings = telemetry.where(~F.col("is_sensor_fault")).select("tower_id", "event_hour", "handover_count")
    congested = events.select("tower_id", "event_hour").distinct()
    sources = readings.join(congested, ["tower_id", "event_hour"], "left_semi").withColumnsRenamed(
        {"tower_id": "source_tower_id", "handover_count": "source_handovers"}
    )
    # The second use takes the readings under their own names, or Spark would not see the same shuffle.
    fan_out = sources.join(pairs, "source_tower_id").withColumnRenamed("neighbour_tower_id", "tower_id")
    return (
        fan_out.join(readings, ["tower_id", "event_hour"])
        .where(F.col("handover_count") > F.col("source_handovers") * surge)
        .withColumnsRenamed({"tower_id": "neighbour_tower_id", "handover_count": "neighbour_handovers"})
        .select("source_tower_id", "neighbour_tower_id", "source_handovers", "neighbour_handovers", "event_hour")
    )


def spillovers(surged: DataFrame) -> DataFrame:
    """One row per distinct pair of handover counts of :func:`surges`."""
    return (
        surged.select("source_tower_id", "neighbour_tower_id", "source_handovers", "neighbour_handovers")
        .distinct()
        .select("source_tower_id", "neighbour_tower_id", F.lit(True).alias("is_spillover"))
    )


def neighbour_impact(events: DataFrame, telemetry: DataFrame, pairs: DataFrame, surge: float = 1.5) -> DataFrame:
    """Neighbours that took over more than ``surge`` times the handovers of a congested tower in the
    same hour; one row per distinct pair of handover counts."""
    return spillovers(surges(events, telemetry, pairs, surge))
