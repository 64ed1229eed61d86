"""Report queries over telemetry, marts and alerts.

Queries about one tower take an optional ``tower_id``; without it they answer for every tower at once.
Time windows reach back from the newest hour of all telemetry, faulty readings included. A clock, where
one is needed, is the ``as_of`` argument."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgauge.functions.columns import (
    age_days,
    day_of_week,
    ntz,
    percent_of,
    round_half_even,
    round_half_up,
    window_interval,
)
from cellgauge.operators.joins import spread_join
from cellgauge.plans.marts import from_day
from cellgauge.plans.scoring import has_profile

# The columns of the reports, here and in the select lists below.
TOWER_ATTRIBUTES = ("tower_id", "lat", "lon", "radio", "mnc", "cell_type", "province_name", "island_group")
ALL = "All"


def matching(df: DataFrame, wanted: Mapping[str, str | None]) -> DataFrame:
    """Equality filters; None and "All" let everything through."""
    for column, value in wanted.items():
        if value is not None and value != ALL:
            df = df.where(F.col(column) == value)
    return df


def _of_tower(df: DataFrame, tower_id: str | None, column: str = "tower_id") -> DataFrame:
    return matching(df, {column: None if tower_id is None else tower_id})


def _frequency(window: str) -> str:
    """Only the 7-day window has its own column; every other one reads the 30-day figure."""
    return "congestion_frequency_7d" if window == "7d" else "congestion_frequency_30d"


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    """1..n over a report already cut down to what is shown."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


# --- maps ------------------------------------------------------------------------------------


def newest_hour(telemetry: DataFrame) -> Column:
    """Newest hour of all readings, as a scalar subquery."""
    return telemetry.agg(F.max("event_hour")).scalar()


def _window_metrics(scored: DataFrame, newest: Column, window: str, stamped: bool = True) -> DataFrame:
    first_day = F.to_date(newest - window_interval(window))
    recent = from_day(scored, first_day, stamped).where((F.col("event_hour") >= newest - window_interval(window)) & has_profile())
    return recent.groupBy("tower_id").agg(
        round_half_up(F.avg("health_score")).alias("health_score"),
        F.max("connected_subscribers").alias("connected_subscribers"),
        round_half_up(F.avg("prb_utilization")).alias("avg_prb_utilization"),
    )


def tower_map(
    towers: DataFrame, scored: DataFrame, newest: Column, window: str = "7d", stamped: bool = True
) -> DataFrame:
    """Every tower with its mean health, peak subscribers and mean PRB in the window. Readings are
    reduced to one row per tower before they meet the tower table. Only the window's dates are read."""
    metrics = _window_metrics(scored, newest, window, stamped)
    return towers.select(*TOWER_ATTRIBUTES).join(metrics, "tower_id", "left")


def province_map(tower_rows: DataFrame, congested_below: float = 40.0) -> DataFrame:
    """Roll-up of :func:`tower_map`. Towers outside any province form a group of their own; a tower
    without a score counts as healthy."""
    out = tower_rows.groupBy("province_name", "island_group").agg(
        F.count("tower_id").alias("tower_count"),
        F.count_if(F.coalesce("health_score", F.lit(100.0)) < congested_below).alias("congested_tower_count"),
        round_half_even(F.avg("health_score")).alias("avg_health_score"),
        round_half_even(F.avg("avg_prb_utilization")).alias("avg_prb_utilization"),
        F.coalesce(F.sum("connected_subscribers"), F.lit(0)).alias("total_connected_subscribers"),
    )
    return out.withColumn("congestion_rate", round_half_even(percent_of("congested_tower_count", "tower_count")))


def map_scope(tower_rows: DataFrame, province: str | None = None, tower_id: str | None = None) -> DataFrame:
    """Towers to draw: those of the selected tower's province, or of the selected province, or none.
    A tower outside any province is drawn alone."""
    if tower_id is not None:
        chosen = tower_rows.where(F.col("tower_id") == tower_id).select("province_name").limit(1)
        own = chosen.scalar()
        return tower_rows.where(
            F.when(own.isNull(), F.col("tower_id") == tower_id).otherwise(F.col("province_name") == own)
        )
    if province is not None:
        return tower_rows.where(F.col("province_name") == province)
    return tower_rows.limit(0)


# --- leaderboards ----------------------------------------------------------------------------


def hotspot_towers(hotspots: DataFrame, towers: DataFrame, window: str = "7d", top: int = 20) -> DataFrame:
    """The towers congested most often. Attributes are looked up only for the rows shown."""
    attributes = towers.select("tower_id", "province_name", "cell_type", "radio")
    known = hotspots.join(towers.select("tower_id"), "tower_id", "left_semi")
    best = known.orderBy(F.desc_nulls_last(_frequency(window)), "tower_id").limit(top)
    return best.join(attributes, "tower_id").withColumn("congestion_frequency", F.col(_frequency(window)))


def hotspot_leaderboard(hotspots: DataFrame, towers: DataFrame, window: str = "7d", top: int = 20) -> DataFrame:
    rows = _ranked(
        hotspot_towers(hotspots, towers, window, top), F.desc_nulls_last("congestion_frequency"), F.asc("tower_id")
    )
    return rows.select(
        "rank",
        "tower_id",
        F.col("province_name").alias("province"),
        "cell_type",
        "radio",
        round_half_even("congestion_frequency").alias("congestion_frequency_pct"),
        round_half_even("avg_prb_utilization").alias("avg_prb_pct"),
        "peak_congestion_hour",
        F.col("total_affected_subscriber_hours").alias("affected_subscriber_hours"),
    ).orderBy("rank")


def province_leaderboard(
    towers: DataFrame, hotspots: DataFrame, health: DataFrame, window: str = "7d"
) -> DataFrame:
    """Provinces with at least one tower congested in the window, by mean frequency."""
    frequency = F.col(_frequency(window))
    placed = towers.where(F.col("province_name").isNotNull()).select("tower_id", "province_name", "island_group")
    joined = placed.join(
        hotspots.select("tower_id", frequency.alias("_f"), "total_affected_subscriber_hours"), "tower_id", "left"
    ).join(health.select("tower_id", "health_score"), "tower_id", "left")
    hot = F.col("_f") > 0
    out = (
        joined.groupBy("province_name")
        .agg(
            F.max("island_group").alias("island_group"),
            F.count("tower_id").alias("tower_count"),
            F.count_if(hot).alias("congested_tower_count"),
            F.avg("_f").alias("_mean"),
            round_half_up(F.avg("health_score")).alias("avg_health_score"),
            F.coalesce(F.sum(F.when(hot, F.col("total_affected_subscriber_hours"))), F.lit(0)).alias(
                "total_affected_subscriber_hours"
            ),
        )
        .where(F.col("congested_tower_count") >= 1)
        .withColumn("congestion_rate", round_half_up(percent_of("congested_tower_count", "tower_count")))
        .withColumn("avg_congestion_frequency", round_half_up("_mean"))
    )
    # The mean before rounding decides; as a decimal it does not depend on the order of addition.
    order = (F.desc_nulls_last(F.col("_mean").cast("decimal(28,9)")), F.asc("province_name"))
    return _ranked(out, *order).drop("_mean").orderBy("rank")


def province_leaderboard_view(leaderboard: DataFrame) -> DataFrame:
    return leaderboard.select(
        "rank",
        "province_name",
        "island_group",
        F.col("avg_congestion_frequency").alias("avg_congestion_frequency_pct"),
        "tower_count",
        F.col("congested_tower_count").alias("congested_towers"),
        F.col("congestion_rate").alias("congestion_rate_pct"),
        "avg_health_score",
        F.col("total_affected_subscriber_hours").alias("affected_subscriber_hours"),
    )


def province_towers(
    tower_rows: DataFrame, hotspots: DataFrame, province: str | None = None
) -> DataFrame:
    """Towers of a province (of every province without one) with window metrics and hotspot figures."""
    placed = matching(tower_rows.where(F.col("province_name").isNotNull()), {"province_name": province})
    figures = hotspots.select(
        "tower_id",
        "congestion_frequency_7d",
        "congestion_frequency_30d",
        F.col("avg_prb_utilization").alias("hotspot_avg_prb"),
    )
    rows = placed.drop("island_group").join(figures, "tower_id", "left")
    rows = rows.fillna(0.0, ["congestion_frequency_7d", "congestion_frequency_30d", "hotspot_avg_prb"])
    return rows if province is None else rows.orderBy(F.asc_nulls_last("health_score"), "tower_id")


def province_towers_view(rows: DataFrame, window: str = "7d") -> DataFrame:
    return rows.select(
        "tower_id",
        "radio",
        "cell_type",
        "health_score",
        round_half_even("avg_prb_utilization").alias("avg_prb_pct"),
        F.col("connected_subscribers").alias("subscribers"),
        round_half_even(_frequency(window)).alias("congestion_frequency_pct"),
    )


# --- one tower, or all -----------------------------------------------------------------------


def latest_reading(telemetry: DataFrame, tower_id: str | None = None) -> DataFrame:
    """Newest reading without sensor fault per tower."""
    rows = _of_tower(telemetry.where(~F.col("is_sensor_fault")), tower_id)
    return rows.groupBy("tower_id").agg(
        F.max("event_hour").alias("event_hour"),
        F.max_by("prb_utilization", "event_hour").alias("prb_utilization"),
        F.max_by("connected_subscribers", "event_hour").alias("connected_subscribers"),
    )


def tower_metadata(towers: DataFrame, thresholds: DataFrame, tower_id: str | None = None) -> DataFrame:
    limits = thresholds.select("cell_type", "prb_warn_pct", "prb_critical_pct", "latency_warn_ms")
    return _of_tower(towers.select(*TOWER_ATTRIBUTES), tower_id).join(limits, "cell_type")


def prb_series(
    telemetry: DataFrame,
    tower_id: str | None = None,
    days: int = 7,
    newest_fits: bool | None = None,
    stamped: bool = True,
) -> DataFrame:
    """PRB over the last days before the tower's own newest hour, which a faulty reading may set. The
    newest hour comes from an aggregate, not a window, so a tower's readings are never gathered. Dates
    before the window of the tower that fell silent first are not read. ``newest_fits`` tells that one row
    for each tower of telemetry may be broadcast; otherwise it is measured."""
    columns = ("tower_id", "event_hour", "prb_utilization", "connected_subscribers", "is_sensor_fault")
    rows = _of_tower(telemetry.select(*columns), tower_id)
    newest = rows.groupBy("tower_id").agg(F.max("event_hour").alias("_newest"))
    span = F.expr(f"INTERVAL '{int(days)}' DAY")
    first_day = F.to_date(newest.agg(F.min("_newest")).scalar() - span)
    valid = from_day(_of_tower(telemetry, tower_id), first_day, stamped).where(~F.col("is_sensor_fault")).select(*columns)
    recent = spread_join(
        valid, newest, ["tower_id"], "inner", F.col("event_hour"), small_fits=newest_fits or tower_id is not None or None
    ).where(F.col("event_hour") >= F.col("_newest") - span)
    out = recent.select("tower_id", "event_hour", "prb_utilization", "connected_subscribers")
    return out if tower_id is None else out.orderBy("event_hour")


def event_history(events: DataFrame, impact: DataFrame, tower_id: str | None = None) -> DataFrame:
    figures = impact.select("tower_id", "event_hour", "subscriber_count_affected", "degraded_session_minutes")
    rows = _of_tower(events, tower_id).join(_of_tower(figures, tower_id), ["tower_id", "event_hour"], "left")
    out = rows.select(
        "tower_id",
        "event_hour",
        "prb_utilization",
        "severity",
        F.coalesce("subscriber_count_affected", F.lit(0)).alias("subscriber_count_affected"),
        F.coalesce("degraded_session_minutes", F.lit(0.0)).alias("degraded_session_minutes"),
    )
    return out if tower_id is None else out.orderBy(F.desc("event_hour"))


def event_history_view(rows: DataFrame) -> DataFrame:
    return rows.select(
        "tower_id",
        F.to_date("event_hour").alias("event_date"),
        F.hour("event_hour").alias("hour"),
        "severity",
        F.col("subscriber_count_affected").alias("subscribers_affected"),
        F.col("degraded_session_minutes").alias("degraded_minutes"),
    )


def peak_hour_profile(peaks: DataFrame, tower_id: str | None = None) -> DataFrame:
    out = _of_tower(peaks, tower_id).select(
        "tower_id", "hour_of_day", "avg_prb_utilization", "congestion_occurrence_rate"
    )
    return out if tower_id is None else out.orderBy("hour_of_day")


def prb_by_weekday_hour(telemetry: DataFrame, tower_id: str | None = None) -> DataFrame:
    rows = _of_tower(telemetry.where(~F.col("is_sensor_fault")), tower_id)
    return rows.groupBy(
        "tower_id", day_of_week("event_hour").alias("day_of_week"), F.hour("event_hour").alias("hour_of_day")
    ).agg(F.avg("prb_utilization").alias("avg_prb"))


def weekday_hour_grid(cells: DataFrame) -> DataFrame:
    """:func:`prb_by_weekday_hour` as seven rows of 24 columns per tower, h00 to h23; no reading = NULL.
    A tower has at most 168 cells, so they are held as one map and read out by position."""
    slot = F.col("day_of_week") * 24 + F.col("hour_of_day")
    held = cells.groupBy("tower_id").agg(
        F.map_from_entries(F.collect_list(F.struct(slot.alias("slot"), F.col("avg_prb").alias("v")))).alias("_cells")
    )
    days = held.withColumn("day_of_week", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return days.select(
        "tower_id",
        "day_of_week",
        *(F.try_element_at("_cells", F.col("day_of_week") * 24 + h).alias(f"h{h:02d}") for h in range(24)),
    )


def neighbour_list(spillover: DataFrame, towers: DataFrame, tower_id: str | None = None) -> DataFrame:
    attributes = towers.select(F.col("tower_id").alias("neighbour_tower_id"), "province_name", "cell_type")
    out = _of_tower(spillover, tower_id, "source_tower_id").join(attributes, "neighbour_tower_id")
    return out if tower_id is None else out.orderBy(F.desc("is_spillover"), "neighbour_tower_id")


def neighbour_list_view(rows: DataFrame) -> DataFrame:
    return rows.select(
        "source_tower_id",
        F.col("neighbour_tower_id").alias("neighbour_tower"),
        F.col("province_name").alias("province"),
        "cell_type",
        F.col("is_spillover").alias("spillover"),
    )


_IMPACT_TOTALS = {
    "total_affected_sessions": "subscriber_count_affected",
    "total_degraded_minutes": "degraded_session_minutes",
    "voice_sessions": "voice_sessions",
    "data_sessions": "data_sessions",
    "sms_sessions": "sms_sessions",
}


def impact_totals(impact: DataFrame, tower_id: str | None = None) -> DataFrame:
    """Totals of one tower as one row, zeros when it has no events; or one row per tower with events.

    Impact rows are reduced to one per hour first, so the distinct hour count is a plain count."""
    rows = _of_tower(impact, tower_id)
    hourly = rows.groupBy("tower_id", "event_hour").agg(*(F.sum(c).alias(c) for c in _IMPACT_TOTALS.values()))
    totals = [F.count("event_hour").alias("congestion_events")] + [
        F.coalesce(F.sum(source), F.lit(0)).alias(name) for name, source in _IMPACT_TOTALS.items()
    ]
    return hourly.groupBy("tower_id").agg(*totals) if tower_id is None else hourly.agg(*totals)


# --- alerts and overview ---------------------------------------------------------------------


def active_alerts(
    alerts: DataFrame,
    towers: DataFrame,
    as_of: datetime,
    alert_type: str | None = None,
    province: str | None = None,
    island_group: str | None = None,
) -> DataFrame:
    attributes = towers.select("tower_id", "province_name", "island_group")
    rows = alerts.where(F.col("status") == "ACTIVE").join(attributes, "tower_id")
    wanted = {"alert_type": alert_type, "province_name": province, "island_group": island_group}
    return (
        matching(rows, wanted)
        .withColumn("days_active", age_days("triggered_at", ntz(as_of)))
        .select(
            "alert_id",
            "tower_id",
            "province_name",
            "island_group",
            "alert_type",
            "alert_category",
            "severity",
            "message",
            "triggered_at",
            "days_active",
        )
        .orderBy(F.desc("severity"), "triggered_at", "alert_id")
    )


def active_alerts_view(rows: DataFrame) -> DataFrame:
    return rows.select(
        "tower_id",
        F.col("province_name").alias("province"),
        "alert_type",
        "severity",
        "message",
        "triggered_at",
        round_half_even("days_active").alias("days_active"),
    )


def alert_summary(alerts: DataFrame, towers: DataFrame, as_of: datetime) -> DataFrame:
    """One row. Alerts are reduced to one row per tower first, so distinct towers is a plain count and
    the distinct provinces come from one flag per tower."""
    per_tower = alerts.where(F.col("status") == "ACTIVE").groupBy("tower_id").agg(
        F.count(F.lit(1)).alias("_all"),
        F.count_if(F.col("alert_type") == "CRITICAL").alias("_critical"),
        F.min("triggered_at").alias("_oldest"),
    )
    per_province = (
        per_tower.join(towers.select("tower_id", "province_name"), "tower_id")
        .groupBy("province_name")
        .agg(
            F.sum("_all").alias("_all"),
            F.sum("_critical").alias("_critical"),
            F.count("tower_id").alias("_towers"),
            F.min("_oldest").alias("_oldest"),
        )
    )
    totals = per_province.agg(
        F.coalesce(F.sum("_all"), F.lit(0)).alias("total_active"),
        F.coalesce(F.sum("_critical"), F.lit(0)).alias("critical_count"),
        F.coalesce(F.sum("_towers"), F.lit(0)).alias("towers_affected"),
        F.count("province_name").alias("provinces_affected"),
        F.min("_oldest").alias("_oldest"),
    )
    oldest = F.coalesce(round_half_even(age_days("_oldest", ntz(as_of))), F.lit(0.0))
    return totals.withColumn("oldest_alert_days", oldest).drop("_oldest")


def filter_options(towers: DataFrame) -> DataFrame:
    """(filter, choice) rows, the "All" choice included."""
    placed = towers.where(F.col("province_name").isNotNull()).select("province_name", "island_group").distinct()
    choices = placed.select(
        F.explode(
            F.array(
                F.struct(F.lit("province").alias("filter"), F.col("province_name").alias("choice")),
                F.struct(F.lit("island_group").alias("filter"), F.col("island_group").alias("choice")),
                F.struct(F.lit("province").alias("filter"), F.lit(ALL).alias("choice")),
                F.struct(F.lit("island_group").alias("filter"), F.lit(ALL).alias("choice")),
            )
        ).alias("_c")
    ).select("_c.*")
    return choices.where(F.col("choice").isNotNull()).distinct()


def provinces(towers: DataFrame) -> DataFrame:
    return towers.where(F.col("province_name").isNotNull()).select("province_name").distinct().orderBy("province_name")


def tower_ids(towers: DataFrame) -> DataFrame:
    return towers.select("tower_id").orderBy("tower_id")


def home_metrics(towers: DataFrame, alerts: DataFrame, health: DataFrame) -> DataFrame:
    """One row of three independent figures; each is an aggregate of exactly one row."""
    active = alerts.where(F.col("status") == "ACTIVE").agg(F.count(F.lit(1))).scalar()
    mean = health.agg(F.coalesce(round_half_up(F.avg("health_score")), F.lit(0.0))).scalar()
    count = towers.agg(F.count(F.lit(1)).alias("tower_count"))
    return count.select("tower_count", active.alias("active_alerts"), mean.alias("avg_health_score"))


def partition_volume(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("partition_date").agg(F.count(F.lit(1)).alias("row_count"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count), counted in one job."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
