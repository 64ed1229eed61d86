"""The tables of one network and the plans over them, wired together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date, timedelta
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.functions.columns import ntz
from cellgauge.operators.intervals import masks_fit
from cellgauge.operators.joins import fits
from cellgauge.operators.spatial import neighbour_pairs
from cellgauge.plans import marts, rolling, scoring
from cellgauge.plans.serving import newest_hour
from cellgauge.sources.lake import PARTITION, partition_dates
from cellgauge.sources.versions import TableStore, Transaction

MARTS = (
    "congestion_events",
    "hotspot_summary",
    "peak_hour_patterns",
    "neighbour_impact",
    "subscriber_impact",
    "network_health_snapshot",
    "province_summary",
)


class Late:
    """Field whose value may be given as a function, or left to a default of the object's; either is called once, when the field is
    first read."""

    def __init__(self, default: Callable[[Any], Any] | None = None) -> None:
        self.default = default

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = f"_{name}"

    def __get__(self, obj: Any, owner: type) -> Any:
        if obj is None:
            if self.default is None:
                raise AttributeError(self.name[1:])
            return None
        value, known = getattr(obj, self.name)
        if not known:
            value = self.default(obj) if value is None else value()
            setattr(obj, self.name, (value, True))
        return value

    def __set__(self, obj: Any, value: Any) -> None:
        late = self.default is not None if value is None else callable(value) and not isinstance(value, DataFrame)
        setattr(obj, self.name, (value, not late))


@dataclass
class Network:
    """Cleaned tables; telemetry and sessions may be given as functions, so a report pays for the tables it reads. Marts are plans that nothing has run yet; what is asked of the data before is the
    size of the tower table, once, to settle whether joins may broadcast it, the newest hour and valid day of the
    newest partition if they are asked for, and the sizes that shuffled joins of large tables need.

    ``unique_hours`` states that telemetry has one row per tower and hour (a quality check tells),
    ``stamped`` that partition dates come from the hours, ``hourly`` that events are on the hour.
    ``dates`` are the first and last partition date; a table read from date partitions tells them by its
    listing. Where they are unknown, bounds are scalar subqueries."""

    towers: DataFrame
    thresholds: DataFrame
    telemetry: DataFrame = Late()
    sessions: DataFrame = Late()
    unique_hours: bool = False
    towers_fit: bool | None = Late(lambda n: fits(n.towers.select("tower_id")))
    stamped: bool = True
    hourly: bool = True
    dates: tuple[date, date] | None = Late(lambda n: (lambda d: (d[0], d[-1]) if d else None)(partition_dates(n.telemetry)))

    @cached_property
    def profile(self) -> DataFrame:
        return scoring.tower_profile(self.towers, self.thresholds)

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.score(self.telemetry, self.profile, self.towers_fit)

    @cached_property
    def last_valid_day(self) -> Column:
        """From the newest partition alone, if it has a reading without sensor fault."""
        if self.dates is not None and self.stamped:
            newest = self.telemetry.where((F.col(PARTITION) == F.lit(self.dates[1])) & ~F.col("is_sensor_fault"))
            if not newest.isEmpty():
                return F.lit(self.dates[1])
        return marts.last_valid_day(self.telemetry)

    @property
    def last_partition(self) -> Column:
        return marts.last_partition(self.telemetry) if self.dates is None else F.lit(self.dates[1])

    @cached_property
    def newest_hour(self) -> Column:
        """From the newest partition alone, as a literal that makes the windows' partition bounds static; where
        partitions are unknown, a scalar subquery."""
        if self.dates is None or not self.stamped:
            return newest_hour(self.telemetry)
        newest = self.telemetry.where(F.col(PARTITION) == F.lit(self.dates[1])).agg(F.max("event_hour")).first()[0]
        return ntz(newest)

    @cached_property
    def congestion_events(self) -> DataFrame:
        return marts.congestion_events(self.scored)

    @cached_property
    def hotspot_summary(self) -> DataFrame:
        return marts.hotspot_summary(self.scored, self.last_valid_day, self.unique_hours)

    @cached_property
    def peak_hour_patterns(self) -> DataFrame:
        return marts.peak_hour_patterns(self.scored, self.last_partition, self.stamped)

    @cached_property
    def network_health_snapshot(self) -> DataFrame:
        return marts.network_health_snapshot(self.scored, self.last_partition)

    @cached_property
    def province_summary(self) -> DataFrame:
        return marts.province_summary(self.towers, self.hotspot_summary, self.network_health_snapshot)

    @cached_property
    def subscriber_impact(self) -> DataFrame:
        return marts.subscriber_impact(self.congestion_events, self.sessions, **self.session_options)

    @property
    def session_options(self) -> dict:
        """How sessions meet events: the days, and whether a mask for each tower and day may be broadcast. The
        tower table bounds the towers, since events are of known towers only. Without a listing the days
        are read from the one column."""
        if not self.stamped:
            return {"hourly": self.hourly}
        span = self.dates or tuple(self.telemetry.agg(F.min(PARTITION), F.max(PARTITION)).first())
        if span[0] is None:
            return {"hourly": self.hourly}
        days = (span[1] - span[0]).days + 1
        return {"days": span, "masks_fit": bool(self.towers_fit) and masks_fit(self.tower_count, days, self.hourly), "hourly": self.hourly}

    @cached_property
    def tower_count(self) -> int:
        return self.towers.count()

    @cached_property
    def neighbour_pairs(self) -> DataFrame:
        return neighbour_pairs(self.towers)

    @cached_property
    def neighbour_impact(self) -> DataFrame:
        return marts.neighbour_impact(self.congestion_events, self.telemetry, self.neighbour_pairs)


def build_marts(network: Network, root: str) -> dict[str, DataFrame]:
    """Write the marts as Parquet under root and return them as read back.

    Congestion events and neighbour pairs are written first; the marts that follow read those tables
    instead of working them out again. The marts with one row per event are partitioned by date;
    :func:`refresh_dates` replaces single dates of them."""
    spark: SparkSession = network.towers.sparkSession

    def stored(name: str, df: DataFrame, by_date: bool = False) -> DataFrame:
        path = f"{root}/{name}"
        if by_date:
            df.hint("rebalance", PARTITION).write.mode("overwrite").partitionBy(PARTITION).parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    hot = network.scored.where("severity IS NOT NULL").select(*marts.EVENT_COLUMNS, PARTITION)
    events = stored("congestion_events", hot, by_date=True)
    pairs = stored("neighbour_pairs", network.neighbour_pairs)
    hotspots = stored("hotspot_summary", network.hotspot_summary)
    health = stored("network_health_snapshot", network.network_health_snapshot)
    return {
        "congestion_events": events.select(*marts.EVENT_COLUMNS),
        "hotspot_summary": hotspots,
        "peak_hour_patterns": stored("peak_hour_patterns", network.peak_hour_patterns),
        "neighbour_impact": stored(
            "neighbour_impact", marts.neighbour_impact(events, network.telemetry, pairs)
        ),
        "subscriber_impact": stored("subscriber_impact", _impact(events, network), by_date=True).drop(PARTITION),
        "network_health_snapshot": health,
        "province_summary": stored(
            "province_summary", marts.province_summary(network.towers, hotspots, health)
        ),
    }


def _impact(events: DataFrame, network: Network) -> DataFrame:
    rows = marts.subscriber_impact(events, network.sessions, **network.session_options)
    return rows.withColumn(PARTITION, F.to_date("event_hour"))


def refresh_dates(network: Network, root: str, first: date, last: date) -> None:
    """Work the event-grained marts out again for the dates from first to last and replace those partitions,
    whole and idempotent; other dates are neither read nor written. Dates that have lost all events are
    emptied. Needs a network whose partition dates come from the hours."""
    if not network.stamped:
        raise ValueError("partition dates do not follow the hours")
    spark: SparkSession = network.towers.sparkSession
    day = F.col(PARTITION).between(F.lit(first), F.lit(last))
    hot = network.scored.where(day & F.col("severity").isNotNull()).select(*marts.EVENT_COLUMNS, PARTITION)
    _replace(spark, hot, f"{root}/congestion_events", first, last)
    events = spark.read.parquet(f"{root}/congestion_events").where(day)
    # A session of these dates may have begun long before; only its end is bounded.
    sessions = network.sessions.where(F.col("session_end") >= F.lit(first).cast("timestamp_ntz"))
    part = replace(network, sessions=sessions, dates=(first, last))
    _replace(spark, _impact(events, part), f"{root}/subscriber_impact", first, last)


def _replace(spark: SparkSession, df: DataFrame, path: str, first: date, last: date) -> None:
    (
        df.hint("rebalance", PARTITION)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PARTITION)
        .parquet(path)
    )
    # A dynamic overwrite leaves dates alone that have no row any more.
    stored, kept = spark.read.parquet(path), {r[0] for r in df.select(PARTITION).distinct().collect()}
    for gone in (d for d in partition_dates(stored) if first <= d <= last and d not in kept):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PARTITION}={gone:%Y-%m-%d}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def publish_marts(network: Network, store: TableStore) -> int:
    """All marts, worked out whole and committed to ``store`` as one version, which is returned. Besides the marts it holds the partial
    sums that :func:`publish_dates` goes on from."""
    return _published(network, store.begin(), None, None)


def publish_dates(network: Network, store: TableStore, first: date, last: date) -> int:
    """The marts after the dates from first to last have got new or late rows, committed as one version.

    Of telemetry and sessions only those dates are read; everything else comes from what the store has: partial sums of
    the dates' months and of the last 31 dates, and sums of other months. Readers of the store see the version before, or all of
    this one. Needs a network whose partition dates come from the hours, and towers and thresholds as they were; after a
    change of those publish all again."""
    if not network.stamped:
        raise ValueError("partition dates do not follow the hours")
    return _published(network, store.begin(), first, last)


def _published(network: Network, t: Transaction, first: date | None, last: date | None) -> int:
    day = F.lit(True) if first is None else F.col(PARTITION).between(F.lit(first), F.lit(last))
    # A reading's date is that of its hour, as in the marts.
    scored = network.scored.where(day)
    t.replace_dates("day_partials", rolling.day_partials(scored, network.unique_hours), first, last)
    start, end = (None, None) if first is None else (first.replace(day=1), (last.replace(day=28) + timedelta(4)).replace(day=1) - timedelta(1))
    t.replace_dates("month_partials", rolling.month_partials(t.read("day_partials", start, end)), start, end)
    hot = scored.where("severity IS NOT NULL").select(*marts.EVENT_COLUMNS, PARTITION)
    t.replace_dates("congestion_events", hot, first, last)
    events = t.read("congestion_events", first, last)
    pairs = t.read("neighbour_pairs") if first is not None and "neighbour_pairs" in t.tables else t.overwrite("neighbour_pairs", network.neighbour_pairs)
    surged = marts.surges(events, network.telemetry.where(day), pairs).withColumn(PARTITION, F.to_date("event_hour"))
    t.replace_dates("surges", surged.drop("event_hour").distinct(), first, last)
    if first is None:
        part = network
    else:
        # A session of these dates may have begun long before; only its end is bounded.
        sessions = network.sessions.where(F.col("session_end") >= F.lit(first).cast("timestamp_ntz"))
        part = replace(network, sessions=sessions, dates=(first, last))
    t.replace_dates("subscriber_impact", _impact(events, part), first, last)

    known = [date.fromisoformat(d) for d in t.tables["day_partials"].runs]
    as_of = max(known, default=None)
    recent = t.read("day_partials", as_of - timedelta(rolling.MONTH) if as_of else None)
    hotspots = t.overwrite("hotspot_summary", rolling.hotspots_of_partials(t.read("month_partials"), recent, F.lit(as_of).cast("date")))
    t.overwrite("peak_hour_patterns", rolling.peaks_of_partials(t.read("day_partials"), network.last_partition))
    t.overwrite("neighbour_impact", marts.spillovers(t.read("surges")))
    health = t.overwrite("network_health_snapshot", network.network_health_snapshot)
    t.overwrite("province_summary", marts.province_summary(network.towers, hotspots, health))
    return t.commit()


def create_views(network: Network) -> None:
    """Staging tables as temporary views with fixed columns, for SQL users."""
    from cellgauge.schemas import SESSION_SCHEMA, TELEMETRY_SCHEMA

    network.telemetry.select(*TELEMETRY_SCHEMA.names).createOrReplaceTempView("stg_tower_telemetry")
    network.sessions.select(*SESSION_SCHEMA.names).createOrReplaceTempView("stg_subscriber_sessions")
    network.towers.createOrReplaceTempView("tower_master")
    network.thresholds.createOrReplaceTempView("tower_thresholds")
