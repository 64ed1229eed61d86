"""Data-quality checks. Each returns its violations, so an empty result means the check passed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.operators.joins import spread_join
from cellgauge.schemas import ALERT_STATUSES, CELL_TYPES, SERVICE_TYPES, SEVERITIES


def nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, violations) for columns holding NULLs; all columns in one pass."""
    counted = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    pairs = F.explode(
        F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("violations")) for c in columns))
    )
    return counted.select(pairs.alias("_p")).select("_p.*").where(F.col("violations") > 0)


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def unexpected_values(df: DataFrame, column: str, accepted: Sequence[str]) -> DataFrame:
    """(value, violations) for values outside the list; NULL is the business of :func:`nulls`."""
    odd = df.where(~F.col(column).isin(*accepted))
    return odd.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("violations"))


def prb_out_of_range(telemetry: DataFrame) -> DataFrame:
    prb = F.col("prb_utilization")
    bad = telemetry.where((prb < 0) | ((prb > 100) & ~F.col("is_sensor_fault")))
    return bad.agg(F.count(F.lit(1)).alias("invalid_prb_count")).where(F.col("invalid_prb_count") > 0)


def events_without_threshold(events: DataFrame, profile: DataFrame, profile_fits: bool | None = None) -> DataFrame:
    """Events whose tower is unknown or of a type without thresholds."""
    return spread_join(
        events, profile.select("tower_id"), ["tower_id"], "left_anti", F.col("event_hour"), small_fits=profile_fits
    ).select("tower_id", "event_hour")


def orphans(
    child: DataFrame, parent: DataFrame, key: str, salt_by: Column, parent_fits: bool | None = None
) -> DataFrame:
    """(key, violations) for child keys missing from the parent. Keys are counted first, so a frequent
    one is looked up once."""
    counted = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("violations"))
    return spread_join(counted, parent.select(key), [key], "left_anti", salt_by, small_fits=parent_fits)


def missing_tower_hours(telemetry: DataFrame, towers: DataFrame) -> DataFrame:
    """(tower_id, partition_date, missing_hours) for tower-days without all 24 hours, over every date
    from the first partition to the last.

    Hours present are folded to a 24-bit mask per tower and day, before the spine of tower-days meets
    them; the spine is 24 times smaller than complete telemetry."""
    span = telemetry.agg(F.min("partition_date").alias("first"), F.max("partition_date").alias("last"))
    days = F.sequence(span.select("first").scalar(), span.select("last").scalar())
    # A tower table of few files still gives many tasks before each tower is repeated for every date.
    spine = towers.select("tower_id").repartition("tower_id").withColumn("partition_date", F.explode(days))
    seen = (
        telemetry.select("tower_id", "partition_date", F.expr("shiftleft(1, hour(event_hour))").alias("_bit"))
        .groupBy("tower_id", "partition_date")
        .agg(F.bit_or("_bit").alias("_hours"))
    )
    absent = F.lit(24) - F.coalesce(F.bit_count("_hours"), F.lit(0))
    return (
        spine.join(seen, ["tower_id", "partition_date"], "left")
        .select("tower_id", "partition_date", absent.alias("missing_hours"))
        .where(F.col("missing_hours") > 0)
    )


def rows_by_date(df: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """(partition_date, actual_rows) for every date from first to last, 0 where there is no row. Without
    bounds the table's own first and last date count."""
    counted = df.groupBy("partition_date").agg(F.count(F.lit(1)).alias("actual_rows"))
    # One row for each date: cheap to ask for bounds and to lay out in one task.
    span = counted.agg(F.min("partition_date").alias("first"), F.max("partition_date").alias("last"))
    bound = [F.col(n) if d is None else F.lit(d) for n, d in (("first", first), ("last", last))]
    known = span.where(bound[0].isNotNull() & bound[1].isNotNull() & (bound[0] <= bound[1]))
    spine = known.select(F.explode(F.sequence(*bound)).alias("partition_date"))
    return spine.join(counted, "partition_date", "left").fillna(0, ["actual_rows"])


def incomplete_telemetry_dates(
    telemetry: DataFrame, towers: DataFrame, first: date | None = None, last: date | None = None
) -> DataFrame:
    """Dates whose row count is not exactly towers x 24, dates without any row among them."""
    expected = towers.agg(F.count(F.lit(1)) * 24).scalar()
    rows = rows_by_date(telemetry, first, last).withColumn("expected_rows", expected)
    return rows.where(F.col("actual_rows") != F.col("expected_rows"))


def incomplete_session_dates(
    sessions: DataFrame,
    subscribers: DataFrame,
    per_subscriber: int = 3,
    tolerance: float = 0.95,
    first: date | None = None,
    last: date | None = None,
) -> DataFrame:
    """Dates with fewer rows than ``tolerance`` x subscribers x ``per_subscriber``, dates without any row
    among them."""
    expected = subscribers.agg(F.count(F.lit(1)) * per_subscriber).scalar()
    rows = rows_by_date(sessions, first, last)
    return rows.withColumn("expected_rows", expected).where(
        F.col("actual_rows") < F.col("expected_rows") * F.lit(tolerance)
    )


def tower_master_problems(towers: DataFrame, expected_count: int | Column) -> DataFrame:
    """One row when the count is not the expected one or a required field is missing."""
    expected = F.lit(expected_count) if isinstance(expected_count, int) else expected_count
    incomplete = F.col("lat").isNull() | F.col("lon").isNull() | F.col("cell_type").isNull()
    found = towers.agg(F.count(F.lit(1)).alias("towers"), F.count_if(incomplete).alias("incomplete_towers"))
    return found.withColumn("expected_towers", expected.cast("bigint")).where(
        (F.col("towers") != F.col("expected_towers")) | (F.col("incomplete_towers") > 0)
    )


def _found(name: str, when: Column | None = None, text: Column | None = None, hour: Column | None = None) -> Column:
    """What a check takes from a row: its name and, where rows are counted by value, up to two parts of a key."""
    one = F.struct(
        F.lit(name).alias("check_name"),
        (F.lit(None) if text is None else text).cast("string").alias("text"),
        (F.lit(None) if hour is None else hour).cast("timestamp_ntz").alias("hour"),
    )
    return one if when is None else F.when(when, one)


def standard_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(check_name, violations), one row per standing check, zero included.

    Expects towers, subscribers, telemetry, sessions, events, hotspots and alerts; with thresholds also
    the events without any.

    Each table is scanned once for all of its checks: a row gives the values that a check counts by, or itself where it breaks a
    rule. Values are counted with map-side combine; keys are looked up in towers and profiles once per distinct key, by
    one join for all checks."""
    T = {n: F.col(n) for n in ("tower_id", "event_hour", "severity", "cell_type", "service_type", "status", "subscriber_id", "prb_utilization")}
    seen: list[DataFrame] = []
    # How the counted values of a check become violations.
    rule: dict[str, str] = {}

    def scan(table: str, *found: tuple[str, str, Column]) -> None:
        rule.update((name, kind) for name, kind, _ in found)
        each = F.filter(F.array(*(c for _, _, c in found)), lambda x: x.isNotNull())
        seen.append(tables[table].select(F.explode(each).alias("_f")).select("_f.*"))

    def no_nulls(table: str, *columns: str) -> tuple[str, str, Column]:
        name = f"{table} {'/'.join(columns)} not null"
        return name, "rows", _found(name, reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))

    def unique(table: str, column: str, hour: str | None = None) -> tuple[str, str, Column]:
        name = f"{table} {column}{'/' + hour if hour else ''} unique"
        return name, "repeated", _found(name, None, F.col(column), F.col(hour) if hour else None)

    def accepted(table: str, column: str, values: Sequence[str]) -> tuple[str, str, Column]:
        name = f"{table} {column} accepted"
        return name, "values", _found(name, ~T[column].isin(*values), T[column])

    prb = T["prb_utilization"]
    out_of_range = (prb < 0) | ((prb > 100) & ~F.col("is_sensor_fault"))
    scan(
        "telemetry",
        no_nulls("telemetry", "tower_id", "event_hour"),
        unique("telemetry", "tower_id", "event_hour"),
        ("telemetry prb range", "any", _found("telemetry prb range", out_of_range)),
    )
    known = "sessions tower known"
    scan(
        "sessions",
        no_nulls("sessions", "subscriber_id", "tower_id"),
        accepted("sessions", "service_type", SERVICE_TYPES),
        (known, "orphans", _found(known, T["tower_id"].isNotNull(), T["tower_id"])),
    )
    known, defined = "events tower known", "events threshold defined"
    scan(
        "events",
        no_nulls("events", "tower_id", "severity"),
        accepted("events", "severity", SEVERITIES),
        (known, "orphans", _found(known, T["tower_id"].isNotNull(), T["tower_id"])),
        *([(defined, "profiles", _found(defined, None, T["tower_id"]))] if "thresholds" in tables else []),
    )
    scan("towers", no_nulls("towers", "tower_id", "cell_type"), unique("towers", "tower_id"), accepted("towers", "cell_type", CELL_TYPES))
    scan("hotspots", no_nulls("hotspots", "tower_id"), unique("hotspots", "tower_id"))
    scan("subscribers", no_nulls("subscribers", "subscriber_id"), unique("subscribers", "subscriber_id"))
    scan("alerts", accepted("alerts", "status", ALERT_STATUSES))

    counted = reduce(DataFrame.unionByName, seen).groupBy("check_name", "text", "hour").agg(F.count(F.lit(1)).alias("n"))
    names = {kind: [n for n, k in rule.items() if k == kind] for kind in ("rows", "repeated", "any", "values", "orphans", "profiles")}
    of = lambda kind: F.col("check_name").isin(names[kind]) if names[kind] else F.lit(False)
    # Towers once: known at all, and with a profile.
    limits = F.lit(False)
    parents = tables["towers"].select("tower_id", "cell_type")
    if "thresholds" in tables:
        typed = tables["thresholds"].select("cell_type", F.lit(True).alias("_typed")).distinct()
        parents = parents.join(typed, "cell_type", "left")
        limits = F.coalesce("_typed", F.lit(False))
    parents = parents.groupBy(F.col("tower_id").alias("_key")).agg(F.lit(True).alias("_tower"), F.max(limits).alias("_profile"))
    # Checks that look nothing up have no key there.
    keyed = counted.withColumn("_key", F.when(of("orphans") | of("profiles"), F.col("text")))
    looked = spread_join(keyed, parents, ["_key"], "left", F.struct("check_name", "text", "hour"))
    broken = (
        F.when(of("repeated"), (F.col("n") > 1).cast("int"))
        .when(of("any") | of("values"), 1)
        .when(of("orphans"), F.col("_tower").isNull().cast("int"))
        .when(of("profiles"), F.when(F.coalesce("_profile", F.lit(False)), 0).otherwise(F.col("n")))
        .otherwise(F.col("n"))
    )
    found = looked.select("check_name", broken.cast("long").alias("violations"))
    # A row for each check, so that those without a violation show.
    spark = tables["towers"].sparkSession
    spine = spark.range(1).select(F.explode(F.array(*(F.lit(n) for n in rule))).alias("check_name"), F.lit(0).cast("long").alias("violations"))
    return found.unionByName(spine).groupBy("check_name").agg(F.sum("violations").alias("violations"))
