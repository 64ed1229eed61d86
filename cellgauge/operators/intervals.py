"""Sessions that overlap given tower-hours, without a range join.

An event at any time t lasts one hour. A session overlaps it, ends included, when t is between the
session's start less one hour and its end. That stretch is cut by day. Per tower and day the wanted
times are kept as a list next to a 24-bit mask of their hours, so a session meets one row for each day
of its stretch, by equality; the mask drops most sessions, and the exact times decide.

Such a list has at most 24 times where events are on the hour. Where they are not, it has no bound, and both sides
are cut into buckets instead: the whole days of a stretch, and the hours at its ends."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.operators.joins import BROADCAST_BYTES, TASK_ROWS, salted_join

_EPOCH = date(1970, 1, 1)


def hour_masks(tower_hours: DataFrame) -> DataFrame:
    """(tower_id, day, hours, times): the distinct event times of a tower on a day, and a mask in which bit
    h is set when one of them is in hour h. Days are counted from 1970, as integers."""
    return (
        tower_hours.select(
            "tower_id", "event_hour", _day("event_hour").alias("day"), F.expr("shiftleft(1, hour(event_hour))").alias("_bit")
        )
        .groupBy("tower_id", "day")
        .agg(F.bit_or("_bit").alias("hours"), F.collect_set("event_hour").alias("times"))
    )


def masks_fit(towers: int, days: int, hourly: bool = True) -> bool:
    """Whether the masks of so many towers and days may be broadcast, by their largest possible size: 24
    times of a tower and day if events are on the hour, else no bound is known."""
    return hourly and towers * days * (64 + 24 * 8) <= BROADCAST_BYTES


def _day(ts) -> Column:
    return F.unix_date(F.to_date(ts))


def _midnight(day: Column) -> Column:
    return F.date_from_unix_date(day).cast("timestamp_ntz")


def sessions_in_hours(
    sessions: DataFrame,
    tower_hours: DataFrame,
    days: tuple[date, date] | None = None,
    masks_fit: bool = False,
    task_rows: int = TASK_ROWS,
    hourly: bool = True,
) -> DataFrame:
    """Every session once per wanted time it overlaps, with that time as ``event_hour``. ``hourly`` says that these are
    on the hour; it decides how they are met, not which.

    A NULL end never overlaps. Sessions outside the range of the wanted days are filtered in the scan, and
    days outside it are cut before they are unfolded; neither can match. ``days`` passes the range
    on where it is known, else it is a scalar subquery. ``masks_fit`` says that the masks may be
    broadcast, see :func:`masks_fit`; no job is run here to find out."""
    masks = hour_masks(tower_hours)
    spans = masks if hourly else tower_hours.select(_day("event_hour").alias("day"))
    if days is not None:
        first_day, last_day = (F.lit((d - _EPOCH).days) for d in days)
    else:
        span = spans.agg(F.struct(F.min("day").alias("first"), F.max("day").alias("last")).alias("span")).scalar()
        first_day, last_day = span.getField("first"), span.getField("last")
    earliest = F.col("session_start") - F.expr("INTERVAL 1 HOUR")
    # An event of the last day may last an hour into the next one.
    in_range = (earliest < _midnight(last_day + 1)) & (F.col("session_end") >= _midnight(first_day))
    wanted_sessions = sessions.where(in_range & (F.col("session_start") <= F.col("session_end") + F.expr("INTERVAL 1 HOUR")))
    if not hourly:
        return _met_in_buckets(wanted_sessions, tower_hours, earliest, first_day, last_day, task_rows).select(*sessions.columns, "event_hour")
    runs = (
        wanted_sessions.withColumns(
            {"_d1": _day(earliest), "_h1": F.hour(earliest), "_d2": _day("session_end"), "_h2": F.hour("session_end")}
        )
        .withColumns({"_from": F.greatest(F.col("_d1"), first_day), "_to": F.least(F.col("_d2"), last_day)})
        .where(F.col("_from") <= F.col("_to"))
        .withColumn("day", F.explode(F.sequence("_from", "_to")))
        .withColumns(
            {
                "_h1": F.when(F.col("day") == F.col("_d1"), F.col("_h1")).otherwise(0),
                "_h2": F.when(F.col("day") == F.col("_d2"), F.col("_h2")).otherwise(23),
            }
        )
        .drop("_d1", "_d2", "_from", "_to")
    )
    on = ["tower_id", "day"]
    if masks_fit:
        met = runs.join(F.broadcast(masks), on)
    else:
        met = salted_join(runs, masks, on, "inner", F.col("subscriber_id"), task_rows)
    # Bits h1..h2. Most sessions meet no wanted hour and go before their times are unfolded.
    wanted = F.col("hours").bitwiseAND(F.expr("shiftleft(1, _h2 + 1) - shiftleft(1, _h1)"))
    exact = F.filter("times", lambda t: (t >= earliest) & (t <= F.col("session_end")))
    return (
        met.where(wanted != 0).withColumn("event_hour", F.explode(exact)).drop("_h1", "_h2", "hours", "times", "day")
    )


def _hour(ts) -> Column:
    """Hours from 1970 to that of a time."""
    return _day(ts).cast("bigint") * 24 + F.hour(ts)


def _met_in_buckets(sessions: DataFrame, times: DataFrame, earliest: Column, first_day: Column, last_day: Column, task_rows: int) -> DataFrame:
    """Sessions next to the times in their stretch, for any number of times. A time is in two buckets, its hour (``_days``
    false) and its day; a stretch is in one for each of its whole days, and the hours before and after these. So each
    time of a stretch is met once, and rows, not lists, are joined."""
    pair = lambda whole, n: F.struct(F.lit(whole).alias("_days"), n.alias("_bucket"))
    events = (
        times.select("tower_id", "event_hour")
        .distinct()
        .withColumn("_in", F.explode(F.array(pair(False, _hour("event_hour")), pair(True, _day("event_hour").cast("bigint")))))
        .select("tower_id", "event_hour", "_in.*")
    )
    ends = {
        "_h1": F.greatest(_hour(earliest), first_day.cast("bigint") * 24),
        "_h2": F.least(_hour("session_end"), last_day.cast("bigint") * 24 + 23),
    }
    # The first day that begins within the stretch, and the last one that ends within it.
    whole = {"_d1": F.ceil(F.col("_h1") / 24).cast("bigint"), "_d2": F.floor((F.col("_h2") + 1) / 24).cast("bigint") - 1}

    def run(first: Column, last: Column, days: bool) -> Column:
        none = F.array().cast("array<struct<_days:boolean,_bucket:bigint>>")
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda n: pair(days, n))).otherwise(none)

    h1, h2, d1, d2 = (F.col(c) for c in ("_h1", "_h2", "_d1", "_d2"))
    parts = F.when(d1 <= d2, F.concat(run(h1, d1 * 24 - 1, False), run(d1, d2, True), run((d2 + 1) * 24, h2, False)))
    cut = sessions.withColumns(ends).where("_h1 <= _h2").withColumns(whole)
    cut = cut.withColumn("_in", F.explode(parts.otherwise(run(h1, h2, False)))).select(*sessions.columns, "_in.*")
    met = salted_join(cut, events, ["tower_id", "_days", "_bucket"], "inner", F.col("subscriber_id"), task_rows)
    return met.where((F.col("event_hour") >= earliest) & (F.col("event_hour") <= F.col("session_end")))
