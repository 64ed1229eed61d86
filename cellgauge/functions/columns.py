"""Scalar rules of the domain as Column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius of the distance rule, hex digits of a tower id.
EARTH_RADIUS_M = 6371000.0
TOWER_KEY_DIGITS = 12

# Cell types by range in metres.
URBAN_BELOW_M, SUBURBAN_TO_M = 1000, 5000

# Weights of the health score and the lower bounds of its bands.
PRB_EXCESS_WEIGHT, LATENCY_DIVISOR, DROPPED_WEIGHT = 1.5, 10, 10
GOOD_FROM, WARN_FROM = 70, 40

# Marker size without subscribers, smallest, largest, and size per subscriber.
EMPTY_MARKER, SMALLEST_MARKER, LARGEST_MARKER, MARKER_PER_SUBSCRIBER = 400.0, 300.0, 2500.0, 1.5

# Look-back windows offered by the reports.
WINDOWS = {"24h": "1 DAY", "7d": "7 DAYS", "30d": "30 DAYS"}

# Local rush hours, and the load factors for rush, night and the rest.
RUSH_HOURS = (8, 9, 18, 19, 20)
LAST_NIGHT_HOUR = 5
RUSH_LOAD, NIGHT_LOAD, PLAIN_LOAD = 1.35, 0.65, 1.0

# Capacity weight per cell type.
CAPACITY_WEIGHTS = {"urban": 3.0, "suburban": 2.0, "rural": 1.0}
OTHER_CAPACITY_WEIGHT = 1.5


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- identity and classification -------------------------------------------------------------


def tower_key(radio, mcc, net, area, cell) -> Column:
    """Stable tower id: the first 12 hex digits of SHA-256 over the pipe-joined cell identity."""
    parts = [_col(c).cast("string") for c in (radio, mcc, net, area, cell)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, TOWER_KEY_DIGITS)


def cell_type(range_m) -> Column:
    r = _col(range_m)
    return (
        F.when(r.isNull() | (r == 0), "suburban")
        .when(r < URBAN_BELOW_M, "urban")
        .when(r <= SUBURBAN_TO_M, "suburban")
        .otherwise("rural")
    )


def severity(prb, warn, critical) -> Column:
    p = _col(prb)
    return F.when(p >= _col(critical), "CRITICAL").when(p >= _col(warn), "WARN")


def health_score(prb, warn, latency, dropped, strict_nulls: bool = False) -> Column:
    """0-100 score. A missing input leaves 100, since LEAST and GREATEST skip NULL; ``strict_nulls``
    gives NULL instead."""
    p, w, lat, drop = _col(prb), _col(warn), _col(latency), _col(dropped)
    excess = F.greatest(F.lit(0.0), (p - w) * PRB_EXCESS_WEIGHT)
    raw = F.lit(100.0) - excess - lat / LATENCY_DIVISOR - drop * DROPPED_WEIGHT
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    if strict_nulls:
        return F.when(p.isNotNull() & w.isNotNull() & raw.isNotNull(), score)
    return score


def health_band(score) -> Column:
    s = _col(score)
    return (
        F.when(s.isNull(), "unknown")
        .when(s >= GOOD_FROM, "good")
        .when(s >= WARN_FROM, "warn")
        .otherwise("critical")
    )


def marker_size(subscribers) -> Column:
    n = _col(subscribers)
    return F.when(n.isNull() | (n <= 0), F.lit(EMPTY_MARKER)).otherwise(
        F.least(F.lit(LARGEST_MARKER), F.greatest(F.lit(SMALLEST_MARKER), n * MARKER_PER_SUBSCRIBER))
    )


def capacity_weight(kind) -> Column:
    k, out = _col(kind), None
    for name, weight in CAPACITY_WEIGHTS.items():
        out = F.when(k == name, weight) if out is None else out.when(k == name, weight)
    return out.otherwise(OTHER_CAPACITY_WEIGHT)


# --- cleaning --------------------------------------------------------------------------------


def to_number(c, is_text: bool = False) -> Column:
    """Number or NULL. NaN counts as missing. Spark parses a Java type suffix ("5f") that is not a
    number to anyone else, so text with one is rejected."""
    x = _col(c)
    if is_text:
        x = F.when(~x.rlike(r"[0-9.][dDfF]\s*$"), x)
    x = x.try_cast("double")
    return F.when(~F.isnan(x), x)


def _whole(c, is_text: bool) -> Column:
    """Whole part as a decimal of 38 digits, so that no integer passes through a double."""
    x = _col(c)
    if is_text:
        readable = to_number(c, True).isNotNull()
        exact = x.try_cast("decimal(38,6)")
        return F.when(readable, F.coalesce(exact, to_number(c, True).try_cast("decimal(38,6)")))
    # A double has no digits to keep beyond its own; other numbers cast exactly.
    return F.when(~F.isnan(x.try_cast("double")), x.try_cast("decimal(38,6)"))


def _truncated(c, is_text: bool) -> Column:
    x = _whole(c, is_text)
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))


def _out_of_range(x: Column, width: str) -> Column:
    """Whether the whole part of a double lies outside the type; the bounds are doubles without rounding."""
    low = F.lit(-9.223372036854775808e18) if width == "bigint" else F.lit(-2147483649.0)
    return (x >= (9.223372036854775808e18 if width == "bigint" else 2147483648.0)) | (x < low if width == "bigint" else x <= low)


def to_counter(c, is_text: bool = False, width: str = "int", kind: str = "") -> Column:
    """Whole number, truncated; missing or unreadable counts as 0. One out of range is NULL, see
    :func:`counter_overflow`. ``kind`` double or whole names the field's type and spares it the way through decimals."""
    x = _col(c)
    if kind == "double":
        return F.when(x.isNull() | F.isnan(x), F.lit(0).cast(width)).when(~_out_of_range(x, width), x.try_cast(width))
    if kind == "whole":
        return F.when(x.isNull(), F.lit(0).cast(width)).otherwise(x.try_cast(width))
    wanted = _truncated(c, is_text).try_cast(width)
    return F.when(counter_overflow(c, is_text, width), F.lit(None)).otherwise(F.coalesce(wanted, F.lit(0).cast(width)))


def counter_overflow(c, is_text: bool = False, width: str = "int", kind: str = "") -> Column:
    """Whether the field is a number that the counter's type cannot hold."""
    x = _col(c)
    if kind == "double":
        return x.isNotNull() & ~F.isnan(x) & _out_of_range(x, width)
    if kind == "whole":
        return x.isNotNull() & x.try_cast(width).isNull()
    number = to_number(c, is_text)
    return number.isNotNull() & _truncated(c, is_text).try_cast(width).isNull()


def sensor_fault(prb) -> Column:
    return F.coalesce(_col(prb) > 100.0, F.lit(False))


def to_timestamp_ntz(c) -> Column:
    return _col(c).try_cast("timestamp_ntz")


# --- time ------------------------------------------------------------------------------------


def ntz(moment: datetime | None) -> Column:
    """Zone-less literal of a naive datetime, independent of the Python and session time zones."""
    return F.lit(None if moment is None else moment.isoformat(sep=" ")).cast("timestamp_ntz")


def from_epoch_seconds(seconds) -> Column:
    """Zone-less UTC timestamp, whatever the session time zone."""
    zero = F.lit(0)
    since = F.make_dt_interval(zero, zero, zero, _col(seconds).cast("decimal(18,6)"))
    return F.lit("1970-01-01").cast("timestamp_ntz") + since


def at_hour(day, hour) -> Column:
    zero = F.lit(0)
    return _col(day).cast("timestamp_ntz") + F.make_dt_interval(zero, _col(hour), zero, zero.cast("decimal(18,6)"))


def hour_floor(ts) -> Column:
    """Start of the hour. Unlike date_trunc it keeps TIMESTAMP_NTZ and so does not depend on the session
    time zone."""
    return at_hour(F.to_date(_col(ts)), F.hour(_col(ts)))


def day_of_week(ts) -> Column:
    """0 = Sunday."""
    return F.dayofweek(_col(ts)) - 1


def local_hour(ts, offset_hours: int = 7) -> Column:
    return F.pmod(F.hour(_col(ts)) + offset_hours, F.lit(24)).cast("int")


def load_factor(ts, offset_hours: int = 7) -> Column:
    """Expected load relative to a plain hour, by local hour of day."""
    h = local_hour(ts, offset_hours)
    return (
        F.when(h.isin(*RUSH_HOURS), RUSH_LOAD)
        .when(h <= LAST_NIGHT_HOUR, NIGHT_LOAD)
        .otherwise(PLAIN_LOAD)
    )


def window_interval(window: str) -> Column:
    if window not in WINDOWS:
        raise ValueError(f"Unknown window: {window}")
    return F.expr(f"INTERVAL {WINDOWS[window]}")


def age_days(since, as_of) -> Column:
    """Days between two zone-less timestamps, as a double."""
    gap = _col(as_of).cast("timestamp_ntz") - _col(since).cast("timestamp_ntz")
    seconds = (
        F.extract(F.lit("DAY"), gap) * 86400
        + F.extract(F.lit("HOUR"), gap) * 3600
        + F.extract(F.lit("MINUTE"), gap) * 60
        + F.extract(F.lit("SECOND"), gap)
    )
    return seconds.cast("double") / 86400.0


# --- numbers and text ------------------------------------------------------------------------


# Rounding goes through a decimal: float noise below 1e-9, which depends on the order of addition,
# cannot turn a tie one way or the other.
_EXACT = "decimal(38,9)"


def round_half_up(x, digits: int = 1) -> Column:
    return F.round(_col(x).cast(_EXACT), digits).cast("double")


def round_half_even(x, digits: int = 1) -> Column:
    return F.bround(_col(x).cast(_EXACT), digits).cast("double")


def percent_text(x) -> Column:
    return F.concat(F.round(_col(x).cast(_EXACT), 1).cast("string"), F.lit("%"))


def ratio(numerator, denominator) -> Column:
    """NULL when the denominator is 0 or NULL."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def percent_of(numerator, denominator) -> Column:
    return ratio(numerator, denominator) * 100


# --- space -----------------------------------------------------------------------------------


def great_circle_m(lat_a, lon_a, lat_b, lon_b) -> Column:
    """Distance by the spherical law of cosines, with the cosine held within [-1, 1]."""
    phi_a, phi_b = F.radians(_col(lat_a)), F.radians(_col(lat_b))
    turn = F.radians(_col(lon_b)) - F.radians(_col(lon_a))
    cosine = F.cos(phi_a) * F.cos(phi_b) * F.cos(turn) + F.sin(phi_a) * F.sin(phi_b)
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))) * EARTH_RADIUS_M
