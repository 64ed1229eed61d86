from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cellgauge.functions import columns as c


@pytest.mark.parametrize(
    "metres, expected",
    [(None, "suburban"), (0, "suburban"), (999, "urban"), (1000, "suburban"), (5000, "suburban"), (5001, "rural")],
)
def test_cell_type_boundaries(column, metres, expected):
    assert column(c.cell_type("x"), "x INT", metres) == expected


def test_tower_key_is_stable_and_short(column):
    schema = "radio STRING, mcc INT, net INT, area INT, cell BIGINT"
    key = column(c.tower_key("radio", "mcc", "net", "area", "cell"), schema, "LTE", 510, 1, 100, 1)
    assert key == "09c648b786f4"


@pytest.mark.parametrize("prb, expected", [(69.9, None), (70.0, "WARN"), (84.9, "WARN"), (85.0, "CRITICAL"), (None, None)])
def test_severity_boundaries(column, prb, expected):
    assert column(c.severity("p", F.lit(70.0), F.lit(85.0)), "p DOUBLE", prb) == expected


@pytest.mark.parametrize(
    "prb, latency, dropped, expected",
    [(42.0, 28.0, 0.4, 93.2), (82.0, 28.0, 0.4, 75.2), (200.0, 28.0, 0.4, 0.0), (10.0, 0.0, 0.0, 100.0), (82.0, None, 0.4, 100.0)],
)
def test_health_score(column, prb, latency, dropped, expected):
    score = c.health_score("p", F.lit(70.0), "l", "d")
    assert column(score, "p DOUBLE, l DOUBLE, d DOUBLE", prb, latency, dropped) == pytest.approx(expected)


def test_health_score_strict(column):
    score = c.health_score("p", F.lit(70.0), "l", "d", strict_nulls=True)
    assert column(score, "p DOUBLE, l DOUBLE, d DOUBLE", 82.0, None, 0.4) is None
    assert column(score, "p DOUBLE, l DOUBLE, d DOUBLE", None, 1.0, 0.4) is None


@pytest.mark.parametrize("score, band", [(70.0, "good"), (69.9, "warn"), (40.0, "warn"), (39.9, "critical"), (None, "unknown")])
def test_health_band(column, score, band):
    assert column(c.health_band("x"), "x DOUBLE", score) == band


@pytest.mark.parametrize("n, size", [(None, 400.0), (0, 400.0), (10, 300.0), (500, 750.0), (9999, 2500.0)])
def test_marker_size(column, n, size):
    assert column(c.marker_size("x"), "x INT", n) == size


@pytest.mark.parametrize(
    "text, number",
    [("12.5", 12.5), (" 7 ", 7.0), ("1e3", 1000.0), ("n/a", None), ("", None), ("5f", None), ("5D", None), ("NaN", None), (None, None)],
)
def test_to_number_from_text(column, text, number):
    assert column(c.to_number("x", is_text=True), "x STRING", text) == number


def test_to_number_treats_nan_as_missing(column):
    assert column(c.to_number("x"), "x DOUBLE", float("nan")) is None


@pytest.mark.parametrize("text, number", [("12.9", 12), ("bad", 0), (None, 0), ("-3.7", -3)])
def test_to_counter_truncates(column, text, number):
    assert column(c.to_counter("x", is_text=True), "x STRING", text) == number


@pytest.mark.parametrize("number", [9007199254740993, -9007199254740993, 2**63 - 1])
def test_whole_numbers_stay_whole(column, number):
    assert column(c.to_counter("x", width="bigint"), "x BIGINT", number) == number
    assert column(c.to_counter("x", is_text=True, width="bigint"), "x STRING", str(number)) == number
    assert column(c.to_counter("x", is_text=True, width="bigint"), "x STRING", f"{number}.7") == number


@pytest.mark.parametrize("kind, value", [("BIGINT", 3_000_000_000), ("DOUBLE", 3e9), ("DOUBLE", -1e300), ("DOUBLE", float("inf")), ("STRING", "3000000000"), ("STRING", "1e40")])
def test_counters_out_of_range_are_told_apart_from_missing_ones(column, kind, value):
    text = kind == "STRING"
    assert column(c.to_counter("x", text), f"x {kind}", value) is None
    assert column(c.counter_overflow("x", text), f"x {kind}", value) is True
    assert column(c.counter_overflow("x", text), f"x {kind}", None) is False
    assert column(c.to_counter("x", text), f"x {kind}", None) == 0


@pytest.mark.parametrize("width, low, high", [("int", -(2**31), 2**31 - 1), ("bigint", -(2**63), 2**63 - 1)])
def test_counters_of_doubles_and_whole_numbers_take_the_short_way(column, width, low, high):
    values = [0.0, -0.5, 7.9, -7.9, float(low), float(low) - 0.5, float(low) * 1.001, float(high) + 1, 2.0**30, float("nan"), float("-inf"), None]
    if width == "bigint":
        # The way through decimals takes the shortest digits of the double, which are below the type's least value.
        assert column(c.to_counter("x", False, width, "double"), "x DOUBLE", float(low)) == low
        values = [x for x in values if x != float(low)]
    for x in values:
        for f in (c.to_counter, c.counter_overflow):
            assert column(f("x", False, width, "double"), "x DOUBLE", x) == column(f("x", False, width), "x DOUBLE", x), x
    for x in [0, low, high, -(2**63), 2**63 - 1, 2**31, None]:
        for f in (c.to_counter, c.counter_overflow):
            assert column(f("x", False, width, "whole"), "x BIGINT", x) == column(f("x", False, width), "x BIGINT", x), x


@pytest.mark.parametrize("prb, fault", [(100.0, False), (100.1, True), (None, False)])
def test_sensor_fault(column, prb, fault):
    assert column(c.sensor_fault("x"), "x DOUBLE", prb) is fault


def test_time_parts(column):
    at = datetime(2025, 6, 29, 23, 59, 59, 999999)  # a Sunday
    t = F.col("t")
    assert column(c.day_of_week(t), "t TIMESTAMP_NTZ", at) == 0
    assert column(c.hour_floor(t), "t TIMESTAMP_NTZ", at) == datetime(2025, 6, 29, 23)
    assert column(c.local_hour(t), "t TIMESTAMP_NTZ", at) == 6
    assert column(c.at_hour("d", F.lit(5)), "d DATE", date(2025, 3, 30)) == datetime(2025, 3, 30, 5)


@pytest.mark.parametrize("utc_hour, factor", [(1, 1.35), (2, 1.35), (3, 1.0), (11, 1.35), (13, 1.35), (14, 1.0), (17, 0.65), (22, 0.65), (23, 1.0)])
def test_load_factor(column, utc_hour, factor):
    assert column(c.load_factor("t"), "t TIMESTAMP_NTZ", datetime(2025, 1, 1, utc_hour)) == factor


def test_times_do_not_depend_on_the_session_zone(spark, column):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        # 02:30 does not exist there on this day.
        at = datetime(2025, 3, 9, 2, 30)
        assert column(c.hour_floor("t"), "t TIMESTAMP_NTZ", at) == datetime(2025, 3, 9, 2)
        assert column(c.ntz(at)) == at
        assert column(c.from_epoch_seconds("x"), "x BIGINT", 1700000000) == datetime(2023, 11, 14, 22, 13, 20)
        assert column(c.age_days("t", c.ntz(datetime(2025, 3, 10, 2, 30))), "t TIMESTAMP_NTZ", at) == 1.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_unknown_window_is_an_error():
    with pytest.raises(ValueError, match="Unknown window"):
        c.window_interval("1y")


@pytest.mark.parametrize("x, up, even", [(83.45, 83.5, 83.4), (83.45000000000003, 83.5, 83.4), (88.35, 88.4, 88.4), (0.25, 0.3, 0.2)])
def test_rounding(column, x, up, even):
    assert column(c.round_half_up("x"), "x DOUBLE", x) == up
    assert column(c.round_half_even("x"), "x DOUBLE", x) == even


def test_percent_text(column):
    assert column(c.percent_text("x"), "x DOUBLE", 35.0) == "35.0%"
    assert column(c.percent_text("x"), "x DOUBLE", 54.1666666) == "54.2%"


def test_great_circle(column):
    d = c.great_circle_m(F.lit(-6.2088), F.lit(106.8456), F.lit(-6.21), F.lit(106.85))
    assert column(d) == pytest.approx(504.358, abs=0.001)
    same = c.great_circle_m(F.lit(-6.2), F.lit(106.8), F.lit(-6.2), F.lit(106.8))
    assert column(same) == pytest.approx(0, abs=0.2)


def test_ratio_by_zero_is_null(column):
    assert column(c.ratio(F.lit(1), F.lit(0))) is None
    assert column(c.percent_of(F.lit(1), F.lit(4))) == 25.0
