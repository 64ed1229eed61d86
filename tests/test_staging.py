from datetime import date, datetime

from cellgauge.plans import staging

from conftest import rows

TELEMETRY = (
    "tower_id STRING, event_hour TIMESTAMP_NTZ, prb_utilization DOUBLE, throughput_mbps DOUBLE, latency_ms DOUBLE, "
    "dropped_call_rate DOUBLE, handover_count INT, connected_subscribers INT"
)
SESSIONS = (
    "subscriber_id STRING, tower_id STRING, session_start TIMESTAMP_NTZ, session_end TIMESTAMP_NTZ, "
    "session_duration_min DOUBLE, service_type STRING, bytes_transferred BIGINT"
)
DAY = datetime(2025, 6, 28)


def ids(spark, name, *values):
    return spark.createDataFrame([(v,) for v in values], f"{name} STRING")


def test_clean_telemetry_keeps_known_towers_and_flags_faults(spark):
    raw = spark.createDataFrame(
        [
            ("twr000000001", DAY.replace(hour=8), 75.0, 40.0, 30.0, 0.5, 10, 50),
            ("twr000000002", DAY.replace(hour=8), 105.0, 20.0, 25.0, 0.2, 5, 30),
            ("invalid_tower", DAY.replace(hour=9), 50.0, 30.0, 20.0, 0.1, 3, 20),
        ],
        TELEMETRY,
    )
    towers = ids(spark, "tower_id", "twr000000001", "twr000000002")
    for fit in (None, False):  # broadcast and shuffled
        out = staging.clean_telemetry(raw, towers, towers_fit=fit)
        assert rows(out, "tower_id", "is_sensor_fault", "partition_date", "handover_count") == [
            ("twr000000001", False, date(2025, 6, 28), 10),
            ("twr000000002", True, date(2025, 6, 28), 5),
        ]
    assert dict(out.dtypes)["handover_count"] == "int"


def test_clean_telemetry_reads_text(spark):
    raw = spark.createDataFrame(
        [
            ("a", "2025-06-28 08:00:00", "120", "x", "1", "2", None, "7.9"),
            ("a", "2025-06-28 09:00:00", "NaN", None, "1", "2", "bad", "7"),
            ("a", "yesterday", "50", "1", "1", "2", "1", "7"),
            (None, "2025-06-28 09:00:00", "50", "1", "1", "2", "1", "7"),
        ],
        ", ".join(f"{c.split()[0]} STRING" for c in TELEMETRY.split(", ")),
    )
    towers = ids(spark, "tower_id", "a")
    out = staging.clean_telemetry(raw, towers, partition_date=date(2025, 6, 28))
    assert rows(out, "prb_utilization", "throughput_mbps", "handover_count", "connected_subscribers", "is_sensor_fault") == [
        (120.0, None, 0, 7, True),
        (None, None, 0, 7, False),
    ]
    assert rows(staging.rejected_telemetry(raw), "event_hour") == [("yesterday",)]


def test_dedupe_keeps_one_row_per_tower_hour(spark):
    at = DAY.replace(hour=8)
    raw = spark.createDataFrame([("a", at, p, 1.0, 1.0, 1.0, 1, 1) for p in (9.0, 3.0, 5.0)], TELEMETRY)
    out = staging.clean_telemetry(raw, ids(spark, "tower_id", "a"), dedupe=True)
    assert rows(out, "prb_utilization") == [(3.0,)]


def session(sub, tower, start=8, end=9, minutes=60.0, service="data", size=1024):
    end_at = None if end is None else DAY.replace(hour=end)
    return (sub, tower, DAY.replace(hour=start), end_at, minutes, service, size)


def test_clean_sessions(spark):
    raw = spark.createDataFrame(
        [
            session("sub000001", "twr000000001"),
            session("sub000001", "twr000000001", service="voice", size=0),
            session("sub000002", "bad_tower", 10, 11, 30.0, size=512),
        ],
        SESSIONS,
    )
    towers, subs = ids(spark, "tower_id", "twr000000001"), ids(spark, "subscriber_id", "sub000001")
    for fit in (None, False):
        out = staging.clean_sessions(raw, towers, subs, towers_fit=fit, subscribers_fit=fit)
        assert rows(out, "subscriber_id", "service_type", "bytes_transferred", "partition_date") == [
            ("sub000001", "data", 1024, date(2025, 6, 28))
        ]


def test_clean_sessions_needs_every_field_but_the_end(spark):
    raw = spark.createDataFrame(
        [
            session("s", "t", end=None, size=None),
            session(None, "t"),
            session("s", None),
            session("s", "t", start=9, service=None),
            session("s", "t", start=10),
            session("s", "t", start=10, end=None, service="voice"),
        ],
        SESSIONS,
    )
    out = staging.clean_sessions(raw, ids(spark, "tower_id", "t"), ids(spark, "subscriber_id", "s"))
    got = [(r.session_start.hour, r.session_end, r.bytes_transferred) for r in out.orderBy("session_start").collect()]
    assert got == [(8, None, 0), (10, None, 1024)]
    assert staging.rejected_sessions(raw).count() == 3
