from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cellgauge.network import Network  # noqa: E402
from cellgauge.schemas import SESSION_SCHEMA, TELEMETRY_SCHEMA, TOWER_SCHEMA, default_thresholds  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("cellgauge-tests")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Value of a Column expression over one row of named inputs."""

    def value(expr, schema: str = "x INT", *row):
        return spark.createDataFrame([row or (0,)], schema).select(expr.alias("v")).first().v

    return value


def tower(tower_id, lat, lon, cell_type="urban", province="DKI Jakarta", island="Jawa", radio="LTE", mnc=1, cell=1):
    return (tower_id, radio, 510, mnc, 100, cell, lon, lat, 500, 10, 1, cell_type, province, island, None, None)


@pytest.fixture(scope="session")
def seed(spark) -> Network:
    """Three towers, eight days of hourly readings, three sessions."""
    ids = ["twr000000001", "twr000000002", "twr000000003"]
    towers = spark.createDataFrame(
        [
            tower(ids[0], -6.2088, 106.8456, "urban", mnc=1, cell=1),
            tower(ids[1], -6.2100, 106.8500, "suburban", mnc=8, cell=2),
            tower(ids[2], -6.9175, 107.6191, "rural", "Jawa Barat", mnc=11, cell=3),
        ],
        TOWER_SCHEMA,
    )
    rows = []
    for i, (tower_id, handovers) in enumerate(zip(ids, (20, 8, 5))):
        for h in range(192):
            at = datetime(2025, 6, 21) + timedelta(hours=h)
            prb = 82.0 if i == 0 and 8 <= at.hour <= 20 else 115.0 if i == 1 and at.hour == 12 else 42.0
            rows.append((tower_id, at, prb, 45.0, 28.0, 0.4, handovers, 60, prb > 100, at.date()))
    day = datetime(2025, 6, 28)

    def session(sub, tower_id, start, end, minutes, service, size):
        return (sub, tower_id, day + start, day + end, float(minutes), service, size, day.date())

    hm = lambda h, m=0: timedelta(hours=h, minutes=m)
    sessions = [
        session("sub000001", ids[0], hm(8), hm(10), 120, "data", 5000000),
        session("sub000001", ids[0], hm(8, 30), hm(9, 30), 60, "voice", 0),
        session("sub000002", ids[1], hm(11), hm(12, 30), 90, "data", 2000000),
    ]
    return Network(
        towers=towers,
        thresholds=default_thresholds(spark),
        telemetry=spark.createDataFrame(rows, TELEMETRY_SCHEMA),
        sessions=spark.createDataFrame(sessions, SESSION_SCHEMA),
    )


def rows(df, *order):
    """Rows as tuples, sorted for comparison."""
    return sorted((tuple(r) for r in df.select(*order).collect()) if order else (tuple(r) for r in df.collect()), key=repr)


def by_key(df, key, *values):
    return {r[key]: tuple(r[v] for v in values) if len(values) > 1 else r[values[0]] for r in df.collect()}


__all__ = ["rows", "by_key", "tower", "F"]
