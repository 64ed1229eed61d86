"""Fast forms against brute force on small random inputs."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cellgauge.functions.columns import great_circle_m
from cellgauge.operators.intervals import sessions_in_hours
from cellgauge.operators.joins import fits, hot_keys, spread_join
from cellgauge.operators.sampling import take_by_hash
from cellgauge.operators.spatial import (
    covered_points,
    neighbour_pairs,
    point_in_cover,
    point_in_polygon,
    polygon_candidates,
    polygon_cover,
    updated_pairs,
)
from cellgauge.plans import marts
from cellgauge.sources.cells import province_edges

from conftest import rows

PATHS = [{"max_rows": 10_000}, {"max_rows": 0, "task_rows": 7}]
SESSION_PATHS = [{"masks_fit": True}, {"task_rows": 7}, {"hourly": False}, {"hourly": False, "task_rows": 7}]


# --- joins -----------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    """One key holds a third of the rows, and some rows have no key."""
    big = spark.range(900).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id") % 50).alias("k"),
    )
    small = spark.createDataFrame([(k, f"v{k}") for k in range(0, 40)] + [(0, "again"), (None, "none")], "k BIGINT, v STRING")
    plain = rows(big.join(small, ["k"], how))
    for options in PATHS:
        assert rows(spread_join(big, small, ["k"], how, F.col("id"), **options)) == plain


def test_hot_keys_gives_salts(spark):
    df = spark.range(100).select((F.col("id") % 2 * F.col("id")).alias("k"))
    assert rows(hot_keys(df, ["k"], 20)) == [(0, 3)]


def test_every_hot_key_is_salted(spark):
    """12,500 keys over the task limit, more than any list of the largest ones would hold."""
    big = spark.range(25_000).select("id", (F.col("id") % 12_500).alias("k"))
    small = spark.range(0, 12_600, 2).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    assert hot_keys(big, ["k"], 1).count() == 12_500
    assert rows(spread_join(big, small, ["k"], "left", F.col("id"), max_rows=0, task_rows=1)) == rows(big.join(small, ["k"], "left"))


def test_fits(spark):
    assert fits(spark.range(10), 10) and not fits(spark.range(11), 10)
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert fits(wide, max_bytes=11_000) and not fits(wide, max_bytes=10_000)
    assert not fits(spark.range(1).select(F.array("id").alias("a")))


def test_right_join_is_refused(spark):
    with pytest.raises(ValueError):
        spread_join(spark.range(1), spark.range(1), ["id"], "right", F.col("id"))


# --- neighbours ------------------------------------------------------------------------------


def _places(kind):
    rng = random.Random(kind)
    if kind == "dense":
        return [(-6.2 + rng.uniform(-0.1, 0.1), 106.8 + rng.uniform(-0.1, 0.1)) for _ in range(120)]
    if kind == "copies":
        return [(-6.2, 106.8)] * 40 + [(-6.2 + i * 0.01, 106.8) for i in range(40)]
    if kind == "date line":
        return [(rng.uniform(-16.1, -16.0), (179.95 + rng.uniform(0, 0.1) + 180) % 360 - 180) for _ in range(60)] + [
            (-16.05, 180.0),
            (-16.05, -180.0),
        ]
    if kind == "pole":
        return [(rng.choice([-1, 1]) * rng.uniform(89.9, 90.0), rng.uniform(-180, 180)) for _ in range(60)] + [
            (rng.uniform(88.9, 89.2), rng.uniform(-180, 180)) for _ in range(60)
        ]
    # world: clusters, so that pairs exist at many latitudes
    out = []
    for _ in range(25):
        lat, lon = rng.uniform(-88, 88), rng.uniform(-180, 180)
        out += [
            (lat + rng.uniform(-0.03, 0.03), lon + rng.uniform(-0.03, 0.03) / max(0.03, math.cos(math.radians(lat))))
            for _ in range(5)
        ]
    return out


@pytest.mark.parametrize("kind", ["dense", "copies", "date line", "pole", "world"])
def test_neighbour_pairs_equal_all_pairs(spark, kind):
    towers = spark.createDataFrame(
        [(f"t{i}", lat, lon) for i, (lat, lon) in enumerate(_places(kind))], "tower_id STRING, lat DOUBLE, lon DOUBLE"
    )
    a, b = towers.toDF("a", "la", "oa"), towers.toDF("b", "lb", "ob")
    near = great_circle_m("la", "oa", "lb", "ob") < 3000
    expected = rows(a.crossJoin(b).where((F.col("a") != F.col("b")) & near).select("a", "b"))
    assert len(expected) > 20
    for options in PATHS:
        assert rows(neighbour_pairs(towers, **options)) == expected


# --- intervals -------------------------------------------------------------------------------


def test_sessions_in_hours_equal_range_join(spark):
    rng = random.Random(5)
    start = datetime(2024, 2, 27)
    hours = {(f"t{rng.randrange(4)}", start + timedelta(hours=rng.randrange(24 * 6))) for _ in range(150)}
    sessions = []
    for i in range(300):
        begin = start + timedelta(minutes=rng.randrange(-2000, 60 * 24 * 6), seconds=rng.choice([0, 0, 1, 59]))
        if i % 7 == 0:
            begin = begin.replace(minute=0, second=0)
        length = rng.choice([0, 5, 60, 600, 3000, 100000, -30])
        end = None if i % 17 == 0 else begin + timedelta(minutes=length)
        tower = "t0" if i % 3 == 0 else f"t{rng.randrange(5)}"
        sessions.append((i, f"s{i % 40}", tower, begin, end))
    s = spark.createDataFrame(
        sessions, "id INT, subscriber_id STRING, tower_id STRING, session_start TIMESTAMP_NTZ, session_end TIMESTAMP_NTZ"
    )
    h = spark.createDataFrame(list(hours), "tower_id STRING, event_hour TIMESTAMP_NTZ")
    expected = sorted(
        (i, at)
        for i, _, tower, begin, end in sessions
        for t, at in hours
        if t == tower and end is not None and begin <= at + timedelta(hours=1) and end >= at
    )
    assert len(expected) > 500
    days = min(at for _, at in hours).date(), max(at for _, at in hours).date()
    for options in [*SESSION_PATHS, {"days": days}, {"days": days, "hourly": False}]:
        got = sorted((r.id, r.event_hour) for r in sessions_in_hours(s, h, **options).collect())
        assert got == expected


def test_many_event_times_of_one_day_are_no_list(spark):
    """200,000 times of one tower and day: every row of the join's sides is small, and each pair comes once."""
    day = datetime(2024, 2, 27)
    times = spark.range(200_000).selectExpr("'t' AS tower_id", "timestamp_ntz'2024-02-27 00:00:00' + make_dt_interval(0, 0, 0, id * 0.4) AS event_hour")
    told = [(1, "a", "t", day + timedelta(hours=5), day + timedelta(hours=5, minutes=30)), (2, "b", "t", day - timedelta(days=3), day + timedelta(days=3))]
    s = spark.createDataFrame(told, "id INT, subscriber_id STRING, tower_id STRING, session_start TIMESTAMP_NTZ, session_end TIMESTAMP_NTZ")
    met = sessions_in_hours(s, times.unionAll(times), hourly=False)
    assert {r.id: r["count"] for r in met.groupBy("id").count().collect()} == {1: 90 * 150 + 1, 2: 200_000}
    assert "collect_set" not in met._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(3))
def test_sessions_in_events_at_any_time(spark, seed):
    """Events with minutes, seconds and microseconds, some across midnight, against the closed range test."""
    rng = random.Random(seed)
    start = datetime(2024, 2, 27)
    hour = timedelta(hours=1)
    events = {
        (f"t{rng.randrange(3)}", start + timedelta(minutes=rng.randrange(60 * 72), seconds=rng.choice([0, 0, 59]), microseconds=rng.choice([0, 1])))
        for _ in range(120)
    }
    events |= {("t0", start + timedelta(hours=23, minutes=m)) for m in (0, 1, 30, 59)}
    sessions = []
    for i in range(250):
        begin = start + timedelta(minutes=rng.randrange(-200, 60 * 75), microseconds=rng.choice([0, 0, 1]))
        end = begin + timedelta(minutes=rng.choice([0, 1, 29, 60, 90, 1500, -10, -70]))
        sessions.append((i, f"s{i}", f"t{rng.randrange(4)}", begin, end))
    for i, (tower, at) in enumerate(sorted(events)[:40]):  # exactly on either end
        sessions += [(1000 + i, "a", tower, at + hour, at + hour * 2), (2000 + i, "b", tower, at - hour, at)]
    s = spark.createDataFrame(
        sessions, "id INT, subscriber_id STRING, tower_id STRING, session_start TIMESTAMP_NTZ, session_end TIMESTAMP_NTZ"
    )
    h = spark.createDataFrame(sorted(events), "tower_id STRING, event_hour TIMESTAMP_NTZ")
    expected = sorted((i, at) for i, _, t, b, e in sessions for tower, at in events if t == tower and b <= at + hour and e >= at)
    for options in SESSION_PATHS:
        assert sorted((r.id, r.event_hour) for r in sessions_in_hours(s, h, **options).collect()) == expected


def test_subscriber_impact_equals_range_join(spark):
    """Repeated events, NULL subscribers and several sessions of one subscriber in one hour."""
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    events = [(f"t{rng.randrange(3)}", start + timedelta(hours=rng.randrange(48)), "WARN") for _ in range(60)]
    sessions = [
        (
            None if i % 19 == 0 else f"s{rng.randrange(12)}",
            f"t{rng.randrange(3)}",
            start + timedelta(minutes=rng.randrange(48 * 60)),
            float(rng.randrange(1, 200)),
            rng.choice(["voice", "data", "SMS"]),
        )
        for i in range(200)
    ]
    e = spark.createDataFrame(events, "tower_id STRING, event_hour TIMESTAMP_NTZ, severity STRING")
    s = spark.createDataFrame(
        [(a, b, c, c + timedelta(minutes=d), d, f) for a, b, c, d, f in sessions],
        "subscriber_id STRING, tower_id STRING, session_start TIMESTAMP_NTZ, session_end TIMESTAMP_NTZ, "
        "session_duration_min DOUBLE, service_type STRING",
    )
    e.createOrReplaceTempView("e")
    s.createOrReplaceTempView("s")
    expected = spark.sql("""
        SELECT e.tower_id, e.event_hour, e.severity, count(DISTINCT subscriber_id), sum(session_duration_min),
            count(DISTINCT CASE service_type WHEN 'voice' THEN subscriber_id END),
            count(DISTINCT CASE service_type WHEN 'data' THEN subscriber_id END),
            count(DISTINCT CASE service_type WHEN 'SMS' THEN subscriber_id END)
        FROM e LEFT JOIN s ON e.tower_id = s.tower_id AND session_start <= event_hour + INTERVAL 1 HOUR
            AND session_end >= event_hour
        GROUP BY 1, 2, 3""")
    for options in SESSION_PATHS:
        assert rows(marts.subscriber_impact(e, s, **options)) == rows(expected)


# --- points in polygons ----------------------------------------------------------------------

SHAPES = {
    "Ell": [[[(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)]]],
    "Frame": [[[(5, 0), (9, 0), (9, 4), (5, 4), (5, 0)], [(6, 1), (8, 1), (8, 3), (6, 3), (6, 1)]]],
    "Isles": [[[(0, 6), (2, 6), (1, 8), (0, 6)]], [[(3, 6), (5, 6), (5, 8), (3, 8)]]],
    "Lid": [[[(8, 3), (10, 3), (10, 5), (8, 5), (8, 3)]]],
}


def _inside(px, py):
    """Names of shapes strictly around the point, by winding over all edges."""
    found = []
    for name, parts in SHAPES.items():
        cuts, touched = 0, False
        for ring in (r for part in parts for r in part):
            closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
            for (x1, y1), (x2, y2) in zip(closed, closed[1:]):
                cross = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
                if cross == 0 and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
                    touched = True
                if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                    cuts += 1
        if cuts % 2 and not touched:
            found.append(name)
    return min(found, default=None)


@pytest.mark.parametrize("options", [{}, {"max_rows": 0}])
def test_point_in_polygon_equals_brute_force(spark, options):
    """A half-unit lattice puts many points on edges and corners."""
    points = [(i, x / 2, y / 2) for i, (x, y) in enumerate((x, y) for x in range(-1, 22) for y in range(-1, 18))]
    rng = random.Random(3)
    points += [(1000 + i, rng.uniform(-1, 11), rng.uniform(-1, 9)) for i in range(300)]
    provinces = spark.createDataFrame(
        [(n, [[[list(map(float, p)) for p in ring] for ring in part] for part in parts]) for n, parts in SHAPES.items()],
        "province_name STRING, polygons ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>",
    )
    df = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in points], "id INT, lon DOUBLE, lat DOUBLE")
    got = {r.id: r.province_name for r in point_in_polygon(df, province_edges(provinces), ["id"], band_degrees=0.3, **options).collect()}
    expected = {i: _inside(x, y) for i, x, y in points}
    assert got == {i: n for i, n in expected.items() if n}
    assert set(got.values()) == set(SHAPES)


def _square(x, y, side=2.0):
    return [[[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]]


def test_features_of_one_name_do_not_cancel(spark):
    """A feature that is there twice, two that overlap under one name, and one without a name."""
    schema = "province_name STRING, polygons ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
    twice, a, b, nameless = ("T", [_square(0.0, 0.0)]), ("O", [_square(5.0, 0.0)]), ("O", [_square(6.0, 0.0)]), (None, [_square(20.0, 0.0)])
    edges = province_edges(spark.createDataFrame([twice, twice, a, b, nameless], schema))
    spots = [(1, 1.0, 1.0), (2, 6.5, 1.0), (3, 5.5, 1.0), (4, 7.5, 1.0), (5, 4.0, 1.0), (6, 21.0, 1.0)]
    points = spark.createDataFrame(spots, "id INT, lon DOUBLE, lat DOUBLE")
    got = {r.id: r.province_name for r in point_in_polygon(points, edges, ["id"]).collect()}
    assert got == {1: "T", 2: "O", 3: "O", 4: "O", 6: None}


def test_points_meet_only_edges_of_features_around_them(spark):
    """Forty areas in one row: a point meets the edges of its own, not those of all areas at its latitude."""
    schema = "province_name STRING, polygons ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
    areas = spark.createDataFrame([(f"A{i}", [_square(3.0 * i, 0.0)]) for i in range(40)], schema)
    points = spark.createDataFrame([(i, 3.0 * i + 1, 0.515) for i in range(40)], "id INT, lon DOUBLE, lat DOUBLE")
    met = polygon_candidates(points, province_edges(areas), ["id"], "province_name", 0.05).groupBy("id").count()
    assert {r["count"] for r in met.collect()} == {2}
    assert point_in_polygon(points, province_edges(areas), ["id"]).count() == 40


# --- hotspots with repeated readings ---------------------------------------------------------


def test_hotspots_of_repeated_hours_equal_self_join(spark):
    rng = random.Random(9)
    start = datetime(2024, 1, 1)
    data = []
    for _ in range(600):
        prb = rng.choice([None, 10.0, 50.0, 75.0, 90.0])
        at = start + timedelta(hours=rng.randrange(24 * 12))
        severity = None if prb is None or prb < 70 else "CRITICAL" if prb >= 85 else "WARN"
        data.append((f"t{rng.randrange(3)}", at, prb, severity))
    scored = spark.createDataFrame(data, "tower_id STRING, event_hour TIMESTAMP_NTZ, prb_utilization DOUBLE, severity STRING")
    scored.createOrReplaceTempView("r")
    expected = spark.sql("""
        WITH d AS (SELECT max(to_date(event_hour)) AS day FROM r),
        j AS (SELECT a.tower_id, a.event_hour, a.prb_utilization AS prb, b.event_hour AS hot,
                to_date(a.event_hour) >= day - INTERVAL 7 DAYS AS wk, to_date(a.event_hour) >= day - INTERVAL 30 DAYS AS mo
            FROM r a CROSS JOIN d LEFT JOIN (SELECT * FROM r WHERE severity IS NOT NULL) b
                ON a.tower_id = b.tower_id AND a.event_hour = b.event_hour)
        SELECT tower_id,
            round(100D * count(DISTINCT CASE WHEN wk THEN hot END) / count(DISTINCT CASE WHEN wk THEN event_hour END), 9),
            round(100D * count(DISTINCT CASE WHEN mo THEN hot END) / count(DISTINCT CASE WHEN mo THEN event_hour END), 9),
            round(avg(prb), 9), mode() WITHIN GROUP (ORDER BY hour(hot)), count(DISTINCT hot)
        FROM j GROUP BY tower_id""")
    got = marts.hotspot_summary(scored, F.to_date(F.lit("2024-01-12")))
    nine = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes]
    assert rows(got.select(*nine)) == rows(expected)


# --- samples ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 99, 250, 251, 999, 1000, 1500])
def test_take_by_hash_paths_agree(spark, n):
    df = spark.range(1000)
    priority = F.when(F.col("id") < 250, 0).otherwise(1)
    digest = F.sha2(F.col("id").cast("string"), 256)
    small = rows(take_by_hash(df, n, priority, digest))
    large = rows(take_by_hash(df, n, priority, digest, top_n_rows=0))
    assert small == large and len(small) == min(n, 1000)
    assert sum(i < 250 for (i,) in small) == min(n, 250)


def test_updated_pairs_equal_a_rebuild(spark):
    """Towers added, moved, deleted, moved to a place of no other, and without coordinates, some across the date line."""
    rng = random.Random(4)

    def place():
        return rng.choice([179.99, -179.99, 10.0]) + rng.uniform(-0.03, 0.03), rng.choice([0.0, 60.0]) + rng.uniform(-0.03, 0.03)

    before = {f"t{i}": place() for i in range(240)}
    after = {t: place() if i % 6 == 0 else p for i, (t, p) in enumerate(before.items()) if i % 7}
    after |= {f"n{i}": place() for i in range(30)} | {"t1": (None, None), "t2": (100.0, 0.0), "t3": None or before["t4"]}

    def frame(towers):
        return spark.createDataFrame([(t, lat, lon) for t, (lon, lat) in towers.items()], "tower_id string, lat double, lon double")

    old, new = frame(before), frame(after)
    for max_rows, task_rows in ((10**6, 20_000), (5, 3)):
        got = updated_pairs(neighbour_pairs(old), old, new, max_rows=max_rows, task_rows=task_rows)
        want = rows(neighbour_pairs(new))
        assert rows(got) == want and len(want) > 200
    assert rows(updated_pairs(neighbour_pairs(old), old, old)) == rows(neighbour_pairs(old))
    assert updated_pairs(neighbour_pairs(old), old, old.limit(0)).isEmpty()
    assert rows(updated_pairs(neighbour_pairs(old).limit(0), old.limit(0), new)) == rows(neighbour_pairs(new))


@pytest.mark.parametrize("levels, options", [(0, {}), (4, {}), (4, {"max_rows": 0})])
def test_cover_equals_brute_force(spark, tmp_path, levels, options):
    points = [(i, x / 2, y / 2) for i, (x, y) in enumerate((x, y) for x in range(-1, 22) for y in range(-1, 18))]
    rng = random.Random(4)
    points += [(1000 + i, rng.uniform(-1, 11), rng.uniform(-1, 9)) for i in range(300)]
    # The same shapes on the other side of both axes, where cells have negative numbers.
    for shift in (0.0, -13.0):
        moved = [(n, [[[[x + shift, y + shift] for x, y in ring] for ring in part] for part in parts]) for n, parts in SHAPES.items()]
        edges = province_edges(spark.createDataFrame(moved, "province_name STRING, polygons ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"))
        path = str(tmp_path / f"cover{shift}")
        polygon_cover(edges, band_degrees=0.3, levels=levels).write.parquet(path)
        df = spark.createDataFrame([(i, x + shift, y + shift) for i, x, y in points], "id INT, lon DOUBLE, lat DOUBLE")
        found = point_in_cover(df, spark.read.parquet(path), edges, ["id"], band_degrees=0.3, levels=levels, **options)
        exact = point_in_polygon(df, edges, ["id"], band_degrees=0.3)
        assert found.exceptAll(exact).count() == exact.exceptAll(found).count() == 0
        if not shift:
            assert {r.id: r.province_name for r in found.collect()} == {i: n for i, x, y in points if (n := _inside(x, y))}


def test_points_deep_inside_meet_no_edge(spark, tmp_path):
    """Of random points in two areas (one with a hole), those in border cells alone meet edges; a null name and repeated features work."""
    rng = random.Random(6)
    frame = [_square(0.0, 0.0, 6.0)[0], _square(2.0, 2.0, 1.0)[0]]
    schema = "province_name STRING, polygons ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
    edges = province_edges(spark.createDataFrame([("F", [frame]), ("F", [frame]), (None, [_square(8.0, 0.0)]), ("S", [_square(8.5, 0.5)])], schema))
    df = spark.createDataFrame([(i, rng.uniform(-1, 11), rng.uniform(-1, 7)) for i in range(2000)] + [(2000, None, 1.0)], "id INT, lon DOUBLE, lat DOUBLE")
    path = str(tmp_path / "cover")
    polygon_cover(edges).write.parquet(path)
    cover = spark.read.parquet(path)
    exact = {tuple(r) for r in point_in_polygon(df, edges, ["id"]).collect()}
    assert {tuple(r) for r in point_in_cover(df, cover, edges, ["id"]).collect()} == exact
    near = covered_points(df, cover, ["id"]).where("NOT inside").count()
    assert near * 10 < polygon_candidates(df, edges, ["id"], "province_name", 0.05).select("id", "_feature").distinct().count()
    # One cell of a feature at most holds a point, and a cover stays as long as the borders are.
    assert covered_points(df, cover, ["id"]).groupBy("id", "_feature").count().where("count > 1").count() == 0
    assert polygon_cover(edges.limit(0)).count() == 0
