import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cellgauge.plans import reference_data as rd
from cellgauge.plans.quality import tower_master_problems
from cellgauge.schemas import CELL_SCHEMA, ISLAND_GROUPS, TOWER_SCHEMA, island_groups
from cellgauge.sources import cells as src

from conftest import by_key, rows, tower

LINES = [
    "LTE,510,1,100,1,0,106.8456,-6.2088,500,5,1,1600000000,1700000000,-85",
    "LTE,510,8,100,2,0,107.0,-6.5,3000,3,1,1600000000,1690000000,-90",
    "GSM,404,1,1,1,0,77.0,28.0,1000,10,1,1600000000,1700000000,-80",
]


@pytest.fixture()
def cells(spark):
    return spark.createDataFrame(
        [tuple(_typed(v) for v in line.split(",")) for line in LINES], CELL_SCHEMA
    )


def _typed(v):
    for kind in (int, float):
        try:
            return kind(v)
        except ValueError:
            pass
    return v


@pytest.mark.parametrize("name", ["cells.csv", "cells.csv.gz"])
def test_read_cells(spark, tmp_path, cells, name):
    header = "radio,mcc,net,area,cell,unit,lon,lat,range,samples,changeable,created,updated,averageSignal"
    text = "\n".join([header, *LINES, "LTE,510,x,,,,,,,,,,,", "LTE,510,1"]) + "\n"
    path = tmp_path / name
    path.write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
    got = src.read_cells(spark, str(path), partitions=2)
    assert got.columns == CELL_SCHEMA.names
    assert rows(rd.select_cells(got)) == rows(rd.select_cells(cells))


def test_select_newest_first(cells):
    got = rd.select_cells(cells).orderBy(F.desc("updated"))
    assert [r.cell for r in got.collect()] == [1, 2]
    assert rd.select_cells(cells, mcc=404).count() == 1
    assert rd.select_cells(cells, min_samples=4).count() == 1


def test_newest_cell_wins(spark, cells):
    older = cells.withColumns({"updated": F.col("updated") - 1, "samples": F.lit(99)})
    undated = cells.withColumns({"updated": F.lit(None).cast("bigint"), "samples": F.lit(77)})
    got = rd.newest_cells(undated.unionByName(older).unionByName(cells))
    assert rows(got) == rows(cells)


def test_sample_sizes(cells):
    chosen = rd.select_cells(cells)
    assert rd.sample_cells(chosen, 0).count() == 2
    assert rd.sample_cells(chosen, 1).count() == 1
    assert rd.sample_cells(chosen, 99).count() == 2


def _made_cells(spark, groups):
    """groups: (radio, net, how many)"""
    made, number = [], 0
    for radio, net, n in groups:
        for _ in range(n):
            number += 1
            made.append((radio, 510, net, 1, number, 0, 106.0, -6.0, 500, 5, 1, 1, 1, -85))
    return spark.createDataFrame(made, CELL_SCHEMA)


def test_sample_favours_operators_when_there_are_enough(spark):
    cells = _made_cells(spark, [("LTE", 1, 10), ("LTE", 99, 50), ("NR", 1, 50)])
    got = rd.sample_cells(cells, 10)
    assert set(rows(got, "radio", "net")) == {("LTE", 1)}
    # A third of 33 is 11 > 10, so the whole radio counts; NR only fills up.
    assert {r for r, in rows(rd.sample_cells(cells, 33), "radio")} == {"LTE"}
    topped = rd.sample_cells(cells, 80)
    assert by_key(topped.groupBy("radio").count(), "radio", "count") == {"LTE": 60, "NR": 20}


def test_sample_without_favoured_radio(spark):
    assert rd.sample_cells(_made_cells(spark, [("NR", 5, 20)]), 7).count() == 7


def test_sample_is_set_by_the_seed(spark):
    cells = _made_cells(spark, [("LTE", 1, 200)])
    a, b = rows(rd.sample_cells(cells, 20, seed=1)), rows(rd.sample_cells(cells.repartition(5), 20, seed=1))
    assert a == b
    assert rows(rd.sample_cells(cells, 20, seed=2)) != a
    # Zero is a seed like any other; only None means the default.
    assert rows(rd.sample_cells(cells, 20, seed=0)) != rows(rd.sample_cells(cells, 20))


def test_sample_drops_repeats_first(spark):
    cells = _made_cells(spark, [("LTE", 1, 5)])
    assert rd.sample_cells(cells.unionByName(cells), 10).count() == 5


def _square(x, y, size=1.0):
    x, y = float(x), float(y)
    return [[[x, y], [x + size, y], [x + size, y + size], [x, y + size], [x, y]]]


@pytest.mark.parametrize("names", [("nama", "other"), ("NAME_1", "zzz"), ("Propinsi", "zzz"), ("anything", None)])
def test_geojson_name_discovery(spark, tmp_path, names):
    feature = lambda label, geometry: {
        "type": "Feature",
        "properties": {names[0]: label, **({names[1]: "wrong"} if names[1] else {})},
        "geometry": geometry,
    }
    document = {
        "type": "FeatureCollection",
        "features": [
            feature("Bali", {"type": "Polygon", "coordinates": _square(0, 0)}),
            feature("Banten", {"type": "MultiPolygon", "coordinates": [_square(5, 5), _square(7, 7, 2.0)]}),
        ],
    }
    path = tmp_path / "p.geojson"
    path.write_text(json.dumps(document, indent=1))
    provinces = src.read_provinces(spark, str(path))
    got = by_key(src.province_bounds(provinces), "province_name", "min_lon", "max_lon", "min_lat", "max_lat", "center_lon")
    assert got == {"Bali": (0.0, 1.0, 0.0, 1.0, 0.5), "Banten": (5.0, 9.0, 5.0, 9.0, 7.0)}
    assert src.province_edges(provinces).count() == 12


def test_province_names_given_by_property(spark, tmp_path):
    path = tmp_path / "p.geojson"
    feature = {"type": "Feature", "properties": {"name": "a", "code": "b"}, "geometry": {"type": "Polygon", "coordinates": _square(0, 0)}}
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    assert rows(src.read_provinces(spark, str(path), "code"), "province_name") == [("b",)]


def test_tower_master(spark, cells):
    provinces = spark.createDataFrame(
        [("DKI Jakarta", [_square(106.5, -6.5, 0.4)]), ("Nowhere", [_square(0, 0)])],
        "province_name STRING, polygons ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>",
    )
    chosen = rd.select_cells(cells)
    tagged = rd.tag_provinces(chosen, src.province_edges(provinces))
    master = rd.build_tower_master(tagged, datetime(2025, 1, 1))
    assert master.columns == TOWER_SCHEMA.names
    got = by_key(master, "tower_id", "cell_type", "province_name", "island_group", "last_updated", "mnc", "range_m")
    assert got["09c648b786f4"] == ("urban", "DKI Jakarta", "Jawa", datetime(2023, 11, 14, 22, 13, 20), 1, 500)
    assert sorted(v[:3] for k, v in got.items() if k != "09c648b786f4") == [("suburban", None, None)]
    assert tower_master_problems(master, 2).count() == 0


def test_islands(spark):
    assert len(ISLAND_GROUPS) == 38
    got = by_key(island_groups(spark), "province_name", "island_group")
    assert got == ISLAND_GROUPS and "Atlantis" not in got


def _towers(spark, *items):
    return spark.createDataFrame(list(items), TOWER_SCHEMA)


def test_tower_upsert(spark):
    old = _towers(spark, tower("a", 1.0, 1.0, "urban", "P1", "I1"), tower("b", 2.0, 2.0, "urban", "P1", "I1"))
    batch = _towers(spark, tower("b", 9.0, 9.0, "rural", "P2", None), tower("c", 3.0, 3.0, "rural", "P3", "I3"), tower("c", 4.0, 4.0, "urban", "P4", "I4"))
    order = [F.col("lat")]
    fields = ("lat", "cell_type", "province_name", "island_group")
    kept = by_key(rd.upsert_towers(old, batch, order, truncate=False), "tower_id", *fields)
    assert kept == {"a": (1.0, "urban", "P1", "I1"), "b": (2.0, "rural", "P2", None), "c": (3.0, "urban", "P4", "I4")}
    fresh = by_key(rd.upsert_towers(old, batch, order), "tower_id", *fields)
    assert fresh == {"b": (9.0, "rural", "P2", None), "c": (3.0, "urban", "P4", "I4")}


def test_province_upsert(spark):
    now = datetime(2025, 1, 1)
    old = spark.createDataFrame(
        [(1, "P1", "I1", None), (2, "P2", "I2", None)],
        "province_id BIGINT, province_name STRING, island_group STRING, added_at TIMESTAMP_NTZ",
    )
    batch = _towers(spark, tower("a", 1.0, 1.0, province="P1", island="New"), tower("b", 1.0, 1.0, province="P3", island=None), tower("c", 1.0, 1.0, province=None, island="X"))
    first = rd.upsert_provinces(old, batch, now)
    got = by_key(first, "province_name", "island_group", "added_at")
    assert got == {"P1": ("New", None), "P2": ("I2", None), "P3": (None, now)}
    assert by_key(first, "province_name", "province_id")["P1"] == 1
    stored = spark.createDataFrame(first.collect(), first.schema)
    assert rows(rd.upsert_provinces(stored, batch, datetime(2026, 1, 1))) == rows(first)
