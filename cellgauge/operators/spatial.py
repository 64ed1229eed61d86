"""Spatial joins as equi joins on grid cells, followed by the exact test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.functions.columns import EARTH_RADIUS_M, great_circle_m
from cellgauge.operators.joins import BROADCAST_ROWS, spread_join

# A source row meets every tower of its grid cell, so hot cells are split into small pieces.
PAIR_TASK_ROWS = 20_000
# A point meets the edges of its feature and latitude band, some tens to thousands.
POINT_TASK_ROWS = 50_000
# Side of the grid cells that find bounding boxes, in latitude bands.
BOX_BANDS = 10
# Times that a cell of a cover is quartered along the border of an area, and the part of a finest cell by which edges are
# widened, so that rounding cannot part a point from an edge of its cell.
COVER_LEVELS = 4
COVER_MARGIN = 1e-6


def _row_height(radius_m: float) -> float:
    """Grid row height in degrees, 1 % over the radius so rounding cannot lose a pair."""
    return math.degrees(radius_m / EARTH_RADIUS_M) * 1.01


def _reach(abs_lat: Column, height: float) -> Column:
    """Largest longitude difference, in degrees, between points one radius apart when one of them has
    this absolute latitude. Near a pole every longitude is in reach."""
    sine = F.lit(math.sin(math.radians(height))) / F.cos(F.radians(abs_lat))
    return F.when(abs_lat + height < 89.9, F.degrees(F.asin(F.least(F.lit(1.0), sine)))).otherwise(180.0)


def _row_width(row: Column, height: float) -> Column:
    """Cell width of a grid row: the reach at its far edge, so a source spans two or three cells."""
    edge = F.greatest(F.abs(row * height), F.abs((row + 1) * height))
    return _reach(edge, height)


def neighbour_pairs(
    towers: DataFrame,
    radius_m: float = 3000.0,
    max_rows: int = BROADCAST_ROWS,
    task_rows: int = PAIR_TASK_ROWS,
    sources: DataFrame | None = None,
) -> DataFrame:
    """Ordered pairs of different towers less than radius_m apart; with ``sources`` (tower_id) those that begin with one of them.

    Each tower sits in one cell of a latitude-row grid whose cells widen towards the poles. As a
    source it looks into three rows and, in each, the cells its longitude reach covers, also across
    the date line."""
    height = _row_height(radius_m)
    places = towers.select("tower_id", "lat", F.col("lon")).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    row_of = F.floor(F.col("lat") / height)
    wrapped = F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0

    targets = (
        places.withColumn("_row", row_of)
        .withColumn("_col", F.floor(wrapped / _row_width(F.col("_row"), height)))
        .select(
            "_row",
            "_col",
            F.col("tower_id").alias("neighbour_tower_id"),
            F.col("lat").alias("_lat_b"),
            F.col("lon").alias("_lon_b"),
        )
    )

    width = _row_width(F.col("_row"), height)
    reach = _reach(F.abs("lat"), height)

    def cells(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor(lo / F.col("_width")), F.floor(hi / F.col("_width")))

    west, east = F.col("_x") - F.col("_reach"), F.col("_x") + F.col("_reach")
    inside = cells(F.greatest(west, F.lit(-180.0)), F.least(east, F.lit(180.0)))
    over_west = F.when(west < -180.0, cells(F.greatest(west + 360.0, F.lit(-180.0)), F.lit(180.0)))
    over_east = F.when(east > 180.0, cells(F.lit(-180.0), F.least(east - 360.0, F.lit(180.0))))
    none = F.array().cast("array<bigint>")
    some = places if sources is None else places.join(sources.select("tower_id").distinct(), "tower_id", "left_semi")
    looking = (
        some.repartition("tower_id")
        .withColumn("_x", wrapped)
        .withColumn("_reach", reach)
        .withColumn("_row", F.explode(F.sequence(row_of - 1, row_of + 1)))
        .withColumn("_width", width)
        .withColumn(
            "_col",
            F.explode(
                F.array_distinct(F.concat(inside, F.coalesce(over_west, none), F.coalesce(over_east, none)))
            ),
        )
        .select(
            "_row",
            "_col",
            F.col("tower_id").alias("source_tower_id"),
            F.col("lat").alias("_lat_a"),
            F.col("lon").alias("_lon_a"),
        )
    )
    # The few sources of a change go to the towers of the cells they look into; else towers are met by all sources.
    big, small, salt = (looking, targets, "source_tower_id") if sources is None else (targets, looking, "neighbour_tower_id")
    met = spread_join(big, small, ["_row", "_col"], "inner", F.col(salt), max_rows=max_rows, task_rows=task_rows)
    near = great_circle_m("_lat_a", "_lon_a", "_lat_b", "_lon_b") < radius_m
    return met.where((F.col("source_tower_id") != F.col("neighbour_tower_id")) & near).select(
        "source_tower_id", "neighbour_tower_id"
    )


def moved_towers(before: DataFrame, after: DataFrame) -> DataFrame:
    """tower_id of towers that are new, gone or in another place. A tower without coordinates has no place."""
    place = lambda df, n: df.select("tower_id", F.struct("lat", "lon").alias(n))
    both = place(before, "_old").join(place(after, "_new"), "tower_id", "full")
    same = F.col("_old").isNotNull() & F.col("_new").isNotNull() & F.col("_old").eqNullSafe(F.col("_new"))
    return both.where(~same).select("tower_id")


def updated_pairs(
    pairs: DataFrame,
    before: DataFrame,
    after: DataFrame,
    radius_m: float = 3000.0,
    max_rows: int = BROADCAST_ROWS,
    task_rows: int = PAIR_TASK_ROWS,
) -> DataFrame:
    """:func:`neighbour_pairs` of ``after``, from those of ``before``: pairs of towers that were added, moved or deleted go, and moved
    and added ones are looked up anew. Only towers of the cells these look into are compared; no other pair is worked out again.
    Tower ids are unique in both tables."""
    moved = moved_towers(before, after)
    kept = pairs
    for end in ("source_tower_id", "neighbour_tower_id"):
        gone = moved.select(F.col("tower_id").alias(end))
        kept = spread_join(kept, gone, [end], "left_anti", F.struct(*pairs.columns), max_rows=max_rows, task_rows=task_rows)
    out = neighbour_pairs(after, radius_m, max_rows, task_rows, sources=moved)
    back = out.select(F.col("neighbour_tower_id").alias("source_tower_id"), F.col("source_tower_id").alias("neighbour_tower_id"))
    # Between two moved towers both directions are found twice.
    return kept.select("source_tower_id", "neighbour_tower_id").unionByName(out.unionByName(back).distinct())


def polygon_candidates(
    points: DataFrame,
    edges: DataFrame,
    key: list[str],
    name: str,
    band_degrees: float,
    max_rows: int = BROADCAST_ROWS,
    task_rows: int = POINT_TASK_ROWS,
) -> DataFrame:
    """Each point with the edges that the exact test needs: those at its own latitude, of features whose
    bounding box holds it. Boxes are found by grid cells in both axes, edges by feature and latitude band."""
    cell = lambda v: F.floor(v / (band_degrees * BOX_BANDS))
    band = lambda y: F.floor(y / band_degrees)
    edges = _featured(edges, name)
    west, east, south, north = F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2")
    boxes = edges.groupBy("_feature", name).agg(
        F.min(west).alias("_w"), F.max(east).alias("_e"), F.min(south).alias("_s"), F.max(north).alias("_n")
    )
    boxes = boxes.withColumn("_cx", F.explode(F.sequence(cell(F.col("_w")), cell(F.col("_e"))))).withColumn(
        "_cy", F.explode(F.sequence(cell(F.col("_s")), cell(F.col("_n"))))
    )
    spots = points.select(*key, F.col("lon").alias("_px"), F.col("lat").alias("_py"))
    spots = spots.withColumns({"_cx": cell(F.col("_px")), "_cy": cell(F.col("_py"))})
    salt = F.struct(*key)
    boxed = spread_join(spots, boxes, ["_cx", "_cy"], "inner", salt, max_rows=max_rows, task_rows=task_rows)
    boxed = boxed.where(F.col("_px").between(F.col("_w"), F.col("_e")) & F.col("_py").between(F.col("_s"), F.col("_n")))
    boxed = boxed.drop("_cx", "_cy", "_w", "_e", "_s", "_n").withColumn("_band", band(F.col("_py")))
    return spread_join(boxed, _banded(edges, band_degrees), ["_feature", "_band"], "inner", salt, max_rows=max_rows, task_rows=task_rows)


def _parity(met: DataFrame, by: list[str]) -> DataFrame:
    """Values of ``by`` whose point (_px, _py) is strictly inside the feature, from its edges at the point's latitude."""
    px, py = F.col("_px"), F.col("_py")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    crosses = ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)
    touches = (
        ((x2 - x1) * (py - y1) == (px - x1) * (y2 - y1))
        & px.between(F.least(x1, x2), F.greatest(x1, x2))
        & py.between(F.least(y1, y2), F.greatest(y1, y2))
    )
    return (
        met.withColumn("_cross", F.coalesce(crosses, F.lit(False)).cast("int"))
        .withColumn("_touch", touches.cast("int"))
        .where((F.col("_cross") == 1) | (F.col("_touch") == 1))
        .groupBy(*by)
        .agg(F.sum("_cross").alias("_crossings"), F.max("_touch").alias("_touched"))
        .where((F.col("_crossings") % 2 == 1) & (F.col("_touched") == 0))
        .select(*by)
    )


def _banded(edges: DataFrame, band_degrees: float) -> DataFrame:
    """Edges, once for each latitude band they reach."""
    band = lambda y: F.floor(y / band_degrees)
    bands = F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))
    return edges.select("_feature", "x1", "y1", "x2", "y2", F.explode(bands).alias("_band"))


def _featured(edges: DataFrame, name: str) -> DataFrame:
    return edges.withColumn("_feature", F.xxhash64("feature_id" if "feature_id" in edges.columns else name))


def polygon_cover(
    edges: DataFrame,
    name: str = "province_name",
    band_degrees: float = 0.05,
    levels: int = COVER_LEVELS,
    task_rows: int = POINT_TASK_ROWS,
) -> DataFrame:
    """Quadtree cells that cover each feature: _feature, name, _level, _cx, _cy, inside.

    A cell that an edge runs through is quartered, down to ``levels``; of the finest ones those with an edge are border
    cells (inside is false). All others have no edge, so their centre tells for all their points whether they are inside;
    those outside are left out. A point is in one cell of a feature at most. The number of cells goes with the length of the
    borders and not with the area."""
    edges = _featured(edges, name)
    side = band_degrees * BOX_BANDS / 2**levels
    pad = COVER_MARGIN * side
    at = lambda v: F.floor(v / side)
    south, north = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("_cy", F.explode(F.sequence(at(south - pad), at(north + pad))))
    # The part of the edge within the row, a little more of it so that rounding loses no cell.
    slope = (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    x_at = lambda y: F.col("x1") + (F.least(F.greatest(y, south), north) - F.col("y1")) * slope
    ends = [x_at(F.col("_cy") * side - pad), x_at((F.col("_cy") + 1) * side + pad)]
    flat = slope.isNull()
    west = F.when(flat, F.least("x1", "x2")).otherwise(F.least(*ends))
    east = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(*ends))
    cell = ["_feature", name, "_cx", "_cy"]
    finest = rows.withColumn("_cx", F.explode(F.sequence(at(west - pad), at(east + pad)))).select(*cell).distinct()

    # Cells with an edge on all levels, then those they are quartered into.
    above = finest.withColumn("_level", F.explode(F.array(*map(F.lit, range(levels + 1)))))
    up = lambda c: F.call_function("shiftright", c, F.lit(levels) - F.col("_level")).alias(c)
    by = ["_feature", name, "_level", "_cx", "_cy"]
    border = above.select("_feature", name, "_level", up("_cx"), up("_cy")).distinct()
    quarter = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (0, 1) for y in (0, 1))))
    parts = border.where(F.col("_level") < levels).withColumn("_part", quarter).select(
        "_feature", name, (F.col("_level") + 1).alias("_level"), *((2 * F.col(f"_c{c}") + F.col(f"_part.{c}")).alias(f"_c{c}") for c in "xy")
    )
    # Rows of the coarsest cells, between the first and the last that has an edge: what lies beyond is outside.
    span = border.where("_level = 0").groupBy("_feature", name, "_level", "_cy").agg(F.min("_cx").alias("_a"), F.max("_cx").alias("_b"))
    coarse = span.withColumn("_cx", F.explode(F.sequence("_a", "_b"))).select(*by)
    keyed = border.select("_feature", "_level", "_cx", "_cy")
    holes = parts.unionByName(coarse).join(keyed, ["_feature", "_level", "_cx", "_cy"], "left_anti")
    width = F.lit(float(2**levels) * side) / F.pow(F.lit(2.0), F.col("_level"))
    centres = holes.withColumns({"_px": (F.col("_cx") + 0.5) * width, "_py": (F.col("_cy") + 0.5) * width})
    centres = centres.withColumn("_band", F.floor(F.col("_py") / band_degrees))
    met = spread_join(centres, _banded(edges, band_degrees), ["_feature", "_band"], "inner", F.struct(*by), task_rows=task_rows)
    inside = _parity(met, by).withColumn("inside", F.lit(True))
    return inside.unionByName(finest.withColumns({"_level": F.lit(levels), "inside": F.lit(False)}))


def covered_points(
    points: DataFrame,
    cover: DataFrame,
    key: list[str],
    band_degrees: float = 0.05,
    levels: int = COVER_LEVELS,
    max_rows: int = BROADCAST_ROWS,
    task_rows: int = POINT_TASK_ROWS,
) -> DataFrame:
    """Each point (key..., _px, _py) with the cells of the cover that hold it: _feature, name, inside. A cover that fits is sent
    to the points, so these are not shuffled."""
    side = band_degrees * BOX_BANDS / 2**levels
    spots = points.select(*key, F.col("lon").alias("_px"), F.col("lat").alias("_py"))
    spots = spots.withColumns({"_fx": F.floor(F.col("_px") / side), "_fy": F.floor(F.col("_py") / side)})
    spots = spots.withColumn("_level", F.explode(F.array(*map(F.lit, range(levels + 1)))))
    shift = F.lit(levels) - F.col("_level")
    spots = spots.withColumns({"_cx": F.call_function("shiftright", "_fx", shift), "_cy": F.call_function("shiftright", "_fy", shift)})
    met = spread_join(spots, cover, ["_level", "_cx", "_cy"], "inner", F.struct(*key), max_rows=max_rows, task_rows=task_rows)
    return met.drop("_level", "_cx", "_cy", "_fx", "_fy")


def point_in_cover(
    points: DataFrame,
    cover: DataFrame,
    edges: DataFrame,
    key: list[str],
    name: str = "province_name",
    band_degrees: float = 0.05,
    levels: int = COVER_LEVELS,
    max_rows: int = BROADCAST_ROWS,
    task_rows: int = POINT_TASK_ROWS,
) -> DataFrame:
    """:func:`point_in_polygon` by way of :func:`polygon_cover` (same ``band_degrees`` and ``levels``), which may be written once and
    used for many tables of points: only points in border cells meet edges."""
    met = covered_points(points, cover, key, band_degrees, levels, max_rows, task_rows)
    near = met.where(~F.col("inside")).drop("inside").withColumn("_band", F.floor(F.col("_py") / band_degrees))
    banded = _banded(_featured(edges, name), band_degrees)
    tested = spread_join(near, banded, ["_feature", "_band"], "inner", F.struct(*key), max_rows=max_rows, task_rows=task_rows)
    hits = met.where("inside").select(*key, name).unionByName(_parity(tested, [*key, "_feature", name]).drop("_feature"))
    return hits.groupBy(*key).agg(F.min(name).alias(name))


def point_in_polygon(
    points: DataFrame,
    edges: DataFrame,
    key: list[str],
    name: str = "province_name",
    band_degrees: float = 0.05,
    max_rows: int = BROADCAST_ROWS,
    task_rows: int = POINT_TASK_ROWS,
) -> DataFrame:
    """(key..., name) for every point strictly inside a named area; the first name when areas overlap.

    ``edges`` has (name, x1, y1, x2, y2), all rings of all parts, and ``feature_id`` if a name may stand
    for several features; without it a name is one feature. Holes work by parity within a feature, and
    features that overlap do not cancel each other. A point on an edge of a feature is not inside it."""
    met = polygon_candidates(points, edges, key, name, band_degrees, max_rows, task_rows)
    hits = _parity(met, [*key, "_feature", name])
    return hits.groupBy(*key).agg(F.min(name).alias(name))
