"""Open cell-site files: cell CSV, threshold CSV, province GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.schemas import CELL_SCHEMA, THRESHOLD_SCHEMA

# Property names that may hold a province's name, in order of preference.
NAME_PROPERTIES = ("nama", "name", "NAME_1", "PROVINSI", "province", "Provinsi", "Propinsi")


def read_cells(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Headerless cell CSV, plain or gzip. A field that is not a number reads as NULL; see
    :func:`rejected_cells` for such lines.

    One gzip file is one task whatever its size; ``partitions`` spreads its rows for what follows."""
    cells = spark.read.schema(CELL_SCHEMA).csv(path, header=False, mode="PERMISSIVE")
    return cells.repartition(partitions) if partitions else cells


def rejected_cells(spark: SparkSession, path: str) -> DataFrame:
    """(line) for the lines of a cell CSV in which a field could not be read or the number of fields is
    wrong, a header line among them."""
    odd = "_corrupt_record"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CELL_SCHEMA)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": odd}
    cell = F.from_csv("value", f"{fields}, {odd} STRING", options)
    return spark.read.text(path).select(cell.getField(odd).alias("line")).where(F.col("line").isNotNull())


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(THRESHOLD_SCHEMA).csv(path, header=True, mode="FAILFAST")


def read_provinces(
    spark: SparkSession, path: str, name_property: str | None = None, one_document: bool = True
) -> DataFrame:
    """(province_name, polygons) from GeoJSON; a Polygon becomes a list of one.

    A file is one feature collection, or has one collection per line if not ``one_document``; only the
    latter can be split between tasks. The name is the first known name property that any feature has, or else the first property."""
    found = spark.read.schema("features ARRAY<STRING>").json(path, multiLine=one_document)
    return _provinces(found.select(F.explode("features").alias("feature")), name_property)


def write_feature_lines(provinces: DataFrame, path: str, name_property: str = "nama") -> None:
    """(province_name, polygons) as one GeoJSON feature collection that is spread over files: in the order of their names they are
    one document, with a feature to a line. Each task writes its own features."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("province_name").alias(name_property)).alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"), F.col("polygons").alias("coordinates")).alias("geometry"),
    )
    spark = provinces.sparkSession
    lines = provinces.select(F.to_json(feature).alias("value"))
    lines = lines.select(F.lit(1).alias("part"), F.xxhash64("value", F.monotonically_increasing_id()).alias("at"), "value")
    ends = spark.range(1).select(
        F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit('{"type":"FeatureCollection","features":[').alias("value")), F.struct(F.lit(2).alias("part"), F.lit("]}").alias("value")))).alias("e")
    )
    # All features but one are preceded by a comma.
    order = ["part", "at"]
    ends = ends.select("e.part", F.lit(0).cast("long").alias("at"), "e.value")
    every = lines.withColumn("value", F.concat(F.lit(","), "value")).unionByName(ends)
    first = F.when(F.col("part") == 1, F.col("at")).otherwise(None)
    laid = every.withColumn("_first", every.agg(F.min(first)).scalar())
    value = F.when((F.col("part") == 1) & (F.col("at") == F.col("_first")), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    laid.repartitionByRange(*order).sortWithinPartitions(*order).select(value.alias("value")).write.text(path)


def read_feature_lines(spark: SparkSession, path: str, name_property: str | None = None) -> DataFrame:
    """(province_name, polygons) of GeoJSON with a feature to a line, as :func:`write_feature_lines` and most tools lay it out; lines
    are parsed wherever a split begins. Lines that are no feature (the collection's head and end) are passed over."""
    line = F.regexp_replace(F.trim("value"), "^,|,$", "")
    lines = spark.read.text(path).select(line.alias("feature")).where(F.get_json_object("feature", "$.geometry").isNotNull())
    return _provinces(lines, name_property)


def _provinces(lines: DataFrame, name_property: str | None) -> DataFrame:
    features = lines.select(
        F.from_json(F.get_json_object("feature", "$.properties"), "MAP<STRING, STRING>").alias("properties"),
        F.get_json_object("feature", "$.geometry.type").alias("kind"),
        F.get_json_object("feature", "$.geometry.coordinates").alias("coordinates"),
    )
    if name_property is not None:
        name = F.try_element_at("properties", F.lit(name_property))
    else:
        ranks = F.coalesce(
            *(F.when(F.map_contains_key("properties", p), i) for i, p in enumerate(NAME_PROPERTIES))
        )
        best = features.agg(F.min(ranks)).scalar()
        known = F.get(F.array(*(F.lit(p) for p in NAME_PROPERTIES)), best)
        column = F.coalesce(known, F.get(F.map_keys("properties"), F.lit(0)))
        name = F.try_element_at("properties", column)
    ring = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"
    polygons = F.when(F.col("kind") == "Polygon", F.array(F.from_json("coordinates", ring))).when(
        F.col("kind") == "MultiPolygon", F.from_json("coordinates", f"ARRAY<{ring}>")
    )
    return features.select(name.alias("province_name"), polygons.alias("polygons"))


def _vertices(provinces: DataFrame, *more: str) -> DataFrame:
    return (
        provinces.select("province_name", *more, F.posexplode("polygons").alias("part", "rings"))
        .select("province_name", *more, "part", F.posexplode("rings").alias("ring", "points"))
    )


def province_edges(provinces: DataFrame) -> DataFrame:
    """(province_name, feature_id, x1, y1, x2, y2) for the edges of every ring; an open ring is closed. A
    feature that is there twice counts once, and features that share a name stay apart."""
    single = provinces.select("province_name", "polygons").distinct()
    rings = _vertices(single.withColumn("feature_id", F.xxhash64("province_name", "polygons")), "feature_id").where(F.size("points") > 1)
    steps = rings.select(
        "province_name",
        "feature_id",
        "points",
        F.explode(F.sequence(F.lit(0), F.size("points") - 1)).alias("i"),
    )
    a = F.get("points", F.col("i"))
    b = F.get("points", F.pmod(F.col("i") + 1, F.size("points")))
    return steps.select(
        "province_name",
        "feature_id",
        F.get(a, 0).alias("x1"),
        F.get(a, 1).alias("y1"),
        F.get(b, 0).alias("x2"),
        F.get(b, 1).alias("y2"),
    ).where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def province_bounds(provinces: DataFrame) -> DataFrame:
    """Bounding box and centre of each province."""
    points = _vertices(provinces).select("province_name", F.explode("points").alias("p"))
    x, y = F.get("p", 0), F.get("p", 1)
    boxes = points.groupBy("province_name").agg(
        F.min(x).alias("min_lon"), F.max(x).alias("max_lon"), F.min(y).alias("min_lat"), F.max(y).alias("max_lat")
    )
    return boxes.withColumns(
        {
            "center_lon": (F.col("min_lon") + F.col("max_lon")) / 2,
            "center_lat": (F.col("min_lat") + F.col("max_lat")) / 2,
        }
    )
