"""Name -> query. Floats are rounded to 6 places here, not in the library, and through a decimal, so that
two engines that add in a different order still compare equal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cellgauge.catalog import binding as b
from cellgauge.functions import columns as c
from cellgauge.network import Network
from cellgauge.plans import alerts as al
from cellgauge.plans import marts, quality, reference_data, scoring, serving, staging
from cellgauge.schemas import (
    CELL_TYPES,
    SERVICE_TYPES,
    SEVERITIES,
    TELEMETRY_SCHEMA,
    THRESHOLD_SCHEMA,
    default_thresholds,
)
from cellgauge.sources import cells as cell_source
from cellgauge.sources import lake

AS_OF = datetime(2024, 2, 1, 12, 0, 0)
# Levels the bound data reaches; the defaults of the rules leave some branches without a row.
ONE_TOWER = "1"
LOW_WARN, LOW_CRITICAL, LOW_RATE, LOW_DAYS = 20.0, 40.0, 50.0, 2

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def network(spark: SparkSession, sf_dir: str) -> Network:
    """Bound anew for each query, so sizes are those of the data as it is now."""
    return b.bind_network(spark, sf_dir)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *(
            F.round(F.col(f.name).cast("decimal(28,9)"), 6).cast("double").alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
            for f in df.schema.fields
        )
    )


def register(name: str, fn: Query) -> None:
    REGISTRY[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))


def query(fn: Query) -> Query:
    register(fn.__name__, fn)
    return fn



# --- sources and sinks -----------------------------------------------------------------------


@query
def cell_csv_roundtrip(spark, sf):
    path = lake.scratch_path(spark, "cells")
    b.bind_cells(spark, sf).write.option("compression", "gzip").csv(path)
    return cell_source.read_cells(spark, path)


@query
def telemetry_lake_roundtrip(spark, sf):
    """Write all dates, write the second half of them again, read back."""
    n, path = network(spark, sf), lake.scratch_path(spark, "telemetry")
    lake.write_dates(n.telemetry, path)
    middle = F.lit(datetime(2024, 1, 15).date())
    lake.write_dates(n.telemetry.where(F.col("partition_date") >= middle), path)
    return lake.read_dates(spark, path, TELEMETRY_SCHEMA)


@query
def province_geojson_bounds(spark, sf):
    """Provinces written as GeoJSON, one collection per line, read back, bounding boxes."""
    path = lake.scratch_path(spark, "provinces")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("province_name").alias("nama")).alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"), F.col("polygons").alias("coordinates")).alias("geometry"),
    )
    collection = F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))
    b.bind_provinces(spark, sf).select(F.to_json(collection).alias("value")).write.text(path)
    return cell_source.province_bounds(cell_source.read_provinces(spark, path, one_document=False))


@query
def province_geojson_document(spark, sf):
    """Provinces written as one GeoJSON document with a feature to a line, by many tasks, and read back by many."""
    path = lake.scratch_path(spark, "provinces")
    cell_source.write_feature_lines(b.bind_provinces(spark, sf), path, "NAME_1")
    return cell_source.province_bounds(cell_source.read_feature_lines(spark, path))


@query
def cell_rejects(spark, sf):
    """Lines of a cell file that are not cells."""
    path = lake.scratch_path(spark, "cell-lines")
    order = F.col("o_orderkey")
    broken = b.table(spark, sf, "orders").where(order % 17 == 0).select(F.concat(F.lit("bad,"), order).alias("value"))
    cells = b.bind_cells(spark, sf)
    cells.select(F.to_csv(F.struct(*cells.columns)).alias("value")).unionByName(broken).write.text(path)
    return cell_source.rejected_cells(spark, path)


@query
def tower_metadata_from_csv(spark, sf):
    """Towers with thresholds that came as a CSV file."""
    path = lake.scratch_path(spark, "thresholds")
    default_thresholds(spark).select(*THRESHOLD_SCHEMA.names).coalesce(1).write.option("header", True).csv(path)
    return serving.tower_metadata(network(spark, sf).towers, cell_source.read_thresholds(spark, path))


@query
def lake_row_counts(spark, sf):
    """Rows of the table as written, of each date, by footers."""
    path = lake.scratch_path(spark, "telemetry")
    lake.write_dates(network(spark, sf).telemetry, path)
    return lake.row_counts(spark, path, TELEMETRY_SCHEMA)


@query
def dated_tree_import(spark, sf):
    """Telemetry laid out as raw/telemetry/YYYY/MM/DD, one half of January laid out again, and read back with dates from the paths."""
    n, root = network(spark, sf), lake.scratch_path(spark, "tree")
    lake.write_dated_tree(n.telemetry, root, "raw", "telemetry")
    lake.write_dated_tree(n.telemetry.where(F.col("partition_date") >= date(2024, 1, 15)), root, "raw", "telemetry")
    return lake.read_dated_tree(spark, root, "raw", "telemetry", None, TELEMETRY_SCHEMA).select(*TELEMETRY_SCHEMA.names)


@query
def partition_volume(spark, sf):
    return serving.partition_volume(network(spark, sf).telemetry)


@query
def staged_telemetry_view(spark, sf):
    return network(spark, sf).telemetry.select(*TELEMETRY_SCHEMA.names)


@query
def staged_sessions_view(spark, sf):
    return network(spark, sf).sessions


# --- staging ---------------------------------------------------------------------------------


@query
def telemetry_clean(spark, sf):
    n = network(spark, sf)
    raw = b.dirty_telemetry(spark, sf).drop("event_id")
    return staging.clean_telemetry(raw, n.towers, towers_fit=n.towers_fit)


@query
def telemetry_clean_unique_hours(spark, sf):
    n = network(spark, sf)
    raw = b.dirty_telemetry(spark, sf).drop("event_id")
    cleaned = staging.clean_telemetry(raw, n.towers, dedupe=True, towers_fit=n.towers_fit)
    return quality.duplicates(cleaned, ["tower_id", "event_hour"]).unionByName(
        cleaned.select("tower_id", "event_hour", F.lit(1).cast("bigint").alias("copies"))
    )


@query
def telemetry_clean_fixed_date(spark, sf):
    n = network(spark, sf)
    raw = b.dirty_telemetry(spark, sf).drop("event_id")
    return staging.clean_telemetry(raw, n.towers, partition_date=date(2024, 1, 15), towers_fit=n.towers_fit)


@query
def telemetry_rejects(spark, sf):
    return staging.rejected_telemetry(b.dirty_telemetry(spark, sf)).select("event_id", "event_hour")


@query
def sessions_clean(spark, sf):
    n = network(spark, sf)
    return staging.clean_sessions(
        b.dirty_sessions(spark, sf), n.towers, b.bind_subscribers(spark, sf), towers_fit=n.towers_fit
    )


@query
def sessions_rejected(spark, sf):
    bad = staging.rejected_sessions(b.dirty_sessions(spark, sf))
    return bad.select("subscriber_id", "tower_id", "session_start", "service_type")


# --- scored telemetry and scalar rules -------------------------------------------------------


@query
def scored_telemetry(spark, sf):
    return network(spark, sf).scored.select(
        "tower_id", "event_hour", "threshold_warn", "threshold_critical", "severity", "health_score"
    )


@query
def reading_features(spark, sf):
    """Row-wise rules: date parts, local hour, expected load, band, marker size."""
    rows = network(spark, sf).scored
    return rows.select(
        "tower_id",
        "event_hour",
        F.to_date("event_hour").alias("event_date"),
        F.hour("event_hour").alias("hour_of_day"),
        c.day_of_week("event_hour").alias("day_of_week"),
        c.local_hour("event_hour").alias("local_hour"),
        c.load_factor("event_hour").alias("load_factor"),
        c.health_band("health_score").alias("health_band"),
        c.marker_size("connected_subscribers").alias("marker_size"),
        c.percent_text("prb_utilization").alias("prb_text"),
    )


@query
def health_null_handling(spark, sf):
    """Default and strict score where a fifth of the readings lack latency."""
    n = network(spark, sf)
    holes = n.telemetry.withColumn(
        "latency_ms", F.when(F.col("handover_count") % 5 != 0, F.col("latency_ms"))
    )
    default = scoring.score(holes, n.profile, n.towers_fit)
    strict = c.health_score("prb_utilization", "threshold_warn", "latency_ms", "dropped_call_rate", True)
    return default.select("tower_id", "event_hour", "health_score", strict.alias("strict_score"))


@query
def capacity_shares(spark, sf):
    return scoring.capacity_shares(network(spark, sf).towers)


@query
def as_of_dates(spark, sf):
    t = network(spark, sf).telemetry
    return t.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        marts.last_valid_day(t).alias("last_valid_day"),
        marts.last_partition(t).alias("last_partition"),
    )


# --- reference data --------------------------------------------------------------------------


@query
def selected_cells(spark, sf):
    return reference_data.select_cells(b.bind_cells(spark, sf))


@query
def newest_cells(spark, sf):
    return reference_data.newest_cells(reference_data.select_cells(b.bind_cells(spark, sf)))


@query
def province_tags(spark, sf):
    cells = reference_data.newest_cells(reference_data.select_cells(b.bind_cells(spark, sf)))
    edges = cell_source.province_edges(b.bind_provinces(spark, sf))
    tagged = reference_data.tag_provinces(cells, edges)
    return tagged.select(*reference_data.CELL_KEY, "province_name", "island_group")


@query
def province_tags_by_cover(spark, sf):
    from cellgauge.operators import spatial

    cells = reference_data.newest_cells(reference_data.select_cells(b.bind_cells(spark, sf)))
    edges = cell_source.province_edges(b.bind_provinces(spark, sf))
    path = lake.scratch_path(spark, "cover")
    spatial.polygon_cover(edges).write.parquet(path)
    tagged = reference_data.tag_provinces(cells, edges, cover=spark.read.parquet(path))
    return tagged.select(*reference_data.CELL_KEY, "province_name", "island_group")


@query
def tower_master_build(spark, sf):
    cells = reference_data.newest_cells(reference_data.select_cells(b.bind_cells(spark, sf)))
    edges = cell_source.province_edges(b.bind_provinces(spark, sf))
    return reference_data.build_tower_master(reference_data.tag_provinces(cells, edges)).drop("seeded_at")


def _sample(spark, sf, n, **options):
    cells = reference_data.select_cells(b.bind_cells(spark, sf))
    return reference_data.sample_cells(cells, n, **options).select(*reference_data.CELL_KEY)


@query
def cell_sample(spark, sf):
    return _sample(spark, sf, 300, seed=7)


@query
def cell_sample_default_seed(spark, sf):
    return _sample(spark, sf, 300)


@query
def cell_sample_zero_seed(spark, sf):
    return _sample(spark, sf, 300, seed=0)


@query
def cell_sample_top_up(spark, sf):
    """More rows than the favoured radios hold, so the others fill up. Taken by the path for large n."""
    cells = reference_data.newest_cells(reference_data.select_cells(b.bind_cells(spark, sf)))
    favoured = cells.where(F.col("radio").isin("LTE", "UMTS", "GSM")).count()
    return _sample(spark, sf, favoured + 50, seed=7, top_n_rows=100)


@query
def cell_sample_all(spark, sf):
    return _sample(spark, sf, 0)


@query
def tower_upsert(spark, sf):
    """The master, then a batch that names every tower twice and brings as many new ones."""
    towers = b.bind_towers(spark, sf)
    first = towers.withColumns({"province_name": F.lit("First"), "radio": F.lit("NR"), "samples": F.lit(1)})
    last = towers.withColumns({"province_name": F.lit("Last"), "radio": F.lit("5G"), "samples": F.lit(2)})
    new = first.withColumn("tower_id", F.concat(F.lit("new-"), "tower_id"))
    batch = first.unionByName(last).unionByName(new)
    out = reference_data.upsert_towers(towers, batch, [F.col("samples")], truncate=False)
    return out.drop("last_updated", "seeded_at")


@query
def tower_upsert_truncated(spark, sf):
    """A master emptied before the batch, which names every other tower."""
    towers = b.bind_towers(spark, sf)
    batch = towers.where(F.col("cell") % 2 == 0).withColumn("province_name", F.lit("Only"))
    return reference_data.upsert_towers(towers, batch, [F.col("samples")]).drop("last_updated", "seeded_at")


@query
def province_upsert(spark, sf):
    """A master that holds half of the provinces with an old island group and one that is gone."""
    towers = b.bind_towers(spark, sf)
    nation = b.table(spark, sf, "nation")
    current = nation.select(
        F.col("n_nationkey").cast("bigint").alias("province_id"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))
        .otherwise(F.concat(F.lit("Former "), "n_name"))
        .alias("province_name"),
        F.lit("Old").alias("island_group"),
        F.lit(None).cast("timestamp_ntz").alias("added_at"),
    )
    return reference_data.upsert_provinces(current, towers, AS_OF)


# --- joins rewritten -------------------------------------------------------------------------


@query
def neighbour_pairs(spark, sf):
    return network(spark, sf).neighbour_pairs


@query
def neighbour_pairs_updated(spark, sf):
    """Pairs of a network in which every fifth tower was missing, every seventh stood elsewhere and some were to go, brought up to date."""
    from cellgauge.operators import spatial

    after, k = b.bind_towers(spark, sf), F.col("cell")
    moved = after.withColumn("lat", F.when(k % 7 == 0, F.col("lat") + 0.013).otherwise(F.col("lat")))
    extra = after.where(k % 11 == 0).withColumns({"tower_id": F.concat(F.lit("old-"), "tower_id"), "lon": F.col("lon") + 0.004})
    before = moved.where(k % 5 != 0).unionByName(extra)
    path = lake.scratch_path(spark, "pairs")
    spatial.neighbour_pairs(before).write.parquet(path)
    return spatial.updated_pairs(spark.read.parquet(path), before, after)


@query
def neighbour_distances(spark, sf):
    n = network(spark, sf)
    here = n.towers.select(F.col("tower_id").alias("source_tower_id"), F.col("lat").alias("a"), F.col("lon").alias("o"))
    there = n.towers.select(
        F.col("tower_id").alias("neighbour_tower_id"), F.col("lat").alias("b"), F.col("lon").alias("p")
    )
    joined = n.neighbour_pairs.join(here, "source_tower_id").join(there, "neighbour_tower_id")
    metres = F.round(c.great_circle_m("a", "o", "b", "p"), 2).alias("metres")
    return joined.select("source_tower_id", "neighbour_tower_id", metres)


# --- marts -----------------------------------------------------------------------------------


@query
def congestion_events(spark, sf):
    return network(spark, sf).congestion_events


@query
def hotspot_summary(spark, sf):
    return network(spark, sf).hotspot_summary


@query
def hotspot_summary_repeated_hours(spark, sf):
    """Hotspots of telemetry in which busy readings occur twice."""
    n = network(spark, sf)
    twice = n.telemetry.unionByName(n.telemetry.where(F.col("connected_subscribers") > 50))
    scored = scoring.score(twice, n.profile, n.towers_fit)
    return marts.hotspot_summary(scored, marts.last_valid_day(twice))


@query
def peak_hour_patterns(spark, sf):
    return network(spark, sf).peak_hour_patterns


@query
def network_health_snapshot(spark, sf):
    return network(spark, sf).network_health_snapshot


@query
def province_summary(spark, sf):
    return network(spark, sf).province_summary


@query
def subscriber_impact(spark, sf):
    return network(spark, sf).subscriber_impact


@query
def subscriber_impact_offset_hours(spark, sf):
    """Impact of events at half past the hour."""
    n = network(spark, sf)
    later = n.congestion_events.withColumn("event_hour", F.col("event_hour") + F.expr("INTERVAL 30 MINUTES"))
    return marts.subscriber_impact(later, n.sessions, hourly=False)


@query
def neighbour_impact(spark, sf):
    return network(spark, sf).neighbour_impact


@query
def subscriber_impact_refreshed(spark, sf):
    """Marts of the first half of January as tables, then the later dates worked out and added."""
    from cellgauge.network import build_marts, refresh_dates

    n, path, root = network(spark, sf), lake.scratch_path(spark, "telemetry"), lake.scratch_path(spark, "marts")
    lake.write_dates(n.telemetry, path)
    whole = replace(n, telemetry=lake.read_dates(spark, path, TELEMETRY_SCHEMA), dates=None)
    first = replace(n, telemetry=lake.read_dates(spark, path, TELEMETRY_SCHEMA, last=date(2024, 1, 14)), dates=None)
    rows = build_marts(first, root)["subscriber_impact"].columns
    refresh_dates(whole, root, date(2024, 1, 15), whole.dates[1])
    return spark.read.parquet(f"{root}/subscriber_impact").select(*rows)


def _published(spark, sf, name):
    """A mart after three commits: all of the first half of January, for which one day came with half of its readings; that day as
    it should be; and the later dates."""
    from cellgauge.network import publish_dates, publish_marts
    from cellgauge.sources.versions import TableStore

    n, store = network(spark, sf), TableStore(spark, lake.scratch_path(spark, "store"))
    late, half = date(2024, 1, 10), date(2024, 1, 15)
    paths = [lake.scratch_path(spark, "telemetry") for _ in range(2)]
    whole = n.telemetry
    soon = (F.col("partition_date") < half) & ((F.col("partition_date") != late) | (F.col("handover_count") < 20))
    lake.write_dates(whole.where(soon), paths[0])
    lake.write_dates(whole, paths[1])
    first, full = (replace(n, telemetry=lake.read_dates(spark, p, TELEMETRY_SCHEMA), dates=None) for p in paths)
    publish_marts(first, store)
    publish_dates(full, store, late, late)
    publish_dates(full, store, half, full.dates[1])
    return store.read(name)


@query
def hotspot_summary_published(spark, sf):
    return _published(spark, sf, "hotspot_summary")


@query
def peak_hour_patterns_published(spark, sf):
    return _published(spark, sf, "peak_hour_patterns")


@query
def neighbour_impact_published(spark, sf):
    return _published(spark, sf, "neighbour_impact")


@query
def subscriber_impact_published(spark, sf):
    return _published(spark, sf, "subscriber_impact").drop("partition_date")


@query
def mart_row_counts(spark, sf):
    """All marts written as tables in dependency order, then counted."""
    from cellgauge.network import build_marts

    return serving.row_counts(build_marts(network(spark, sf), lake.scratch_path(spark, "marts")))


# --- reports ---------------------------------------------------------------------------------


def _tower_map(n: Network, window: str) -> DataFrame:
    return serving.tower_map(n.towers, n.scored, n.newest_hour, window, n.stamped)


def _province_map(n: Network, window: str) -> DataFrame:
    return serving.province_map(_tower_map(n, window))


def _hotspot_board(n: Network, window: str) -> DataFrame:
    return serving.hotspot_leaderboard(n.hotspot_summary, n.towers, window)


def _province_board(n: Network, window: str) -> DataFrame:
    return serving.province_leaderboard_view(
        serving.province_leaderboard(n.towers, n.hotspot_summary, n.network_health_snapshot, window)
    )


for _name, _report, _windows in (
    ("tower_map", _tower_map, c.WINDOWS),
    ("province_map", _province_map, c.WINDOWS),
    ("hotspot_leaderboard", _hotspot_board, ("7d", "30d")),
    ("province_leaderboard", _province_board, ("7d", "30d")),
):
    for _window in _windows:
        register(
            f"{_name}_{_window}",
            lambda spark, sf, report=_report, window=_window: report(network(spark, sf), window),
        )


@query
def province_towers(spark, sf):
    n = network(spark, sf)
    return serving.province_towers(_tower_map(n, "7d"), n.hotspot_summary)


@query
def province_towers_view(spark, sf):
    n = network(spark, sf)
    rows = serving.province_towers(_tower_map(n, "30d"), n.hotspot_summary, "NATION_3")
    return serving.province_towers_view(rows, "30d")


@query
def map_scope_by_tower(spark, sf):
    return serving.map_scope(_tower_map(network(spark, sf), "7d"), tower_id="1")


@query
def map_scope_by_province(spark, sf):
    return serving.map_scope(_tower_map(network(spark, sf), "7d"), province="NATION_3")


@query
def latest_reading(spark, sf):
    return serving.latest_reading(network(spark, sf).telemetry)


@query
def tower_metadata(spark, sf):
    return serving.tower_metadata(network(spark, sf).towers, default_thresholds(spark))


@query
def prb_series(spark, sf):
    n = network(spark, sf)
    # Bound telemetry holds known towers only, so the tower table bounds its towers.
    return serving.prb_series(n.telemetry, newest_fits=n.towers_fit)


@query
def event_history(spark, sf):
    n = network(spark, sf)
    return serving.event_history_view(serving.event_history(n.congestion_events, n.subscriber_impact))


@query
def peak_hour_profile(spark, sf):
    return serving.peak_hour_profile(network(spark, sf).peak_hour_patterns)


@query
def prb_by_weekday_hour(spark, sf):
    return serving.prb_by_weekday_hour(network(spark, sf).telemetry)


@query
def weekday_hour_grid(spark, sf):
    return serving.weekday_hour_grid(serving.prb_by_weekday_hour(network(spark, sf).telemetry))


@query
def neighbour_list(spark, sf):
    n = network(spark, sf)
    return serving.neighbour_list_view(serving.neighbour_list(n.neighbour_impact, n.towers))


@query
def impact_totals(spark, sf):
    return serving.impact_totals(network(spark, sf).subscriber_impact)


# The same reports about one tower, and about one that has no data.
for _name, _report in {
    "latest_reading": lambda n, t: serving.latest_reading(n.telemetry, t),
    "tower_metadata": lambda n, t: serving.tower_metadata(n.towers, n.thresholds, t),
    "prb_series": lambda n, t: serving.prb_series(n.telemetry, t),
    "event_history": lambda n, t: serving.event_history_view(serving.event_history(n.congestion_events, n.subscriber_impact, t)),
    "peak_hour_profile": lambda n, t: serving.peak_hour_profile(n.peak_hour_patterns, t),
    "prb_by_weekday_hour": lambda n, t: serving.prb_by_weekday_hour(n.telemetry, t),
    "neighbour_list": lambda n, t: serving.neighbour_list_view(serving.neighbour_list(n.neighbour_impact, n.towers, t)),
    "impact_totals": lambda n, t: serving.impact_totals(n.subscriber_impact, t),
}.items():
    register(f"{_name}_of_tower", lambda spark, sf, report=_report: report(network(spark, sf), ONE_TOWER))
register("impact_totals_of_no_tower", lambda spark, sf: serving.impact_totals(network(spark, sf).subscriber_impact, "none"))


@query
def province_choices(spark, sf):
    return serving.provinces(network(spark, sf).towers)


@query
def filter_options(spark, sf):
    return serving.filter_options(network(spark, sf).towers)


@query
def tower_ids(spark, sf):
    return serving.tower_ids(network(spark, sf).towers)


@query
def active_alerts(spark, sf):
    n = network(spark, sf)
    return serving.active_alerts(b.bind_alerts(n.towers), n.towers, AS_OF, "All", None, "All")


@query
def active_alerts_filtered(spark, sf):
    n = network(spark, sf)
    rows = serving.active_alerts(b.bind_alerts(n.towers), n.towers, AS_OF, "CRITICAL", None, "ASIA")
    return serving.active_alerts_view(rows)


@query
def alert_summary(spark, sf):
    n = network(spark, sf)
    return serving.alert_summary(b.bind_alerts(n.towers), n.towers, AS_OF)


@query
def home_metrics(spark, sf):
    n = network(spark, sf)
    return serving.home_metrics(n.towers, b.bind_alerts(n.towers), n.network_health_snapshot)


# --- alerts ----------------------------------------------------------------------------------


@query
def hotspot_alerts(spark, sf):
    n = network(spark, sf)
    return al.hotspot_alerts(n.hotspot_summary, b.bind_alerts(n.towers), AS_OF)


@query
def hotspot_alerts_low(spark, sf):
    n = network(spark, sf)
    return al.hotspot_alerts(n.hotspot_summary, b.bind_alerts(n.towers), AS_OF, LOW_WARN, LOW_CRITICAL)


@query
def peak_hour_alerts(spark, sf):
    n = network(spark, sf)
    return al.peak_hour_alerts(n.peak_hour_patterns, b.bind_alerts(n.towers), AS_OF)


@query
def peak_hour_alerts_low(spark, sf):
    n = network(spark, sf)
    return al.peak_hour_alerts(n.peak_hour_patterns, b.bind_alerts(n.towers), AS_OF, LOW_RATE, LOW_DAYS)


@query
def neighbour_alerts(spark, sf):
    n = network(spark, sf)
    return al.neighbour_alerts(n.neighbour_impact, b.bind_alerts(n.towers), AS_OF)


@query
def alerts_expired(spark, sf):
    n = network(spark, sf)
    return al.expire_alerts(b.bind_alerts(n.towers), n.hotspot_summary, AS_OF)


@query
def alert_cycle(spark, sf):
    n = network(spark, sf)
    return al.next_alerts(
        b.bind_alerts(n.towers),
        n.hotspot_summary,
        n.peak_hour_patterns,
        n.neighbour_impact,
        AS_OF,
        warn_at=LOW_WARN,
        critical_at=LOW_CRITICAL,
        min_rate=LOW_RATE,
        min_days=LOW_DAYS,
    )


def _alert_log(spark, sf):
    """The log after the bound alerts and one cycle, which is run twice."""
    from cellgauge.plans.alert_log import AlertLog
    from cellgauge.sources.versions import TableStore

    n = network(spark, sf)
    log = AlertLog(TableStore(spark, lake.scratch_path(spark, "alert-log")))
    marts = n.hotspot_summary, n.peak_hour_patterns, n.neighbour_impact
    levels = {"warn_at": LOW_WARN, "critical_at": LOW_CRITICAL, "min_rate": LOW_RATE, "min_days": LOW_DAYS}
    log.start(b.bind_alerts(n.towers), datetime(2024, 1, 31))
    for _ in range(2):
        log.run("cycle", AS_OF, lambda old: al.next_alerts(old, *marts, AS_OF, **levels))
    return log


@query
def alert_log_replay(spark, sf):
    return _alert_log(spark, sf).as_of(AS_OF)


@query
def alert_log_before(spark, sf):
    from cellgauge.plans.alert_log import just_before

    return _alert_log(spark, sf).as_of(just_before(AS_OF))


@query
def alert_log_changes(spark, sf):
    rows = _alert_log(spark, sf).changes(first=AS_OF.date())
    return rows.groupBy("run_id", "alert_category", "status").agg(F.count(F.lit(1)).alias("changes"))


# --- data quality ----------------------------------------------------------------------------


@query
def quality_nulls(spark, sf):
    raw = b.dirty_telemetry(spark, sf)
    return quality.nulls(raw, ["tower_id", "event_hour", "handover_count", "connected_subscribers"])


@query
def quality_duplicates(spark, sf):
    raw = b.dirty_telemetry(spark, sf).where(F.col("tower_id").isNotNull())
    return quality.duplicates(raw, ["tower_id", "event_hour"])


@query
def quality_unexpected_values(spark, sf):
    """Accepted-value check with one value taken off each list, so there is something to report."""
    n = network(spark, sf)
    checks = [
        ("severity", n.congestion_events, "severity", SEVERITIES[:1]),
        ("cell_type", n.towers, "cell_type", CELL_TYPES[:2]),
        ("service_type", n.sessions, "service_type", SERVICE_TYPES[:2]),
    ]
    out = None
    for name, df, column, accepted in checks:
        found = quality.unexpected_values(df, column, accepted).withColumn("check_name", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


@query
def quality_prb_range(spark, sf):
    """Readings whose fault flag was lost and that are shifted down by one point."""
    broken = network(spark, sf).telemetry.withColumns(
        {"prb_utilization": F.col("prb_utilization") - 1, "is_sensor_fault": F.lit(False)}
    )
    return quality.prb_out_of_range(broken)


@query
def quality_thresholds(spark, sf):
    """Events against a profile from which the rural thresholds are missing."""
    n = network(spark, sf)
    partial = scoring.tower_profile(n.towers, default_thresholds(spark).where(F.col("cell_type") != "rural"))
    return quality.events_without_threshold(n.congestion_events, partial, n.towers_fit)


@query
def quality_missing_hours(spark, sf):
    n = network(spark, sf)
    return quality.missing_tower_hours(n.telemetry, n.towers)


@query
def quality_telemetry_dates(spark, sf):
    n = network(spark, sf)
    return quality.incomplete_telemetry_dates(n.telemetry, n.towers)


@query
def quality_session_dates(spark, sf):
    return quality.incomplete_session_dates(network(spark, sf).sessions, b.bind_subscribers(spark, sf))


@query
def quality_tower_master(spark, sf):
    """The master against the supplier count plus one, so the check has something to report."""
    expected = b.table(spark, sf, "supplier").agg(F.count(F.lit(1)) + 1).scalar()
    return quality.tower_master_problems(network(spark, sf).towers, expected)


@query
def quality_orphan_towers(spark, sf):
    n = network(spark, sf)
    return quality.orphans(b.raw_sessions(spark, sf), n.towers, "tower_id", F.col("tower_id"), n.towers_fit)


@query
def quality_standard(spark, sf):
    """The standing checks over telemetry that was cleaned without removing repeated hours."""
    n = network(spark, sf)
    raw = b.dirty_telemetry(spark, sf).drop("event_id")
    repeated = staging.clean_telemetry(raw, n.towers, towers_fit=n.towers_fit)
    return quality.standard_checks(
        {
            "towers": n.towers,
            "subscribers": b.bind_subscribers(spark, sf),
            "telemetry": repeated,
            "sessions": n.sessions,
            "events": n.congestion_events,
            "hotspots": n.hotspot_summary,
            "alerts": b.bind_alerts(n.towers),
            "thresholds": n.thresholds,
        }
    )
