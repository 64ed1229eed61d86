"""Open cell-site data to the tower and province masters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.functions.columns import cell_type, from_epoch_seconds, ntz, tower_key
from cellgauge.operators.dedupe import keep_first
from cellgauge.operators.sampling import TOP_N_ROWS, take_by_hash
from cellgauge.operators.spatial import point_in_cover, point_in_polygon
from cellgauge.schemas import PROVINCE_SCHEMA, SAMPLE_MNCS, SAMPLE_RADIOS, TOWER_SCHEMA, island_groups

CELL_KEY = ["radio", "mcc", "net", "area", "cell"]
DEFAULT_SEED = 42


def select_cells(cells: DataFrame, mcc: int = 510, min_samples: int = 2) -> DataFrame:
    """Located cells of one country with enough samples. A header line read as data has no number in
    these columns and falls out here."""
    return cells.where(
        (F.col("mcc") == mcc)
        & (F.col("samples") >= min_samples)
        & F.col("lat").isNotNull()
        & F.col("lon").isNotNull()
    ).withColumn("updated", F.col("updated").try_cast("bigint"))


def newest_cells(cells: DataFrame) -> DataFrame:
    """One row per cell, the one updated last; ties by the remaining columns, so the choice is fixed."""
    rest = [c for c in cells.columns if c not in (*CELL_KEY, "updated")]
    return keep_first(cells, CELL_KEY, [F.desc_nulls_last("updated"), *(F.asc_nulls_first(c) for c in rest)])


def sample_cells(
    cells: DataFrame,
    n: int,
    seed: int | None = None,
    radios: Sequence[str] = SAMPLE_RADIOS,
    mncs: Sequence[int] = SAMPLE_MNCS,
    top_n_rows: int = TOP_N_ROWS,
) -> DataFrame:
    """n distinct cells, the same for the same seed; n <= 0 gives all.

    Favoured radios come first. Within a favoured radio only the favoured operators count, when they
    have at least a third of n rows of the input, repeats included; otherwise the whole radio does. The
    remaining cells fill up."""
    unique = newest_cells(cells)
    if n <= 0:
        return unique
    seed = DEFAULT_SEED if seed is None else seed
    mnc_hit = F.col("net").isin(*mncs)
    # At most one row per favoured radio.
    supply = (
        cells.where(F.col("radio").isin(*radios))
        .groupBy("radio")
        .agg((F.count_if(mnc_hit) >= n // 3).alias("_mnc_only"))
    )
    marked = unique.join(F.broadcast(supply), "radio", "left")
    favoured = F.col("_mnc_only").isNotNull() & (~F.col("_mnc_only") | mnc_hit)
    digest = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in CELL_KEY), F.lit(str(seed))), 256)
    picked = take_by_hash(marked, n, F.when(favoured, 0).otherwise(1), digest, top_n_rows)
    return picked.select(*cells.columns)


def tag_provinces(
    cells: DataFrame, edges: DataFrame, key: Sequence[str] = tuple(CELL_KEY), cover: DataFrame | None = None, **options
) -> DataFrame:
    """Cells with the province they lie in and its island group; both NULL outside every province. With the ``cover`` of the
    edges only cells near a border meet them."""
    key = list(key)
    inside = point_in_polygon(cells, edges, key, **options) if cover is None else point_in_cover(cells, cover, edges, key, **options)
    islands = island_groups(cells.sparkSession)
    return cells.join(inside, key, "left").join(islands, "province_name", "left")


def build_tower_master(cells: DataFrame, seeded_at: datetime | None = None) -> DataFrame:
    """Selected, tagged cells in the columns of the tower master."""
    return cells.select(
        tower_key(*CELL_KEY).alias("tower_id"),
        "radio",
        F.col("mcc").cast("int").alias("mcc"),
        F.col("net").cast("int").alias("mnc"),
        F.col("area").cast("int").alias("area"),
        F.col("cell").cast("bigint").alias("cell"),
        F.col("lon").cast("double").alias("lon"),
        F.col("lat").cast("double").alias("lat"),
        F.col("range").cast("int").alias("range_m"),
        F.col("samples").cast("int").alias("samples"),
        F.col("changeable").cast("int").alias("changeable"),
        cell_type("range").alias("cell_type"),
        "province_name",
        "island_group",
        from_epoch_seconds("updated").alias("last_updated"),
        ntz(seeded_at).alias("seeded_at"),
    )


def upsert_towers(
    current: DataFrame, batch: DataFrame, order: Sequence[Column], truncate: bool = True
) -> DataFrame:
    """Tower master after a batch. A tower that is already there, or comes twice in the batch, takes
    province, island group and cell type from its last row and keeps the rest of its first.

    ``order`` makes first and last explicit. ``truncate`` starts from an empty master."""
    changing = ["province_name", "island_group", "cell_type"]
    fixed = [c for c in TOWER_SCHEMA.names if c not in ("tower_id", *changing)]
    position = F.struct(*order)
    folded = batch.groupBy("tower_id").agg(
        F.min_by(F.struct(*fixed), position).alias("_first"), F.max_by(F.struct(*changing), position).alias("_last")
    )
    if truncate:
        return folded.select("tower_id", "_first.*", "_last.*").select(*TOWER_SCHEMA.names)
    old = current.select("tower_id", F.struct(*fixed).alias("_old"), F.struct(*changing).alias("_kept"))
    merged = old.join(folded, "tower_id", "full_outer")
    return merged.select(
        "tower_id", F.coalesce("_old", "_first").alias("_fixed"), F.coalesce("_last", "_kept").alias("_changing")
    ).select("tower_id", "_fixed.*", "_changing.*").select(*TOWER_SCHEMA.names)


def upsert_provinces(current: DataFrame, towers: DataFrame, added_at: datetime | None = None) -> DataFrame:
    """Province master after a tower batch: new names are added, known ones take the batch's island
    group. Ids of new rows come from the name, so no row has to wait for the others."""
    batch = (
        towers.where(F.col("province_name").isNotNull())
        .groupBy("province_name")
        .agg(F.max("island_group").alias("_island"), F.lit(True).alias("_seen"))
    )
    merged = current.join(batch, "province_name", "full_outer")
    fresh_id = F.conv(F.substring(F.sha2("province_name", 256), 1, 15), 16, 10).cast("bigint")
    fresh = F.col("province_id").isNull()
    return merged.select(
        F.coalesce("province_id", fresh_id).alias("province_id"),
        "province_name",
        F.when(F.col("_seen").isNull(), F.col("island_group")).otherwise(F.col("_island")).alias("island_group"),
        F.when(fresh, ntz(added_at)).otherwise(F.col("added_at")).alias("added_at"),
    ).select(*PROVINCE_SCHEMA.names)
