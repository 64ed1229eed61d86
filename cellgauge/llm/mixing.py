"""Interleave sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.common import numbered, settle
from cellgauge.operators.joins import spread_join

# Rows of one source that are laid down together.
BLOCK_ROWS = 64
# Slots after which the schedule repeats; weights are multiples of its inverse.
PERIOD = 1000
# Sources that are rarer than a slot of the period share an entry with others if their weights are as close as that: so many
# steps a doubling, 9 % each.
LEVELS = 8
# Share of a source is its rows to this power, unless weights are given.
TEMPERATURE = 0.7


def quotas(weights: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Slots of each source in a period by largest remainders, one at least; they add up to the period."""
    items = sorted(((k, w) for k, w in weights.items() if w > 0), key=lambda x: (x[0] is None, x[0] or ""))
    if not items:
        return {}
    period = max(period, 10 * len(items))
    total = sum(w for _, w in items)
    spare = period - len(items)
    exact = [w / total * spare for _, w in items]
    slots = [int(x) for x in exact]
    for i in sorted(range(len(items)), key=lambda i: slots[i] - exact[i])[: spare - sum(slots)]:
        slots[i] += 1
    return {k: 1 + s for (k, _), s in zip(items, slots)}


def schedule(slots: Mapping[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(source, block, release, deadline, slot) over one period: of the blocks released, the one with the
    earliest deadline gets the slot. Block j of a source with n slots in a period of P may start at
    floor(j P / n) and must be over by ceil((j + 1) P / n); at every time each source is then less than one
    block away from its share."""
    period = sum(slots.values())
    names = list(slots)
    # Each source's next block waits for its release, then for the slot; ties go to the source named first.
    waiting, ready, out = [(0, i, 0) for i in range(len(names))], [], []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            release, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // slots[names[i]]), i, j, release))
        deadline, i, j, release = heapq.heappop(ready)
        out.append((names[i], j, release, deadline, t))
        if j + 1 < slots[names[i]]:
            heapq.heappush(waiting, ((j + 1) * period // slots[names[i]], i, j + 1))
    return out


def source_weights(docs: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """source, weight: rows of each source to the power of ``temperature``."""
    rows = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("_rows"))
    return rows.select("source", F.pow("_rows", F.lit(temperature)).alias("weight"))


def _key(source: Column) -> Column:
    """Source as a key for joins: null has one too."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def turns(weights: DataFrame, period: int = PERIOD) -> tuple[DataFrame, dict[str | None, int]]:
    """(members, slots): ``slots`` are the entries of the schedule, ``members`` (_key, _entry, _turn, _of) tells which entry a
    source belongs to, its turn in it and of how many.

    A source whose weight is worth a slot of the period is an entry by itself; there are fewer than 1.1 ``period`` of them.
    Rarer ones with nearly equal weight (LEVELS steps a doubling) are one entry, named by the first of them, and take its slots in
    turn, each with an equal share. As the entry is always less than one block from its share, and so is a turn among equals
    for as long as it goes round, each of these sources stays less than one block from its own. Only entries come to the driver,
    and doubles have at most 2,098 doublings: their number does not grow with that of the sources."""
    level = F.floor(F.log2("weight") * LEVELS)
    keyed = weights.where("weight > 0 AND weight < double('Infinity')").withColumn("_level", level)
    keyed = settle(keyed.select("source", "weight", "_level"), "weights")
    found = keyed.groupBy("_level").agg(
        F.count(F.lit(1)).alias("n"), F.min("weight").alias("least"), F.max("weight").alias("most"), F.min("source").alias("name")
    )
    levels = {r["_level"]: (r["name"], r["n"], r["n"] * (r["least"] / 2 + r["most"] / 2)) for r in found.collect()}
    total = math.fsum(w for _, _, w in levels.values())
    # Sums by level do not depend on the order of rows, so a task that runs again changes no slot.
    rare = [k for k in levels if 2.0 ** (k / LEVELS) * period < total]
    cut = max(rare, default=min(levels, default=0) - 1)
    alone = {r["source"]: r["weight"] for r in keyed.where(F.col("_level") > cut).collect()}
    slots = quotas(alone | {levels[k][0]: levels[k][2] for k in rare}, period)
    entry = {name: i for i, name in enumerate(slots)}

    spark = weights.sparkSession
    single = spark.createDataFrame([(name, entry[name], 0, 1) for name in alone], "source string, _entry int, _turn long, _of long")
    shared = spark.createDataFrame([(k, entry[levels[k][0]], levels[k][1]) for k in rare], "_level long, _entry int, _of long")
    dealt = numbered(keyed.where(F.col("_level") <= cut), ["_level"], F.col("source"), [F.col("source")], out="_turn")
    dealt = dealt.join(F.broadcast(shared), "_level").select(*single.columns)
    members = single.unionByName(dealt).select(_key(F.col("source")).alias("_key"), "_entry", "_turn", "_of")
    return settle(members, "turns"), slots


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
    period: int = PERIOD,
) -> DataFrame:
    """``docs`` as struct ``doc``, with source, block, place (in the block), release, deadline and slot. Rows
    in the order (slot, place) hold each source to its weight within one block for as long as all sources
    last; a source that ends early leaves its slots empty and the others keep their order.

    ``weights``: by source, or a table (source, weight) with each source once; finite. Any number of sources will do: see :func:`turns`.
    The schedule of one period (a parameter's size, not the data's) is computed once; block j of an entry with n slots a
    period goes to period j div n, slot of block j mod n, and with m sources in turn block j of the source in turn r is
    block j m + r of the entry. Rows are numbered within their source over hash buckets, so a source with a third of
    all rows is no hot task.

    Null is a source like others. Sources without a weight, or with weight 0, come after all others, one
    block of each in turn. No row is dropped or repeated, however long its text; an empty table gives no rows."""
    spark = docs.sparkSession
    if weights is None:
        weights = source_weights(docs)
    elif not isinstance(weights, DataFrame):
        weights = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "source string, weight double")
    members, slots = turns(weights, period)
    period, entry = sum(slots.values()), {name: i for i, name in enumerate(slots)}
    steps = spark.createDataFrame(
        [(entry[name], *step, slots[name]) for name, *step in schedule(slots)],
        "_entry int, _block long, _release long, _deadline long, _slot long, _quota long",
    )
    quota = steps.where("_block = 0").select("_entry", "_quota")
    rows = docs.select(F.struct("*").alias("doc"), F.col("source").cast("string").alias("source"))
    content = F.struct("doc.doc_id", "doc.text")
    block = numbered(rows, ["source"], content).withColumns(
        {"_key": _key(F.col("source")), "_at": F.floor(F.col("_row") / block_rows), "place": F.col("_row") % block_rows}
    )
    told = spread_join(block, members, ["_key"], "left", F.col("_row")).join(F.broadcast(quota), "_entry", "left")
    told = told.withColumn("_of_entry", F.col("_at") * F.col("_of") + F.col("_turn"))
    told = told.withColumn("_start", F.floor(F.col("_of_entry") / F.col("_quota")) * period)
    told = told.withColumn("_block", F.col("_of_entry") % F.col("_quota"))
    return told.join(F.broadcast(steps.drop("_quota")), ["_entry", "_block"], "left").select(
        "doc",
        "source",
        F.col("_at").cast("long").alias("block"),
        F.col("place").cast("long").alias("place"),
        (F.col("_release") + F.col("_start")).alias("release"),
        (F.col("_deadline") + F.col("_start")).alias("deadline"),
        F.coalesce(F.col("_slot") + F.col("_start"), F.lit(2**62) + F.col("_at")).cast("long").alias("slot"),
    )


# Rows of the result of :func:`mix_sources` in the order of these columns follow the schedule.
ORDER = ["slot", "source", "place"]


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """The rows of ``mixed`` in the order of the schedule: range-partitioned and sorted, file by file."""
    return mixed.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
