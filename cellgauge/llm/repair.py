"""Repair the structure of conversations: a cheapest audit over persistent edit sequences, stretch by stretch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.audits import START, STATES, Chain, Costs, transfers
from cellgauge.llm.common import SPACES, settle
from cellgauge.operators.joins import spread_join

# Rows that follow each other are worked on in stretches of at most so many (a power of two).
STRETCH_LOG2 = 10
# Characters of a text that order rows of one turn and role; its hash decides between texts that begin alike.
LEAD = 64
# Ends of a whole sentence, and initials that may follow each other.
ENDS = ".!?"
LEGAL = ("su", "ua", "au")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n of ``rows`` after the damage that the hash of conversation and turn names: 0 drops a row, 1
    empties its text, 2 removes its sentence ends, 3 repeats it (n = 2), 4 makes it a user's. Nulls count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(said("conv_id"), F.lit(":"), said("turn")), "UTF-8")) % 20
    told = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return told.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _key(conv_id: Column) -> Column:
    """Null is a conversation like others."""
    return F.coalesce(F.concat(F.lit("#"), conv_id.cast("string")), F.lit(""))


def _laid(turns: DataFrame) -> DataFrame:
    """Turns in order, as files in the shared folder: at (place over all conversations, gapless within a file), conv (key), turn,
    role, text (null where an equal turn came earlier), initial, blank, later (an equal turn came earlier), truncated, n.

    Equal turns are found by a compact aggregate over hashes; only repeated ones are shuffled again, with map-side
    combine, so a row in any number of copies is one row with a count. Rows are dealt by ranges of conversation and turn, so a long
    conversation is spread over many tasks."""
    bare = F.translate("text", SPACES, "")
    named = turns.select(
        _key(F.col("conv_id")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        "text",
        "n",
        F.left("text", F.lit(LEAD)).alias("lead"),
        F.xxhash64("conv_id", "role", "text").alias("h1"),
        F.xxhash64("text", F.lit(1), "role", "conv_id").alias("h2"),
    )
    # Places of a turn: null comes first.
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    again = named.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.sum("n").alias("times")).where("times > 1")
    again = settle(again.select("h1", "h2", F.col("first.told").alias("_told"), F.col("first.turn").alias("_turn"), F.lit(True).alias("_again")), "repeated-turns")
    met = spread_join(named, again, ["h1", "h2"], "left", F.monotonically_increasing_id())
    marked = met.withColumn("later", ~(F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("turn").isNotNull() == F.col("_told"))))
    marked = marked.withColumns({"blank": bare == "", "last": F.right(bare, F.lit(1))})
    same = ["conv", "turn", "role", "lead", "h1", "h2"]
    rest = ["text", "blank", "last"]
    once = marked.where(F.col("_again").isNull()).select(*same, *rest, F.lit(False).alias("later"), "n")
    # Of repeated turns later ones go without their text.
    text = F.when(~F.col("later"), F.col("text")).alias("text")
    copies = marked.where("_again").select(*same, text, "blank", "last", "later", "n")
    copies = copies.groupBy(*same, "later").agg(*(F.min(c).alias(c) for c in rest), F.sum("n").alias("n"))
    order = ["conv", "turn", "role", "lead", "h1"]
    every = once.unionByName(copies.select(*once.columns)).repartitionByRange(*order).sortWithinPartitions(*order)
    initial = F.when(F.col("role").rlike("^[sua]"), F.left("role", F.lit(1))).otherwise("-")
    truncated = ~F.col("blank") & ~F.col("later") & ~F.col("last").isin(*ENDS)
    columns = ["conv", "turn", "role", "text", initial.alias("initial"), "blank", "later", truncated.alias("truncated"), "n"]
    return settle(every.select(F.monotonically_increasing_id().alias("at"), *columns), "turns")


_STRETCH = (
    "conv string, stretch bigint, begin bigint, entry int, `exit` int, cost bigint, rank int, edits string, "
    "illegal bigint, head string, tail string"
)


def _stretches(laid: DataFrame, costs: Costs) -> DataFrame:
    """For each stretch of a conversation, the cheapest edits from each state to each; with its illegal neighbours,
    first and last initial. Each stretch is a bounded number of rows of one byte or so, worked on by itself."""
    slim = laid.select(F.shiftright("at", STRETCH_LOG2).alias("stretch"), "at", "conv", "initial", "blank", "later", "truncated", "n")
    dealt = slim.repartition("stretch").sortWithinPartitions("stretch", "at")

    def solved(conv, stretch, begin, rows, entries):
        turns, illegal, before = [], 0, ""
        for initial, blank, later, truncated, n in rows:
            own = not blank and not later
            turns.append((initial, truncated, int(own), n - own))
            illegal += (bool(before) and before + initial not in LEGAL) + n - 1
            before = initial
        for found in transfers(turns, entries, costs):
            yield (conv, stretch, begin, *found, illegal, rows[0][0], before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begin, held, out, entries = (None, None), 0, [], [], STATES
        for batch in batches:
            for stretch, at, conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, stretch) != key:
                    if held:
                        out += solved(*key, begin, held, entries)
                    # Only the first conversation of a stretch may have begun before it.
                    entries = (START,) if stretch == key[1] else STATES
                    key, begin, held = (conv, stretch), at, []
                    if len(out) >= 4096:
                        yield laid_out(out)
                        out = []
                held.append(row)
        if held:
            out += solved(*key, begin, held, entries)
        yield laid_out(out)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = ["conv", "stretch", "begin", "entry", "exit", "cost", "rank", "edits", "illegal", "head", "tail"]

    def laid_out(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * len(kinds), kinds)], names=names)

    return settle(dealt.mapInArrow(run, _STRETCH), "stretches")


def _chosen(stretches: DataFrame, costs: Costs) -> DataFrame:
    """conv, cost, illegal, last (inserts at the end), chain of (stretch, entry, exit): one row a stretch for each conversation,
    with its cost, illegal neighbours and last inserts in the row of its first one."""
    names = ["conv", "stretch", "entry", "exit", "cost", "rank", "illegal", "head", "tail"]
    dealt = stretches.select(*names).repartition("conv").sortWithinPartitions("conv", "stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv = stretch = chain = None
        illegal, before, found = 0, "", []

        def ended():
            chain.extend(stretch, found)
            cost, tail, path = chain.finish()
            for i, (s, a, b) in enumerate(path):
                out.append((conv, s, a, b, None if i else cost, None if i else illegal, None if i else tail))

        for batch in batches:
            for c, s, a, b, cost, rank, bad, head, tail in zip(*(x.to_pylist() for x in batch.columns)):
                if c != conv:
                    if chain is not None:
                        ended()
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=columns)
                        out.clear()
                    conv, stretch, chain, illegal, before, found = c, None, Chain(costs), 0, "", []
                if s != stretch:
                    if found:
                        chain.extend(stretch, found)
                    illegal += bad + (bool(before) and before + head not in LEGAL)
                    stretch, before, found = s, tail, []
                found.append((a, b, cost, rank))
        if chain is not None:
            ended()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=columns)

    columns = ["conv", "stretch", "entry", "exit", "cost", "illegal", "last"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    schema = "conv string, stretch bigint, entry int, `exit` int, cost bigint, illegal bigint, last string"
    return settle(dealt.mapInArrow(run, schema), "chosen")


@dataclass(frozen=True)
class Repaired:
    """``audits``: conv (key), gaps, blank, duplicate, truncated, illegal, cost, audit. ``turns``: conv, at, part, role, text of the
    repaired conversations, in the order of at and part."""

    audits: DataFrame
    turns: DataFrame


def repair(turns: DataFrame, costs: Costs = Costs()) -> Repaired:
    """Cheapest repair of each conversation in ``turns`` (conv_id, turn, role, text, and n copies): roles must read s?(ua)+, or
    nothing be left. Blank and repeated turns go; kept turns that end without a sentence end cost extra; turns may get another
    role, and empty ones be put in. Of equally cheap audits the least one (D, I, K, R) is taken.

    Rows are laid in order and cut into stretches. A stretch gives the cheapest edits from each of four states to each, a
    conversation's stretches are then put together by cost and rank alone; so a conversation with a third of all rows is worked
    on by many tasks, and what meets in one is a few numbers for each thousand rows.

    Rows of one turn come by role and text. Roles are compared by their first character as it is; an empty one is none of
    the three. Null roles and texts count as one space, a null conv_id is a conversation like others. Very long texts are
    read whole, but travel with their row only. An empty table gives none."""
    told = turns.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), "n")
    laid = _laid(told)
    stretches = _stretches(laid, costs)
    chosen = _chosen(stretches, costs)
    path = ["conv", "stretch", "entry", "exit"]
    edits = stretches.select(*path, "begin", "edits").join(chosen.select(*path, "last"), path)
    edits = settle(edits.select("conv", "stretch", "begin", "edits"), "edits")
    letters = F.translate(F.replace("edits", F.lit(" "), F.lit("")), "uaUA", "RRII")
    joined = F.transform(F.sort_array(F.collect_list(F.struct("stretch", letters.alias("letters")))), lambda x: x["letters"])
    # The audit of a conversation is one value of the result, as long as the conversation has turns.
    audits = edits.groupBy("conv").agg(F.array_join(joined, "").alias("audit"))
    ends = chosen.where("cost IS NOT NULL").select("conv", "cost", "illegal", "last")
    own = F.when(F.col("blank") | F.col("later"), 0).otherwise(1)
    counts = laid.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - own)).alias("duplicate"),
        F.count_if("truncated").alias("truncated"),
    )
    told = counts.join(ends, "conv").join(audits, "conv").select(
        "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.concat("audit", F.translate("last", "UA", "II")).alias("audit")
    )
    # One token a row, by place.
    token = edits.select("conv", F.posexplode(F.split("edits", " ")).alias("_i", "token"), "begin")
    token = token.select((F.col("begin") + F.col("_i")).alias("at"), "token").where(F.col("token").rlike("[^D]"))
    met = laid.select("at", "conv", "role", "text").join(token, "at")
    # What a token puts out: inserted turns, and the row's own unless it is deleted.
    signs = F.filter(F.split("token", ""), lambda x: (x != "D") & (x != ""))
    out = met.select("conv", "at", "role", "text", F.posexplode(signs).alias("part", "sign"))
    name = F.when(F.col("sign") == "K", F.col("role")).when(F.lower("sign") == "u", "user").otherwise("assistant")
    made = F.col("sign").isin("U", "A")
    rows = out.select("conv", "at", "part", name.alias("role"), F.when(made, "").otherwise(F.col("text")).alias("text"))
    last = ends.where("last <> ''").select("conv", F.lit(2**62).alias("at"), F.posexplode(F.split("last", "")).alias("part", "sign")).where("sign <> ''")
    tail = last.select("conv", "at", "part", F.when(F.col("sign") == "U", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"))
    return Repaired(told, rows.unionByName(tail))


def digests(turns: DataFrame) -> DataFrame:
    """conv, sha256 of the lines ``role:text`` of each conversation, joined by newlines. A task reads its conversations' turns one
    after the other and holds none of them."""
    dealt = turns.select("conv", "at", "part", F.encode(F.concat("role", F.lit(":"), "text"), "UTF-8").alias("line"))
    dealt = dealt.repartition("conv").sortWithinPartitions("conv", "at", "part").select("conv", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for c, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                if c != conv:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256(line.as_py())
                else:
                    digest.update(b"\n" + line.as_py())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done)], names=["conv", "sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (conv, digest.hexdigest())], names=["conv", "sha256"])

    return dealt.mapInArrow(run, "conv string, sha256 string")


def repair_conversations(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of ``rows`` (conv_id,
    turn, role, text) after :func:`damaged` and :func:`repair`. Conversations without a row after damage have zeros, an empty
    audit and the digest of nothing, as has a repair that leaves no turn. An empty table gives no rows."""
    found = repair(damaged(rows), costs)
    convs = rows.select("conv_id").distinct().withColumn("conv", _key(F.col("conv_id")))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return convs.join(found.audits, "conv", "left").join(digests(found.turns), "conv", "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", nothing).alias("repaired_sha256")
    )
