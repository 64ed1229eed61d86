"""Pack documents into sequences of fixed length: best fit, then swap-based local search."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cellgauge.llm.common import ranked, settle
from cellgauge.llm.tokens import BytePairIds

SEQUENCE = 1024
END_ID = 2
# Pieces that are packed together in one task.
BLOCK_PIECES = 20_000
# Pieces of a range of an order that is kept; sequences mix documents of one range only.
RANGE_PIECES = 4_000
# Passes of the local search over the bins of a block.
PASSES = 4


def token_pieces(
    docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, with ``with_ids``): the ids of each text plus the end id, cut
    into pieces of ``sequence`` tokens if longer, where the first piece takes what is left over. Columns named in
    ``carry`` go along with each piece.

    Null and empty texts are one token long. Very long texts are taken whole. No shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    carry = list(carry)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids + carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = BytePairIds(path), end_id.to_bytes(4, "little")
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = coder.ids(text.as_py() or "") + end
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    to = at + (n % sequence or sequence if k == 0 else sequence)
                    part = ids[4 * at : 4 * to]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
                    at, k = to, k + 1
            at_row = pa.array(row, pa.int64())
            columns = [batch.column(0).take(at_row), pa.array(piece, pa.int32()), pa.array(start, pa.int64())]
            columns += [pa.array(length, pa.int64()), pa.array(crc, pa.int64())] + [pa.array(kept, pa.binary())] * with_ids
            columns += [batch.column(2 + i).take(at_row) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    schema += "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select("doc_id", "text", *carry).mapInArrow(run, schema)


class Bins:
    """Bins of one block. ``room`` maps free space to the bins that have it; a bit mask finds the tightest."""

    def __init__(self, size: int, lengths: list[int]) -> None:
        self.size, self.lengths = size, lengths
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self.room: dict[int, set[int]] = defaultdict(set)
        self.mask = 0

    def _set(self, b: int, free: int) -> None:
        old = self.free[b]
        self.room[old].discard(b)
        if not self.room[old]:
            self.mask &= ~(1 << old)
        self.free[b] = free
        self.room[free].add(b)
        self.mask |= 1 << free

    def open(self, items: list[int]) -> int:
        b = len(self.items)
        self.items.append(items)
        self.free.append(self.size)
        self.room[self.size].add(b)
        self._set(b, self.size - sum(self.lengths[i] for i in items))
        return b

    def tightest(self, need: int, but: int = -1) -> int | None:
        """The fullest bin that is not empty and has ``need`` left."""
        mask = self.mask >> need << need
        while mask:
            free = (mask & -mask).bit_length() - 1
            if free >= self.size:
                return None
            for b in self.room[free]:
                if b != but:
                    return b
            mask &= mask - 1
        return None

    def put(self, i: int, b: int) -> None:
        self.items[b].append(i)
        self._set(b, self.free[b] - self.lengths[i])

    def take(self, i: int, b: int) -> None:
        self.items[b].remove(i)
        self._set(b, self.free[b] + self.lengths[i])

    def best_fit(self) -> None:
        for i in sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i]):
            b = self.tightest(self.lengths[i])
            self.put(i, b) if b is not None else self.open([i])

    def used(self) -> int:
        return sum(map(bool, self.items))

    def local_search(self, passes: int = PASSES) -> None:
        """Empty the least filled bins into the room of the others. A document moves to the tightest bin that
        takes it; else it is exchanged for a smaller one, or two documents for one smaller than both, so that
        the other bin gets fuller. Each step adds to the sum of squared fills, so the search ends."""
        # No packing has fewer bins: of all tokens, and of documents over half a bin.
        least = max(-(-sum(self.lengths) // self.size), sum(2 * n > self.size for n in self.lengths))
        for _ in range(passes):
            before = self.used()
            if before <= least:
                break
            changed = False
            order = sorted((b for b, x in enumerate(self.items) if x and self.free[b]), key=lambda b: -self.free[b])
            # Target documents by the length that would fill their bin if it took their place.
            fits: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for b in order:
                for j in self.items[b]:
                    fits[self.lengths[j] + self.free[b]].append((j, b))
            for source in order:
                for i in sorted(self.items[source], key=lambda i: -self.lengths[i]):
                    if i in self.items[source]:
                        changed |= self._place(i, source, fits)
            if self.used() == before and not changed:
                break

    def _place(self, i: int, source: int, fits: dict[int, list[tuple[int, int]]]) -> bool:
        n = self.lengths[i]
        to = self.tightest(n, source)
        if to is not None and self.free[to] <= self.free[source]:
            self.take(i, source)
            self.put(i, to)
            return True
        for group in ([i], *([i, k] for k in self.items[source] if k != i)):
            total = sum(self.lengths[k] for k in group)
            entries = fits.get(total, [])
            while entries:
                j, b = entries.pop()
                now = j in self.items[b] and self.lengths[j] + self.free[b] == total
                if now and b != source and self.lengths[j] < total and self.free[b] <= self.free[source]:
                    for k in group:
                        self.take(k, source)
                    self.take(j, b)
                    for k in group:
                        self.put(k, b)
                    self.put(j, source)
                    for k in self.items[source]:
                        fits[self.lengths[k] + self.free[source]].append((k, source))
                    return True
        return False


def _pack_block(size: int):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        # One order for the same rows, so that a task run again gives the same bins.
        rows = rows.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "start", "ids_crc32")])
        bins = Bins(size, rows["length"].to_pylist())
        if rows["sequence_id"].null_count:
            bins.best_fit()
        else:
            held: dict[int, list[int]] = defaultdict(list)
            for i, s in enumerate(rows["sequence_id"].to_pylist()):
                held[s].append(i)
            for s in sorted(held):
                bins.open(held[s])
        bins.local_search()
        sequence, offset, fill = [0] * len(rows), [0] * len(rows), [0] * len(rows)
        number = 0
        for b, items in enumerate(bins.items):
            at = 0
            for i in items:
                sequence[i], offset[i], fill[i] = (key[0].as_py() << 32) + number, at, size - bins.free[b]
                at += bins.lengths[i]
            number += bool(items)
        told = [pa.array(x, pa.int64()) for x in (sequence, offset, fill)]
        return pa.table([*(rows[c] for c in columns), *told], names=[*columns, "sequence_id", "offset", "fill"])

    return pack


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id, offset and fill.

    Full pieces are sequences by themselves. The others are dealt by hash into blocks of bounded size, each packed
    in a task of its own: best fit in decreasing length, then the local search. The bins that stay
    underfull, a few for each block, are dealt into blocks again and searched once more, across the old
    blocks. Any number of equal lengths or repeated rows is spread over the blocks."""
    slim = settle(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    full = slim.where(F.col("length") >= sequence).select(
        "*",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.col("length").alias("fill"),
    )
    schema = StructType([*slim.schema, *(StructField(c, LongType()) for c in ("sequence_id", "offset", "fill"))])
    part = slim.where(F.col("length") < sequence).withColumn("sequence_id", F.lit(None).cast("long"))
    blocks = max(1, -(-part.count() // block_pieces))
    block = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(blocks))
    packed = settle(part.groupBy(block.alias("block")).applyInArrow(_pack_block(sequence), schema), "packed")
    under = packed.where(F.col("fill") < sequence)
    again = max(1, -(-under.count() // block_pieces))
    # Sequence numbers of the second pass lie above those of the first.
    block = blocks + F.pmod(F.xxhash64("sequence_id"), F.lit(again))
    second = under.drop("offset", "fill").groupBy(block.alias("block")).applyInArrow(_pack_block(sequence), schema)
    return full.unionByName(packed.where(F.col("fill") >= sequence)).unionByName(second)


def _pack_range(size: int):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_rank")
        bins = Bins(size, rows["length"].to_pylist())
        bins.best_fit()
        bins.local_search()
        sequence, offset = [0] * len(rows), [0] * len(rows)
        # Rows are numbered along the order, so a bin's first item is its smallest number.
        for number, items in enumerate(sorted(sorted(x) for x in bins.items if x)):
            at = 0
            for i in items:
                sequence[i], offset[i] = (key[0].as_py() << 32) + number, at
                at += bins.lengths[i]
        told = [pa.array(x, pa.int64()) for x in (sequence, offset)]
        return pa.table([*(rows[c] for c in columns), *told], names=[*columns, "sequence_id", "offset"])

    return pack


def pack_in_order(pieces: DataFrame, order: Sequence[str], sequence: int = SEQUENCE, range_pieces: int = RANGE_PIECES) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32 and the columns ``order``) with sequence_id and offset, where
    sequences by number follow the order of ``order`` and piece.

    The order is cut into consecutive ranges of ``range_pieces`` pieces, full pieces among them. Each range is
    packed in a task of its own, best fit and local search, and its sequences are numbered by their first
    piece. So the sequences of the first n ranges hold just the first n * range_pieces pieces, and within a range no
    piece comes later than its place asks for. A range leaves a sequence or a few underfull."""
    held = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = ranked(pieces.select(*held, *order), [*order, "piece", "doc_id", "ids_crc32"], "ordered-pieces").select(*held, "_rank")
    schema = StructType([*(placed.schema[c] for c in held), *(StructField(c, LongType()) for c in ("sequence_id", "offset"))])
    part = F.floor(F.col("_rank") / range_pieces).cast("long")
    return placed.groupBy(part.alias("range")).applyInArrow(_pack_range(sequence), schema)


def best_fit_packing(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their place in sequences of ``sequence`` tokens; see
    :func:`token_pieces` and :func:`pack_pieces`. Repeated rows and null ids are packed like others; an
    empty table gives no rows."""
    return pack_pieces(token_pieces(docs, path, sequence), sequence)
