"""Remove repeated passages: common-prefix intervals of a suffix array over content-cut phrases.

Every window of ``min_bytes`` bytes holds an anchor, the gram of GRAM bytes with the smallest hash in it (leftmost
if equal), so equal windows have equal anchors. A phrase is a run of windows with one anchor occurrence: windows
p0..p1 and the bytes p0..p1+min_bytes. A window reaches far to the right or far to the left of its anchor's start, so it can
only occur twice if the anchor occurs twice with that much more text on one side (a flank); a phrase is cut to
the windows whose flank does. Equal phrases are settled by an aggregate, and the distinct phrases of a gram,
which are all the suffixes that can share ``min_bytes`` bytes, meet in an enhanced suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.common import settle, single, text_hash
from cellgauge.llm.shingles import RangeHash

MIN_BYTES, GRAM = 100, 24
# Bytes of text worked on at once; longer texts go in overlapping pieces. A task takes some 130 bytes for each.
PIECE_BYTES = 250_000
# The filter on repeated flanks that spares most anchors a shuffle has so many bits for each of them, a power of two in all: it then
# passes 5 in 100 of the others at most. What would need more bits than MOST_FILTER_BITS (32 MB) is not sent to the
# tasks; flanks then meet the repeated ones in a shuffle. No way changes a result: a phrase that occurs once has nothing to settle.
BITS_A_FLANK, LEAST_FILTER_BITS, MOST_FILTER_BITS = 8, 1 << 16, 1 << 28
# A gram with more distinct phrases has its suffixes dealt by content instead of meeting in one array.
GRAM_PHRASES = 4_000
# Suffix starts in one suffix array.
ARRAY_SUFFIXES = 200_000


def phrases(data: np.ndarray, ends: np.ndarray, min_bytes: int, hashed: RangeHash) -> tuple[np.ndarray, ...]:
    """gram, anchor, p0, p1 of the phrases of texts laid end to end, by place in ``data``."""
    reach = min_bytes - GRAM + 1
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < min_bytes:
        return none.view(np.uint64), none, none, none
    at = np.arange(n - GRAM + 1)
    grams = hashed(at, at + GRAM)
    # Order by 31 bits of the hash, then by place: the minimum is the leftmost smallest.
    least = (grams >> np.uint64(33)).astype(np.int64)
    least <<= 32
    least |= at
    del at
    width = 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:], out=least[:-width])
        width *= 2
    if reach > width:
        least = np.minimum(least[: -(reach - width)], least[reach - width :], out=least[: -(reach - width)])
    least &= 0xFFFFFFFF
    anchor = least
    start = np.arange(len(anchor))
    end = ends[np.searchsorted(ends, start, side="right")]
    inside = start + min_bytes <= end
    start, anchor = start[inside], anchor[inside]
    if not len(start):
        return none.view(np.uint64), none, none, none
    new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new - 1, [len(start) - 1]])
    return grams[anchor[first]], anchor[first], start[first], start[last]


def flanks(anchor: np.ndarray, p0: np.ndarray, p1: np.ndarray, n: int, min_bytes: int, hashed: RangeHash):
    """For each phrase, whether it has windows that start less than half the spare bytes before the anchor,
    and the hash of the anchor with as much text to its right as they all hold; the same for the others and the left."""
    half = (min_bytes - GRAM) // 2
    right, left = anchor - p1 < half, anchor - p0 >= half
    # A flank that would leave the piece is not needed there.
    by_right = hashed(anchor, np.minimum(anchor + min_bytes - half, n))
    by_left = hashed(np.maximum(anchor - half, 0), anchor + GRAM) ^ np.uint64(1)
    return right, by_right, left, by_left


def _texts(column: pa.Array) -> Iterator[bytes]:
    """One text after the other, so that a batch is not held twice."""
    return ((t.as_py() or "").encode() for t in column)


def _pieces(texts: Iterable[bytes], min_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """data, ends, row and place in its text of each part: texts laid end to end, long ones in parts that
    overlap so that each window is in one part."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def lay():
        data = np.frombuffer(b"".join(b for _, _, b in held), np.uint8)
        return data, np.cumsum([len(b) for _, _, b in held]), np.array([r for r, _, _ in held]), np.array([o for _, o, _ in held])

    for row, text in enumerate(texts):
        for at in range(0, len(text) - min_bytes + 1, PIECE_BYTES):
            part = text[at : at + PIECE_BYTES + min_bytes - 1]
            if held and size + len(part) > PIECE_BYTES:
                yield lay()
                held, size = [], 0
            held.append((row, at, part))
            size += len(part)
    if held:
        yield lay()


def _flank_counts(docs: DataFrame, min_bytes: int) -> DataFrame:
    """flank, n: how often each flank is in each batch, 2 standing for more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ends, _, _ in _pieces(_texts(batch.column(0)), min_bytes):
                hashed = RangeHash(data)
                _, anchor, p0, p1 = phrases(data, ends, min_bytes, hashed)
                right, by_right, left, by_left = flanks(anchor, p0, p1, len(data), min_bytes, hashed)
                found, n = np.unique(np.concatenate([by_right[right], by_left[left]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.minimum(n, 2), pa.int64())], names=["flank", "n"])

    return docs.select("text").mapInArrow(run, "flank bigint, n bigint")


def _bits(flank: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    g = flank.view(np.uint64)
    return (g % np.uint64(size)).astype(np.int64), ((g >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


def _filter(repeated: DataFrame, size: int) -> np.ndarray:
    """Bloom filter of the repeated flanks: two bits each, in ``size`` bits, joined word by word in the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.unique(np.concatenate(_bits(batch.column(0).to_numpy().astype(np.int64), size)))
            yield pa.RecordBatch.from_arrays([pa.array(places >> 6), pa.array(np.left_shift(1, places & 63, dtype=np.int64))], names=["word", "bits"])

    words = repeated.mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _located(ends: np.ndarray, offs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Part of each place ``at`` in texts laid end to end, and the place in its text."""
    part = np.searchsorted(ends, at, side="right")
    return part, at - (ends[part] - np.diff(ends, prepend=0)[part]) + offs[part]


def _passing(docs: DataFrame, repeated: DataFrame, min_bytes: int) -> DataFrame:
    """doc_id, th, packed: which anchors of a document have a repeated flank, as twice their place, and one more for the left. Every
    flank meets the repeated ones in a shuffle; adaptive execution splits one that is very frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for data, ends, rows, offs in _pieces(_texts(batch.column(2)), min_bytes):
                hashed = RangeHash(data)
                _, anchor, p0, p1 = phrases(data, ends, min_bytes, hashed)
                part, place = _located(ends, offs, anchor)
                for side, (some, flank) in enumerate(zip(*[iter(flanks(anchor, p0, p1, len(data), min_bytes, hashed))] * 2)):
                    row = rows[part[some]]
                    columns = [flank[some].view(np.int64), ids[row], ths[row], 2 * place[some] + side]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["flank", "doc_id", "th", "mark"])

    marks = docs.select("doc_id", "th", "text").mapInArrow(run, "flank bigint, doc_id bigint, th bigint, mark bigint")
    return _packed(marks.join(repeated, "flank", "left_semi").select("doc_id", "th", "mark"), ["mark"])


def _occurrences(docs: DataFrame, repeated: DataFrame, min_bytes: int) -> DataFrame:
    """gram, phrase (hash), doc_id, th, p0, windows of the phrases, cut to windows whose flank is repeated, or, where a filter
    tells, passes it."""
    wanted = repeated.count() * BITS_A_FLANK
    size = max(LEAST_FILTER_BITS, 1 << max(wanted - 1, 0).bit_length())
    if size <= MOST_FILTER_BITS:
        shared = docs.sparkSession.sparkContext.broadcast(_filter(repeated, size))
        rows = docs.select("doc_id", "th", "text")
    else:
        shared = None
        rows = docs.select("doc_id", "th", "text").join(settle(_passing(docs, repeated, min_bytes), "flanks"), ["doc_id", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else shared.value

        def passes(flank: np.ndarray) -> np.ndarray:
            a, b = _bits(flank, size)
            return ((bits[a >> 6] >> (a & 63)) & (bits[b >> 6] >> (b & 63)) & 1).astype(bool)

        for batch in batches:
            ids, ths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for data, ends, rows, offs in _pieces(_texts(batch.column(2)), min_bytes):
                hashed = RangeHash(data)
                gram, anchor, p0, p1 = phrases(data, ends, min_bytes, hashed)
                right, by_right, left, by_left = flanks(anchor, p0, p1, len(data), min_bytes, hashed)
                if bits is not None:
                    right &= passes(by_right)
                    left &= passes(by_left)
                else:
                    part, place = _located(ends, offs, anchor)
                    for row in np.unique(rows):
                        own = np.flatnonzero(rows[part] == row)
                        marks = np.frombuffer(batch.column(3)[int(row)].as_py(), np.int64)
                        right[own] &= np.isin(2 * place[own], marks)
                        left[own] &= np.isin(2 * place[own] + 1, marks)
                half = (min_bytes - GRAM) // 2
                p0, p1 = np.where(left, p0, np.maximum(p0, anchor - half + 1)), np.where(right, p1, np.minimum(p1, anchor - half))
                keep = right | left
                gram, p0, p1 = gram[keep], p0[keep], p1[keep]
                # Equal phrases have equal windows and so their anchor in the same place.
                phrase = hashed(p0, p1 + min_bytes)
                part, place = _located(ends, offs, p0)
                columns = [gram.view(np.int64), phrase.view(np.int64), ids[rows[part]], ths[rows[part]], place, p1 - p0 + 1]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    names = ["gram", "phrase", "doc_id", "th", "p0", "windows"]
    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _packed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id, th, packed: the rows of a document as bytes, 64-bit numbers column after column, which numpy reads
    in place. A document's rows are bounded by its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.stack([x.field(c).to_numpy() for c in columns]).tobytes() for x in (r.values for r in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "th", "packed"])

    held = rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return held.mapInArrow(run, "doc_id bigint, th bigint, packed binary")


def _with_bytes(firsts: DataFrame, docs: DataFrame, min_bytes: int) -> DataFrame:
    """``firsts`` with the byte before each phrase (empty at the start of a text) and the phrase's bytes."""
    columns = ["gram", "phrase", "p0", "windows", "kinds"]
    at = settle(_packed(firsts, columns), "wanted")
    met = docs.select("doc_id", "th", "text").join(at, ["doc_id", "th"]).select("doc_id", "th", "text", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[list] = [[] for _ in columns]
            ids, ths, lefts, bodies = [], [], [], []
            for doc, th, text, packed in zip(*(batch.column(i) for i in range(4))):
                text, rows = text.as_py().encode(), np.frombuffer(packed.as_py(), np.int64).reshape(len(columns), -1)
                for k, r in zip(kept, rows):
                    k.append(r)
                for p, w in zip(rows[2].tolist(), rows[3].tolist()):
                    lefts.append(text[max(p - 1, 0) : p])
                    bodies.append(text[p : p + w + min_bytes - 1])
                ids += [doc.as_py()] * rows.shape[1]
                ths += [th.as_py()] * rows.shape[1]
            gram, phrase, p0, windows, kinds = (pa.array(np.concatenate(k) if k else [], pa.int64()) for k in kept)
            parts = [gram, phrase, pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), p0, windows, kinds, pa.array(lefts, pa.binary()), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(parts, names=names)

    names = ["gram", "phrase", "doc_id", "th", "p0", "windows", "kinds", "left", "bytes"]
    return met.mapInArrow(run, ", ".join(f"{c} bigint" for c in names[:7]) + ", left binary, bytes binary")


def suffix_intervals(bodies: list[bytes], lefts: list[bytes], windows: np.ndarray, order: np.ndarray, min_bytes: int):
    """Common-prefix intervals of at least ``min_bytes`` of the suffixes that start at the first ``windows`` bytes of
    each phrase. Returns (later, groups): ``later`` marks, for each suffix (phrase after phrase), that an equal
    window starts earlier by ``order`` (rank of the phrases; equal windows never share a phrase's rank, but
    for repeats inside one phrase, where the place decides); ``groups`` are the maximal repeats as (length, suffix numbers).

    The suffixes are sorted, neighbours' common prefixes measured, and one scan with a stack closes
    each interval when the prefix gets shorter. An interval is a maximal repeat if its members are
    preceded by different bytes or by the start of a text."""
    width = max(map(len, bodies))
    flat = np.frombuffer(b"".join(b.ljust(2 * width, b"\0") for b in bodies), np.uint8)
    body = np.repeat(np.arange(len(bodies)), windows)
    within = np.arange(len(body)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = body * 2 * width + within
    later = np.zeros(len(start), bool)
    # Only suffixes whose first min_bytes bytes occur twice can be in an interval.
    _, inverse, counts = np.unique(RangeHash(flat)(start, start + min_bytes), return_inverse=True, return_counts=True)
    some = np.flatnonzero(counts[inverse] > 1)
    if not len(some):
        return later, []
    length = np.array([len(b) for b in bodies])[body] - within
    rows = np.lib.stride_tricks.sliding_window_view(flat, width)[start[some]]
    sa = np.argsort(np.ascontiguousarray(rows).view(f"V{width}").ravel(), kind="stable")
    rows, some = rows[sa], some[sa]
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp = np.minimum(lcp, np.minimum(length[some][1:], length[some][:-1])).tolist() + [-1]
    rank = (order[body[some]].astype(np.int64) * (2 * width) + within[some]).tolist()
    before = [int(flat[s - 1]) if w else (lefts[b][0] if lefts[b] else -1 - i) for i, (s, w, b) in enumerate(zip(start[some].tolist(), within[some].tolist(), body[some].tolist()))]
    groups: list[tuple[int, np.ndarray]] = []
    # Open intervals: common prefix, first place in the array, member that starts first, byte before all members
    # (None: it differs). The outermost one holds what shares too little.
    stack: list[tuple] = [(0, 0, None, None)]
    for i, shared in enumerate(lcp):
        shared = shared if shared >= min_bytes else 0
        at, first, byte = i, i, before[i]
        while stack[-1][0] > shared:
            depth, at, f, b = stack.pop()
            first, byte = (f if rank[f] < rank[first] else first), (b if b == byte else None)
            if byte is None:
                groups.append((depth, some[at : i + 1]))
            if stack[-1][0] == 0 and shared == 0:
                later[some[at : i + 1]] = True
                later[some[first]] = False
        if shared and stack[-1][0] == shared:
            depth, at, f, b = stack.pop()
            first, byte = (f if rank[f] < rank[first] else first), (b if b == byte else None)
        if shared:
            stack.append((shared, at, first, byte))
    return later, groups


def _arrays(found: DataFrame, min_bytes: int, groups: bool) -> DataFrame:
    """Suffix arrays over all phrases of a gram, for many grams at a time. Spans (doc_id, th, start, end) that occur
    earlier, or with ``groups`` the maximal repeats (group, length, gram, phrase, offset)."""
    columns = ["gram", "phrase", "doc_id", "th", "p0", "windows", "left", "bytes"]
    laid = found.select(*columns).repartition("gram").sortWithinPartitions("gram")
    names = ["group", "length", "gram", "phrase", "offset"] if groups else ["doc_id", "th", "start", "end"]

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        gram, phrase, doc, th, p0, windows = (t[c].to_numpy() for c in columns[:6])
        order = np.empty(len(doc), np.int64)
        order[np.lexsort((p0, th, doc))] = np.arange(len(doc))
        later, found = suffix_intervals(t["bytes"].to_pylist(), t["left"].to_pylist(), windows, order, min_bytes)
        row = np.repeat(np.arange(len(doc)), windows)
        within = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        if groups:
            size = [len(m) for _, m in found]
            m = np.concatenate([m for _, m in found]) if found else np.zeros(0, np.int64)
            length = np.repeat(np.array([n for n, _ in found], np.int64), size)
            lead = np.repeat(np.array([x[0] for _, x in found], np.int64), size)
            key = phrase[row[lead]] ^ (within[lead] << 20) ^ (length << 40)
            out = [key, length, gram[row[m]], phrase[row[m]], within[m]]
        else:
            s = np.flatnonzero(later)
            new = np.flatnonzero((np.diff(s) != 1) | (row[s[1:]] != row[s[:-1]])) + 1 if len(s) else np.zeros(0, np.int64)
            a = s[np.concatenate([[0], new])] if len(s) else s
            b = s[np.concatenate([new - 1, [len(s) - 1]])] if len(s) else s
            out = [doc[row[a]], th[row[a]], p0[row[a]] + within[a], p0[row[b]] + within[b] + min_bytes]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(gram[1:] != gram[:-1]) + 1).tolist(), len(gram)]
            many = np.add.reduceat(batch.column(5).to_numpy(), cuts[:-1]).tolist()
            begin = 0
            for i, n in zip(cuts, many):
                # A gram's phrases stay together.
                if size + n > ARRAY_SUFFIXES and size and gram[i] != last:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    yield solve(held)
                    held, size, begin = [], 0, i
                size, last = size + n, gram[i]
            held.append(batch.slice(begin))
        if held:
            yield solve(held)

    return laid.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _windows(found: DataFrame, min_bytes: int) -> DataFrame:
    """gram, phrase, doc_id, th, start, offset, window (hash) of each window of phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            windows = batch.column(5).to_numpy()
            row = np.repeat(np.arange(len(windows)), windows)
            within = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            bodies = batch.column(8).to_pylist()
            start = np.repeat(np.cumsum([0, *map(len, bodies)])[:-1], windows) + within
            h = RangeHash(np.frombuffer(b"".join(bodies), np.uint8))(start, start + min_bytes).view(np.int64)
            cols = [batch.column(i).to_numpy()[row] for i in range(4)] + [batch.column(4).to_numpy()[row] + within, within, h]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=names)

    names = ["gram", "phrase", "doc_id", "th", "start", "offset", "window"]
    return found.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id (null: the smallest number), th (hash of the text), text. Both together name a document, and
    each document is there once: a repeated row is no earlier holder of its own passages."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), text_hash(F.col("text")).alias("th"), text.alias("text")
    )
    return single(named, ["doc_id", "th"], "documents")


def _searched(docs: DataFrame, min_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Occurrences of phrases with repeated grams; the first occurrence and number of each distinct phrase; and with
    their bytes the phrases of grams that have several: those for suffix arrays, and those of hot grams."""
    flank = _flank_counts(docs, min_bytes).groupBy("flank").agg(F.sum("n").alias("n")).where("n > 1").select("flank")
    occurrences = settle(_occurrences(docs, settle(flank, "repeated-flanks"), min_bytes), "occurrences")
    place = F.struct("doc_id", "th", "p0", "windows")
    firsts = occurrences.groupBy("gram", "phrase").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = settle(firsts, "phrases")
    kinds = firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    several = firsts.select("gram", "phrase", "first.*").join(kinds, "gram")
    found = settle(_with_bytes(several, docs, min_bytes), "suffixes")
    return occurrences, firsts, found.where(F.col("kinds") <= GRAM_PHRASES), found.where(F.col("kinds") > GRAM_PHRASES)


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, th, start, end of stretches whose windows of ``min_bytes`` bytes all start earlier as well;
    stretches may overlap. ``docs``: doc_id, th, text as of :func:`_identified`."""
    occurrences, firsts, cool, hot = _searched(docs, min_bytes)
    again = occurrences.join(firsts.where("n > 1").select("gram", "phrase", "first"), ["gram", "phrase"])
    copies = again.where(F.struct("doc_id", "th", "p0") != F.struct("first.doc_id", "first.th", "first.p0")).select(
        "doc_id", "th", F.col("p0").alias("start"), (F.col("p0") + F.col("windows") - 1 + min_bytes).alias("end")
    )
    windows = _windows(hot, min_bytes)
    place = F.struct("doc_id", "th", "start")
    least = windows.groupBy("gram", "window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = windows.join(least, ["gram", "window"]).where(place != F.col("first")).select(
        "doc_id", "th", "start", (F.col("start") + min_bytes).alias("end")
    )
    return copies.unionByName(_arrays(cool, min_bytes, False)).unionByName(later)


def maximal_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """group, length, doc_id, start: repeats of at least ``min_bytes`` bytes with all their occurrences (several rows of
    a group), not just neighbours. Repeats are those that cannot be extended within a phrase: longer ones show as
    a chain of groups that overlap, whose union is the repeat. Null ids show as null; repeated rows once."""
    docs = _identified(docs)
    occurrences, firsts, cool, hot = _searched(docs, min_bytes)
    whole = firsts.where("n > 1").select(
        F.xxhash64("gram", "phrase").alias("group"), (F.col("first.windows") - 1 + min_bytes).alias("length"), "gram", "phrase", F.lit(0).cast("long").alias("offset")
    )
    windows = _windows(hot, min_bytes)
    many = windows.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = windows.join(many, ["gram", "window"]).select(
        F.xxhash64("gram", "window").alias("group"), F.lit(min_bytes).cast("long").alias("length"), "gram", "phrase", "offset"
    )
    groups = whole.unionByName(_arrays(cool, min_bytes, True)).unionByName(dealt)
    doc = F.when(F.col("doc_id") != -(2**63), F.col("doc_id"))
    return groups.join(occurrences.drop("windows"), ["gram", "phrase"]).select(
        "group", "length", doc.alias("doc_id"), (F.col("p0") + F.col("offset")).alias("start")
    ).distinct()


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, with_text: bool = False) -> DataFrame:
    """``docs`` as struct ``doc`` with n_bytes, n_removed, n_spans, kept_sha256 (and the text that is kept): each
    byte of the UTF-8 text covered by a window of ``min_bytes`` bytes that also starts earlier (in a
    document with a smaller id, or further ahead in the same one) is removed. Windows are judged on the input.

    A cut inside a character leaves its other bytes in the digest; the kept text drops them. Null text is
    empty. Rows that agree in id and text are one document and get equal results; null ids come first, in
    order of the text's hash, as do other texts with one id. Texts shorter than ``min_bytes`` stay. Very long texts are worked on in
    overlapping pieces. An empty table gives no rows."""
    spans = settle(_packed(repeated_spans(_identified(docs), min_bytes), ["start", "end"]), "spans")
    spans = spans.withColumnsRenamed({"doc_id": "_id", "th": "_th", "packed": "_spans"})
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.struct("*").alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(text).alias("_th")
    )
    met = rows.join(spans, ["_id", "_th"], "left").select("doc", "_spans")
    digest = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            texts = batch.column(0).field("text") if batch.num_rows else []
            for text, found in zip(texts, batch.column(1)):
                data = (text.as_py() or "").encode()
                kept, at, removed, n = [], 0, 0, 0
                end = -1
                places = np.frombuffer(found.as_py() or b"", np.int64).reshape(2, -1)
                for start, stop in sorted(zip(*places.tolist())):
                    if start > end:
                        kept.append(data[at:start])
                        n, at, removed, end = n + 1, stop, removed + stop - start, stop
                    elif stop > end:
                        removed, at, end = removed + stop - end, stop, stop
                left = b"".join([*kept, data[at:]])
                out.append((len(data), removed, n, hashlib.sha256(left).hexdigest()) + ((left.decode("utf-8", "ignore"),) if with_text else ()))
            kinds = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)
            cols = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc", *(d.split()[0] for d in digest.split(", "))])

    doc = docs.select(F.struct("*").alias("doc")).schema["doc"].dataType.simpleString()
    return met.mapInArrow(run, f"doc {doc}, {digest}")
