"""Near duplicates on word shingles: SetSketch registers, banding, joint estimate, exact check."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.common import settle, text_hash
from cellgauge.llm.components import components
from cellgauge.llm.shingles import SHINGLE_WORDS, mix, shingle_sets, stream
from cellgauge.operators.joins import spread_join

# Registers of a sketch and registers in a band: a pair at similarity 0.8 shares no band with odds 5e-8.
REGISTERS, BAND = 128, 4
# Base of the exponentially spaced register values, their rate and their largest value.
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
# Candidates are dropped if their estimate is so many standard errors under the threshold.
ERRORS = 5.0
# Members of one slice of a group.
SLICE = 2048
TEXT_BYTES = 1_000_000

_FACTORS = (stream(REGISTERS, 23) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (stream(REGISTERS, 29) >> np.uint64(32)).astype(np.uint32)


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes: each element draws one exponential value for each
    register, and the register keeps the exponent, to base ``BASE``, of the smallest, cut to 0..TOP+1. The register
    of a union is the larger one, so sketches merge."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    x = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096, None] * _FACTORS[None, :] + _SHIFTS[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    smallest = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def _share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 64) -> np.ndarray:
    """Likeliest similarity of pairs of sets from their registers (rows of a and b) and sizes: the numbers of
    registers where one is larger, smaller or both are equal are scored over a grid of similarities."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = REGISTERS - more - less
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    j = np.linspace(0, 1, steps)[None, :] * np.minimum(u / v, v / u)
    tiny = 1e-12
    p, q = np.maximum(_share(np.maximum(u - v * j, 0)), tiny), np.maximum(_share(np.maximum(v - u * j, 0)), tiny)
    score = more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, tiny))
    return np.take_along_axis(j, score.argmax(axis=1)[:, None], axis=1)[:, 0]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a batch of texts: first row, last row, bytes laid end to end, ends."""
    texts = [(t.as_py() or "").encode() for t in batch.column(column)]
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= TEXT_BYTES):
            size += len(texts[j])
            j += 1
        yield i, j, np.frombuffer(b"".join(texts[i:j]), np.uint8), np.cumsum([len(t) for t in texts[i:j]], dtype=np.int64)
        i = j


def sketches(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, h1, h2 (hashes of the set), bands: four 16-bit registers to a long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, ends in _texts(batch, 1):
                sets = shingle_sets(data, ends, width)
                h1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                h2 = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                bands = np.concatenate([registers(s) for s in sets]).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, len(bands) + 1, REGISTERS // BAND, dtype=np.int32), bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2), lists],
                    names=["doc_id", "th", "n_shingles", "h1", "h2", "bands"],
                )

    schema = f"doc_id {kind}, th bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>"
    return docs.select("doc_id", "text", text_hash(F.col("text")).alias("th")).mapInArrow(run, schema)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """rep and its full set as bytes; ``docs``: rep, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, ends in _texts(batch, 1):
                found = pa.array([s.tobytes() for s in shingle_sets(data, ends, width)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), found], names=["rep", "shingles"])

    return docs.select("rep", "text").mapInArrow(run, "rep bigint, shingles binary")


def _hopeful(threshold: float) -> float:
    return threshold - ERRORS * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def _likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sketches do not speak against the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.stack([v.values.to_numpy() for v in batch.column(c)]).view(np.uint16) for c in ("_x", "_y"))
                n = [batch.column(c).to_numpy().astype(float) for c in ("_n", "_m")]
                yield batch.select(["a", "b"]).filter(pa.array(estimated(x, y, *n) >= _hopeful(threshold)))

    right = reps.select(F.col("rep").alias("b"), F.col("bands").alias("_y"), F.col("n_shingles").alias("_m"))
    left = reps.select(F.col("rep").alias("a"), F.col("bands").alias("_x"), F.col("n_shingles").alias("_n"))
    met = pairs.join(right, "b").join(left, "a").select("a", "b", "_x", "_y", "_n", "_m")
    return met.mapInArrow(run, "a bigint, b bigint")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _block_links(rep: np.ndarray, side: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of one block that connect its members: pairs across its sides (within the one side if there is only
    one) that share a band, pass the joint estimate and then the exact test. Pairs that links of the block
    connect already are passed over, so there are fewer links than members."""
    threshold = percent / 100
    n = np.array([len(x) for x in sets], float)
    regs = bands.view(np.uint16)
    root = np.arange(len(rep))
    one_side = (side == side[0]).all()
    links = []
    for i in np.argsort(rep, kind="stable") if one_side else np.flatnonzero(side == side.min()):
        j = np.flatnonzero((rep > rep[i]) if one_side else (side != side[i]))
        # No similarity is above the ratio of the sizes.
        j = j[(root[j] != root[i]) & (np.minimum(n[j], n[i]) >= 0.999 * threshold * np.maximum(n[j], n[i]))]
        j = j[(bands[j] == bands[i]).any(axis=1)]
        # Equal registers alone come within a tenth of the estimate; they spare most pairs the likelihood.
        j = j[(regs[j] == regs[i]).sum(axis=1) >= REGISTERS * (_hopeful(threshold) - 0.1)]
        if len(j):
            one = np.broadcast_to(regs[i], (len(j), regs.shape[1]))
            j = j[estimated(one, regs[j], np.full(len(j), n[i]), n[j]) >= _hopeful(threshold)]
        for k in j.tolist():
            if root[k] != root[i] and _linked(sets[i], sets[k], percent):
                links.append((int(min(rep[i], rep[k])), int(max(rep[i], rep[k]))))
                root[root == root[k]] = root[i]
    return links


def _links(groups: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect the members of each group (cluster, rep, bands, shingles) as far as they are linked.

    A group of any size is cut into slices of bounded size, and each slice meets each other one, and itself, in
    a block of its own."""
    sizes = groups.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("_slices"))
    other = F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))
    sliced = groups.join(sizes, "cluster").withColumn("_side", F.pmod(F.xxhash64("rep"), F.col("_slices")).cast("int"))
    sliced = sliced.withColumn("_other", other).withColumns(
        {"_p": F.least("_side", "_other"), "_q": F.greatest("_side", "_other")}
    )
    where = ["cluster", "_p", "_q"]
    laid = sliced.select(*where, "_side", "rep", "bands", "shingles").repartition(*where).sortWithinPartitions(*where)

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        links: list[tuple[int, int]] = []
        p, q = t["_p"][0].as_py(), t["_q"][0].as_py()
        side = t["_side"].to_numpy()
        if p == q or len(np.unique(side)) == 2:
            bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(side), -1)
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in t["shingles"]]
            links = _block_links(t["rep"].to_numpy(), side, bands, sets, percent)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*links) if links else ([], []))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in where])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                now = key[:, i].tolist()
                if held and now != last:
                    yield solve(held)
                    held = []
                held.append(batch.slice(i, j - i))
                last = now
        if held:
            yield solve(held)

    return laid.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id: long, text; others are not looked
    at). Documents are linked if 100 * intersection >= percent * union of their sets of ``width``-word
    shingles, confirmed on the full sets; component_id is the smallest id a document can reach.

    Exact copies (equal sets) are one class from the start, so copies in any number cost no pairs. Classes that
    share a band of registers, one after the other, form a group, where a pair alone in its band must pass the
    joint estimate; within it, pairs that share a band and are not
    connected yet meet in bounded blocks.

    Null and empty texts, and texts without words: n_shingles 0, linked with nothing. Repeated rows: a row each,
    equal results. Texts that share an id are documents of their own, and of those that are linked one is kept. Null
    ids: null component unless their class has an id, and not kept. An empty table gives no rows."""
    return verdicts(docs, percent, width).drop("th")


def verdicts(docs: DataFrame, percent: int = 80, width: int = SHINGLE_WORDS) -> DataFrame:
    """:func:`near_duplicates` with th, the hash of the text. Id and th name a document, so decisions can be told
    apart where one id stands for several texts; of each component the smallest (doc_id, th) is kept."""
    marks = settle(sketches(docs, width).withColumn("doc_id", F.col("doc_id").cast("long")), "sketches")
    some = marks.where("n_shingles > 0 AND doc_id IS NOT NULL")
    name = F.struct("doc_id", "th")
    classes = some.groupBy("h1", "h2").agg(F.min(name).alias("name"))
    firsts = some.join(classes, ["h1", "h2"]).where(name == F.col("name")).dropDuplicates(["h1", "h2"])
    # A class is named by a number of its own, since its smallest id may also be that of another class.
    reps = settle(firsts.select("h1", "h2", F.monotonically_increasing_id().alias("rep"), "name", "n_shingles", "bands"), "classes")
    banded = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("n"))
    buckets = buckets.where("n > 1")
    # A bucket of two is a pair, which the estimate can refuse at once; larger ones stay whole.
    pairs = buckets.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct()
    larger = banded.join(buckets.where("n > 2").select("band", "key", "lo"), ["band", "key"]).where("rep != lo")
    stars = larger.select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct()
    near = settle(_likely(pairs, reps, percent / 100).unionByName(stars), "near")
    groups = components(near).select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("th"), "text").where(F.col("doc_id").isNotNull())
    asked = groups.join(reps, "rep").select("name.*", "rep")
    found = spread_join(texts, asked, ["doc_id", "th"], "inner", F.monotonically_increasing_id())
    sets = _sets(found, width).dropDuplicates(["rep"])
    links = settle(_links(groups.join(reps.select("rep", "bands"), "rep").join(sets, "rep"), percent), "links")
    roots = components(links).withColumnRenamed("node", "rep")
    of = reps.select("h1", "h2", "rep", "name").join(roots, "rep", "left")
    least = of.where("root IS NOT NULL").groupBy("root").agg(F.min("name").alias("least"))
    of = of.join(least, "root", "left").select("h1", "h2", F.coalesce("least", "name").alias("_class"))
    out = marks.select("doc_id", "th", "n_shingles", "h1", "h2").join(of, ["h1", "h2"], "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("_class.doc_id"))
    kept = F.when(alone, F.col("doc_id").isNotNull()).otherwise(name == F.col("_class"))
    return out.select("doc_id", "th", "n_shingles", component.alias("component_id"), F.coalesce(kept, F.lit(False)).alias("kept"))
