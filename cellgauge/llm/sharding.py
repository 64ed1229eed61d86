"""Reproducible shuffle into shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.common import numbered

ROUNDS = 6
# Steps of one cycle walk. The square-like domain overshoots n rows by less than its root, so a walk this
# long is certain for up to 4096 rows and has odds under 64^-64 to fall short above; then it is an error.
WALK = 64


def permuted(number: Column, n: int, seed: int) -> Column:
    """Image of a number in 0..n-1 under a pseudo-random bijection of that range.

    A Feistel network over pairs (mod a, mod b) with a * b >= n, applied again (cycle walking) while the
    image is n or more."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def network(x: Column) -> Column:
        start = F.struct(F.pmod(x, F.lit(a)).alias("l"), F.floor(x / F.lit(a)).cast("long").alias("r"))

        def step(s: Column, k: Column) -> Column:
            side = F.when(k % 2 == 0, F.lit(a).cast("long")).otherwise(F.lit(b).cast("long"))
            mixed = F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(seed), k, s["r"]), side), side)
            return F.struct(s["r"].alias("l"), mixed.alias("r"))

        rounds = F.array(*(F.lit(k) for k in range(ROUNDS)))
        return F.aggregate(rounds, start, step, lambda s: s["r"] * F.lit(a) + s["l"])

    number = number.cast("long")
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), network(number), lambda x, _: F.when(x >= F.lit(n), network(x)).otherwise(x)
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def feistel_shards(docs: DataFrame, shards: int = 16, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs`` (doc_id, text; other
    columns are not looked at).

    Rows get global numbers along a hash of their content, the permutation gives each a place p, and
    shard = p mod shards, slot = p div shards. So shards differ by one row at most (law ``rows``), slots
    have no gaps, and anyone who knows the number of a row, the row count and the seed can compute its place.

    Null text: size 1, crc 0. Null and repeated ids are rows like others; equal rows get places of their
    own. An empty table gives no rows."""
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.xxhash64("text").alias("_text"),
    )
    n = docs.count()
    place = numbered(rows, [], F.struct("doc_id", "_text"), [F.col("doc_id"), F.col("_text")]).withColumn(
        "_place", permuted(F.col("_row"), n, seed)
    )
    return place.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
