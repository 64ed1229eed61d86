"""Exact top-k inner products by three phases: local lists, a safe cutoff, what suffices for it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgauge.llm.common import settle

K = 20
# Queries and candidates that meet in one task.
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
# The first list takes the strongest components that together hold this share of the energy of a block's products.
HEAD_SHARE = 0.5
# With more than this share of a block's entries left after pruning, the rest is one matrix product.
DENSE_SHARE = 0.2
# Doubles hold whole numbers, and sums and products of them, exactly below this.
EXACT = 2**53


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """id, vec: floor(scale * x) of each component as double, of any size. Rows with a null id, a null vector, or a null or
    non-finite component take no part."""
    fine = F.forall(F.col("vec"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec"))
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(F.coalesce(fine, F.lit(False))).select(
        # A double from 2^53 on is whole already, and may pass the longs that floor gives.
        "id", F.transform("vec", lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("vec")
    )


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Shorter vectors are filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v.values.to_numpy(zero_copy_only=False)
    return out


@dataclass(frozen=True)
class _Meeting:
    """Queries and candidates of one task. The first list has the exact products over the strongest components; what the
    other components can add is bounded by their norms, and worked out only where it is asked for. ``slack``: how far rounding
    may put a product of doubles off; None where all are exact."""

    ids: np.ndarray
    others: np.ndarray
    first: np.ndarray
    own: np.ndarray
    a: np.ndarray
    b: np.ndarray
    slack: np.ndarray | None
    vectors: tuple[pa.Array, pa.Array]

    @staticmethod
    def of(q: pa.Table, v: pa.Table, wide: bool) -> _Meeting:
        width = max(max(map(len, x["vec"]), default=0) for x in (q, v))
        vectors = q["vec"].combine_chunks(), v["vec"].combine_chunks()
        a, b = (_matrix(x, width) for x in vectors)
        size, slack = [np.linalg.norm(x, axis=1) for x in (a, b)], None
        if len(a) and len(b) and not size[0].max() * size[1].max() < EXACT:
            if not wide:
                raise OverflowError("a score may pass 2^53, beyond which doubles are not exact")
            size = size[0][:, None] * size[1][None, :]
            slack = np.where(size < EXACT, 0.0, size * (width + 8) * 2.0**-52)
        energy = (a * a).sum(axis=0) * (b * b).sum(axis=0)
        by = np.argsort(-energy, kind="stable")
        total = np.cumsum(energy[by])
        head = 1 + int(np.searchsorted(total, HEAD_SHARE * total[-1])) if width else 0
        head, tail = by[:head], by[head:]
        ids, others = q["id"].to_numpy(), v["id"].to_numpy()
        first = a[:, head] @ b[:, head].T
        return _Meeting(ids, others, first, ids[:, None] == others[None, :], a[:, tail], b[:, tail], slack, vectors)

    def scores(self, row: int, at: np.ndarray, cutoff: float = -np.inf, full: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Those of a query's entries that reach the cutoff, and their scores in full. Where doubles are not exact, entries that
        are below the cutoff in spite of the slack are left out, and the others are scored in Python's whole numbers."""
        score = self.first[row, at] + self.b[at] @ self.a[row] if full is None else full[row, at]
        if self.slack is None:
            reach = score >= cutoff
            return at[reach], score[reach].astype(np.int64)
        slack = self.slack[row, at]
        reach = ~(score + slack < cutoff)
        at, score, slack = at[reach], score[reach], slack[reach]
        whole = [int(x) for x in self.vectors[0][row].as_py()] if slack.any() else []
        product = lambda i: sum(x * int(y) for x, y in zip(whole, self.vectors[1][int(i)].as_py()))
        out = np.empty(len(at), dtype=object)
        out[:] = [product(i) if off else int(s) for i, s, off in zip(at, score, slack != 0)]
        return at, out

    def enough(self, cutoff: np.ndarray) -> np.ndarray:
        """Entries whose first list and the bound of the others together reach the cutoff; no other can be an answer."""
        bound = np.linalg.norm(self.a, axis=1)[:, None] * np.linalg.norm(self.b, axis=1)[None, :]
        # Norms are rounded; scores are whole numbers. What cannot be told (infinity less infinity) is kept.
        most = self.first + bound * (1 + 1e-12) + 1e-3 + (0 if self.slack is None else self.slack)
        return ~(most < cutoff[:, None]) & ~self.own


def _longs(scores: np.ndarray) -> list[int | None]:
    """A score below all longs is None. One above them is among the answers, whatever the others are."""
    if len(scores) and scores.max() >= 2**63:
        raise OverflowError("a score passes the range of a long")
    return [s if s >= -(2**63) else None for s in scores.tolist()]


def _first_lists(k: int, wide: bool):
    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        met = _Meeting.of(q, v, wide)
        tops = np.where(met.own, -np.inf, met.first)
        n = tops.shape[1]
        out_q, out_s = [], []
        for row, query in enumerate(met.ids):
            at = np.argpartition(tops[row], n - k)[n - k :] if n > k else np.arange(n)
            _, score = met.scores(row, at[~met.own[row, at]])
            told = [s for s in _longs(score) if s is not None]
            out_q.append(np.full(len(told), query))
            out_s += told
        return pa.table({"query_id": pa.array(np.concatenate(out_q or [[]]), pa.int64()), "score": pa.array(out_s, pa.int64())})

    return run


def _sufficient(k: int, wide: bool):
    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        met = _Meeting.of(q, v, wide)
        cutoff = np.array([-np.inf if c is None else c for c in q["cutoff"].to_pylist()], dtype=float)
        # The nearest double may lie above a larger cutoff.
        cutoff = np.where(np.abs(cutoff) < EXACT, cutoff, np.nextafter(cutoff, -np.inf))
        enough = met.enough(cutoff)
        full = met.first + met.a @ met.b.T if enough.mean() > DENSE_SHARE else None
        out: list[list] = [[], [], [], []]
        for row, query in enumerate(met.ids):
            at = np.flatnonzero(enough[row])
            n = len(at)
            # Phase three: what is collected is resolved exactly.
            at, score = met.scores(row, at, cutoff[row], full)
            best = np.lexsort((met.others[at], -score))[:k]
            out[0] += [np.full(1 + len(best), query)]
            out[1] += [None, *met.others[at][best].tolist()]
            out[2] += [None, *_longs(score[best])]
            # One row without an answer tells how many entries the query had resolved here.
            out[3] += [n, *[0] * len(best)]
        query = pa.array(np.concatenate(out[0] or [[]]), pa.int64())
        return pa.table({"query_id": query, **{n: pa.array(x, pa.int64()) for n, x in zip(("vec_id", "score", "resolved"), out[1:])}})

    return run


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = K, report: bool = False, wide: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates (id, vec) with the highest inner product for each query
    (id, vec), ties to the smaller id; a candidate with the query's own id does not count.

    Queries and candidates are dealt into blocks of bounded size that meet pair by pair. A block's first list are the partial scores
    over its strongest components. Phase one: each block resolves the tops of its first lists alone, and the k-th best of all
    blocks' scores is a cutoff that no answer falls below. Phase two: with the cutoff, a block collects the entries
    that can reach it, by their partial score and the norms of what is left; the others are pruned before any full product. Phase
    three: what is collected is scored in full, and the k best of all blocks are the answer. Equal vectors in any number cost
    a block k rows a query at most. With ``report`` a column ``resolved`` tells how many entries each query had scored in full in
    phase three; on vectors without stronger components that may be most of them.

    Vectors of unequal length compare over their common components. Vectors so long that a score might pass
    2^53 raise an error; with ``wide`` the phases allow for the rounding of such scores, and what may be an answer is scored in
    Python's whole numbers. Then an answer that no long holds is an error. Repeated candidate rows are candidates each; repeated query rows count once. With fewer than k candidates all are returned; empty tables give
    no rows."""
    spark = candidates.sparkSession
    base = settle(candidates.select("id", "vec"), "vectors")
    asked = settle(queries.select("id", "vec").dropDuplicates(["id"]), "queries")
    n_q, n_v = asked.count(), base.count()
    q_blocks, v_blocks = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n_v // CANDIDATE_BLOCK))
    # A cogroup does not bring its keys to one type, and an int hashes to another task than the equal long.
    deal = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    v = base.withColumn("vb", deal(v_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def dealt(q: DataFrame) -> DataFrame:
        return q.withColumn("qb", deal(q_blocks)).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))

    def meet(q: DataFrame, run, schema: str) -> DataFrame:
        return dealt(q).groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInArrow(run, schema)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    reports = meet(asked, _first_lists(k, wide), "query_id bigint, score bigint").withColumn("_n", F.row_number().over(best))
    cutoffs = reports.where(F.col("_n") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cutoff"))
    told = settle(asked.join(cutoffs, "id", "left"), "cutoffs")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = meet(told, _sufficient(k, wide), "query_id bigint, vec_id bigint, score bigint, resolved bigint")
    if report:
        found = settle(found, "found")
    ranked = found.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # Scores below all longs come last.
    unfit = F.raise_error(F.lit("a score passes the range of a long")).cast("long")
    ranked = ranked.select("query_id", "rank", "vec_id", F.when(F.col("score").isNull(), unfit).otherwise(F.col("score")).alias("score"))
    return ranked.join(found.groupBy("query_id").agg(F.sum("resolved").alias("resolved")), "query_id") if report else ranked
