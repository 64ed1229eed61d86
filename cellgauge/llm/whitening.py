"""Whiten embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.common import settle

# Entries become whole numbers floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
# Columns of the factor are orthogonal when their cosine is under this; so many sweeps at most.
ORTHOGONAL, SWEEPS = 1e-15, 60


@dataclass(frozen=True)
class Whitening:
    """Fit of n distinct vectors with sums ``sums``: ``variances`` falling, ``components`` as unit columns, ``total`` the trace of
    the covariance."""

    n: int
    sums: np.ndarray
    variances: np.ndarray
    components: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, in whole numbers."""
        bound = max(float(np.abs(x).max(initial=0)), 1.0) * self.n
        if bound >= 2**62:
            raise OverflowError("n * x - S does not fit 64 bits")
        return x * self.n - self.sums

    def deviations(self, x: np.ndarray) -> np.ndarray:
        z = self.centred(x)
        if float(np.abs(z).max(initial=0)) ** 2 * max(x.shape[1], 1) >= 2**63:
            raise OverflowError("the sum of squared deviations does not fit 64 bits")
        return (z * z).sum(axis=1)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n) @ self.components / np.sqrt(self.variances)


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order): v[order][:, order] = factor @ factor.T with a lower trapezoidal factor, one column for each pivot
    above the rounding of the largest one."""
    a, d = np.array(v, dtype=float), len(v)
    order = np.arange(d)
    out = np.zeros((d, d))
    floor = d * np.finfo(float).eps * max(float(np.diag(a).max(initial=0.0)), 0.0)
    for j in range(d):
        p = j + int(np.argmax(np.diag(a)[j:]))
        if a[p, p] <= floor:
            return out[:, :j], order
        for x in (a, out):
            x[[j, p]] = x[[p, j]]
        a[:, [j, p]] = a[:, [p, j]]
        order[[j, p]] = order[[p, j]]
        out[j, j] = np.sqrt(a[j, j])
        out[j + 1 :, j] = a[j + 1 :, j] / out[j, j]
        a[j + 1 :, j + 1 :] -= np.outer(out[j + 1 :, j], out[j + 1 :, j])
    return out, order


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor with its columns rotated until all are orthogonal to each other."""
    a = factor.copy()
    r = a.shape[1]
    for _ in range(SWEEPS):
        worst = 0.0
        for p in range(r - 1):
            for q in range(p + 1, r):
                alpha, beta, gamma = a[:, p] @ a[:, p], a[:, q] @ a[:, q], a[:, p] @ a[:, q]
                if gamma == 0 or abs(gamma) <= ORTHOGONAL * np.sqrt(alpha * beta):
                    continue
                worst = max(worst, abs(gamma) / np.sqrt(alpha * beta))
                zeta = (beta - alpha) / (2 * gamma)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                a[:, p], a[:, q] = c * a[:, p] - c * t * a[:, q], c * t * a[:, p] + c * a[:, q]
        if worst <= ORTHOGONAL:
            break
    return a


def principal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variances, components) of a covariance: squared norms of the rotated columns, falling, and the columns as unit vectors.
    Directions without variance are left out."""
    factor, order = pivoted_cholesky(v)
    turned = np.zeros_like(factor)
    turned[order] = one_sided_jacobi(factor)
    norms = np.linalg.norm(turned, axis=0)
    by = np.argsort(-norms, kind="stable")
    return norms[by] ** 2, turned[:, by] / norms[by]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, x of the rows whose vector has only finite entries, of equal length: shorter vectors are filled up with the entry 0."""
    vec = F.col(embedding).cast("array<double>")
    fine = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.select(F.col(vec_id).alias("id"), vec.alias("v"), F.coalesce(fine, F.lit(False)).alias("ok")).where("ok")
    kept = kept.select("id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))
    least, most = kept.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least == most:
        return kept
    fill = F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(most) - F.size("x"))
    return kept.select("id", F.concat("x", fill).alias("x"))


def _summed(rows: DataFrame, width: int, of, shape: tuple[int, int], kind: str) -> np.ndarray:
    """Sum over all rows of of(matrix of x), a table of ``shape``: one partial table a task, summed in the cluster. What
    reaches the driver is of the size of the table, whatever the number of rows."""
    number = np.dtype("int64" if kind == "bigint" else "float64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape, number)
        for batch in batches:
            if batch.num_rows:
                out += of(_matrix(batch.column(0), width))
        at = np.arange(shape[0], dtype=np.int32)
        cells = pa.ListArray.from_arrays(np.arange(0, out.size + 1, shape[1], dtype=np.int32), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at), cells], names=["i", "cells"])

    parts = rows.select("x").mapInArrow(run, f"i int, cells array<{kind}>").select("i", F.posexplode("cells").alias("j", "v"))
    out = np.zeros(shape, number)
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = v
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, float] | None:
    """Fit on the distinct vectors of ``vectors`` (x), and the largest entry of the whitened vectors' covariance minus the
    identity, by a pass of its own over them. None without vectors.

    Two passes: sums first, then the scatter of what is already centred in whole numbers, so no digits cancel."""
    distinct = settle(vectors.select("x").distinct(), "distinct-vectors")
    n, width = distinct.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n or not width:
        return None
    sums = _summed(distinct, width, lambda x: x.sum(axis=0, keepdims=True), (1, width), "bigint")[0]
    about = Whitening(n, sums, np.ones(width), np.eye(width), 0.0)

    def scatter(x: np.ndarray) -> np.ndarray:
        y = about.centred(x) / n
        return y.T @ y

    covariance = _summed(distinct, width, scatter, (width, width), "double") / n
    covariance = (covariance + covariance.T) / 2
    variances, columns = principal(covariance)
    model = Whitening(n, sums, variances[:components], columns[:, :components], float(np.trace(covariance)))
    k = len(model.variances)
    if not k:
        return model, 0.0

    def gram(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)
        return w.T @ w

    # Whitened vectors are centred by the exact sums; their mean is nought but for rounding.
    error = _summed(distinct, width, gram, (k, k), "double") / n - np.eye(k)
    return model, float(np.abs(error).max())


def whiten(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, variance, whitened, explained, identity_error for each row with a finite vector and
    each of the first ``components`` components, by falling variance.

    The fit takes each distinct vector once, so copies of a vector, however many, have no more weight than one. Rows with a null
    vector, or a null or non-finite entry, are left out; a null id stays. Repeated rows get a row each. Components without variance
    (fewer distinct vectors than dimensions, constant entries) do not exist; so a table of one distinct vector, or none, gives no
    rows. Numbers too large for 64 bits raise an error. The width of the vectors, not their number, bounds what the driver holds."""
    vectors = settle(whole_vectors(rows, vec_id, embedding), "vectors")
    kind = vectors.schema["id"].dataType.simpleString()
    fitted = fit(vectors, components)
    names = ["id", "deviation", "whitened"]
    if fitted is None:
        model, error = Whitening(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 1.0), 0.0
    else:
        model, error = fitted
    width = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not width:
                continue
            x = _matrix(batch.column(1), width)
            w = model.whitened(x)
            ends = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32) if w.size else np.zeros(len(x) + 1, np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviations(x)), lists], names=names)

    done = vectors.select("id", "x").mapInArrow(run, f"id {kind}, deviation bigint, whitened array<double>")
    variance = F.array(*(F.lit(float(e)) for e in model.variances)).cast("array<double>")
    each = done.select("id", "deviation", F.posexplode("whitened").alias("_at", "whitened"), variance.alias("_variance"))
    return each.select(
        F.col("id").alias("vec_id"),
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.get("_variance", F.col("_at")).alias("variance"),
        "whitened",
        (F.get("_variance", F.col("_at")) / F.lit(model.total or 1.0)).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
