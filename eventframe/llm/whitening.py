"""Whitening components of embeddings by shifted CholeskyQR.

Vectors become integers ``x = floor(256 * c)``; equal vectors count once in the fit. The centred rows
``A = x - S/n`` are never held together: every pass sends the current preconditioner ``P`` (d x d) to all tasks, and
each task adds up its share of the Gram matrix of ``Q = A P`` (d rows of d numbers per task, summed by Spark).
The first Gram matrix gets a shift, so that its Cholesky factor exists however ill-conditioned the rows are;
``P`` is then solved through the triangular factor, and further passes orthogonalise again until ``Q'Q`` is
the identity to rounding. With ``A = Q R``, ``R`` the product of all factors, the singular values and right
vectors of the small ``R`` give the components; the covariance itself is never diagonalised, so small
eigenvalues keep their digits.

On the driver: a fixed number of d x d matrices. In a task: one batch of rows and one d x d matrix.

Defined cases: vectors that are null or hold null, NaN or infinite entries are dropped; shorter vectors than
the longest are filled up with zeros; repeated rows give rows each, but are one vector in the fit; null identifiers stay.
Entries beyond 2**53/256 are cut to that size. Where a component has no variance (fewer independent directions than
components, or one vector alone) ``whitened`` is null and ``explained`` 0, or null if nothing varies at all;
``identity_error`` covers the components that have variance and is null if there are none. A deviation that no
long can hold is null. Without a vector left, there are no rows;
vectors without entries have no component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.llm.common import cut, slices, table

_SUMS = pa.schema([("i", pa.int32()), ("s", pa.decimal128(38, 0)), ("n", pa.int64())])
_GRAM = pa.schema([("i", pa.int32()), ("g", pa.list_(pa.float64()))])
_BATCH = 4 << 20
#: Passes over the rows at most; three are enough for 64-bit numbers, one more tells that they were.
_PASSES = 6
#: The largest entry, so that sums of a few hundred of them stay in a long.
_MOST = float(1 << 53)


def quantised(emb: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` of the vectors that are whole and finite, all as long as the longest."""
    c = F.col(embedding).cast("array<double>")
    rows = emb.select(F.col(vec_id).alias("vec_id"), c.alias("c")).where(
        F.col("c").isNotNull() & ~F.exists("c", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    cut_off = lambda e: F.greatest(F.least(e * 256, F.lit(_MOST)), F.lit(-_MOST))
    rows = cut(rows.select("vec_id", F.transform("c", lambda e: F.floor(cut_off(e))).alias("x")), "quantised")
    least, most = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most:
        rows = rows.select("vec_id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("x"))).alias("x"))
    return rows


def _matrix(x: pa.Array, d: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _from_mean(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - S``, exact: in longs where they hold it, else in Python's integers."""
    big = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums.tolist()), default=0)) >= 1 << 62
    return x.astype(object) * n - sums if big else x * np.int64(n) - sums.astype(np.int64)


def _sums(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d, object), 0
        for batch in batches:
            for part in slices(batch, _BATCH):
                x = _matrix(part.column("x"), d)
                few = max(1, (1 << 62) // max(int(np.abs(x).max(initial=0)), 1))
                for lo in range(0, len(x), few):
                    total += x[lo:lo + few].sum(0).astype(object)
                n += len(x)
        yield pa.RecordBatch.from_pydict({"i": list(range(d)), "s": total.tolist(), "n": [n] * d}, schema=_SUMS)

    parts = fit.select("x").mapInArrow(run, "i int, s decimal(38,0), n long")
    got = parts.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # d rows
    sums = np.array([int(r["s"]) for r in sorted(got, key=lambda r: r["i"])], object)
    return (int(got[0]["n"]) if got else 0), sums


def _gram(fit: DataFrame, n: int, sums: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and column sums of the rows ``A P``."""
    d, k = p.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((k + 1, k + 1))
        for batch in batches:
            for part in slices(batch, _BATCH):
                a = _from_mean(_matrix(part.column("x"), d), n, sums).astype(float) / n
                q = np.column_stack([a @ p, np.ones(len(a))])
                g += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(g.tolist(), _GRAM.field("g").type)], schema=_GRAM)

    parts = fit.select("x").mapInArrow(run, "i int, g array<double>").select("i", F.posexplode("g").alias("j", "v"))
    out = np.zeros((k + 1, k + 1))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # (k + 1)^2 rows
        out[r["i"], r["j"]] = r["v"]
    return (out[:k, :k] + out[:k, :k].T) / 2, out[:k, k]


def cholesky_qr(gram: Callable[[np.ndarray], np.ndarray], n: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """``P`` and ``R`` with ``A P`` orthonormal and ``A = (A P) R``; ``gram(P)`` is the Gram matrix of ``A P``.

    Directions without variance beyond rounding are left out, so ``P`` may have fewer columns than ``A``.
    """
    unit = np.finfo(float).eps / 2
    g = gram(np.eye(d))
    size = float(np.trace(g))
    if not size > 0:
        return np.zeros((d, 0)), np.zeros((0, d))
    shift = 11 * (n * d + d * (d + 1)) * unit * size
    r = np.linalg.cholesky(g + shift * np.eye(d)).T
    p = np.linalg.solve(r, np.eye(d))
    for _ in range(_PASSES):
        g = gram(p)
        if np.abs(g - np.eye(len(g))).max() < 64 * unit * max(len(g), 8):
            break
        value, vector = np.linalg.eigh(g)
        held = value > 1e-18 * max(1.0, value[-1])
        if held.all() and value[0] > 1e-12 * value[-1]:
            factor = np.linalg.cholesky(g).T
            p = np.linalg.solve(factor.T, p.T).T
            r = factor @ r
        else:
            root = np.sqrt(value[held])
            p = p @ (vector[:, held] / root)
            r = (vector[:, held] * root).T @ r
    return p, r


def whiten(emb: DataFrame, most: int = 4, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, x, n, deviation, z, explained, identity_error)`` per remaining vector: ``z`` and ``explained`` are
    arrays over the first ``most`` components, by falling variance."""
    kind = emb.select(vec_id).schema[0].dataType.simpleString()
    rows = quantised(emb, vec_id, embedding)
    fit = cut(rows.groupBy("x").agg(F.count("*").alias("copies")), "distinct-vectors")
    d = fit.agg(F.max(F.size("x"))).first()[0] or 0
    k = min(most, d)
    if not d:  # no vectors, or none with an entry
        none = F.lit(None).cast("double")
        return rows.select("vec_id", "x", F.lit(fit.count()).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
                           F.array().cast("array<double>").alias("z"), F.array().cast("array<double>").alias("explained"), none.alias("identity_error"))
    n, sums = _sums(fit, d)
    p, r = cholesky_qr(lambda m: _gram(fit, n, sums, m)[0], n, d)
    u, sigma, vt = np.linalg.svd(r, full_matrices=False) if r.size else (np.zeros((0, 0)), np.zeros(0), np.zeros((0, d)))
    # either sign will do: the component's largest entry is positive
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)]) if len(vt) else np.zeros(0)
    weights = (p @ u * sign * np.sqrt(n))[:, :k]
    total = float((sigma ** 2).sum())
    share = [float(s * s / total) for s in sigma[:k]] + [0.0 if total else None] * (k - len(sigma[:k]))
    error = None
    if weights.shape[1]:
        g, mean = _gram(fit, n, sums, weights)
        error = float(np.abs(g / n - np.outer(mean, mean) / n / n - np.eye(len(g))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, _BATCH):
                off = _from_mean(_matrix(part.column("x"), d), n, sums)
                if off.dtype == object or d * float(np.abs(off).max(initial=0)) ** 2 >= 2.0 ** 62:
                    deviation = [v if v < 1 << 63 else None for v in (off.astype(object) ** 2).sum(1)]
                else:
                    deviation = (off * off).sum(1)
                z = (off.astype(float) / n) @ weights
                z = [[*row, *[None] * (k - len(row))] for row in z.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("x"), pa.array(deviation, pa.int64()), pa.array(z, pa.list_(pa.float64()))],
                    names=["vec_id", "x", "deviation", "z"])

    out = rows.mapInArrow(run, f"vec_id {kind}, x array<long>, deviation long, z array<double>")
    return out.select("vec_id", "x", F.lit(n).cast("long").alias("n"), "deviation", "z",
                      F.array(*[F.lit(s).cast("double") for s in share]).cast("array<double>").alias("explained"),
                      F.lit(error).cast("double").alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row of ``embeddings`` on the first four components."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("z", "explained")).alias("c", "v")).select(
        "vec_id", (F.col("c") + 1).cast("int").alias("component"), "n", "deviation", F.col("v.z").alias("whitened"), F.col("v.explained").alias("explained"), "identity_error")
