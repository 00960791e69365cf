"""Whitening of embeddings: the leading components of their covariance, by block subspace iteration on Spark.

The covariance is never formed. A pass over the fit list computes Z = X'(XQ)/n for centred rows X and a block Q of
columns; the driver orthonormalises Z (QR) and rotates it by the small problem Q'Z (Rayleigh-Ritz), until the residuals
|Z w - e Q w| certify all components asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Residuals of eigenpairs, relative to the largest eigenvalue, that certify them.
TOLERANCE = 1e-13
#: Passes with residuals that fall too slowly before the block is doubled; passes before giving up.
PATIENCE, PASSES = 1, 200
#: Components with smaller eigenvalues, relative to the trace, are rounding errors of a covariance of lower rank.
RANK = 1e-12
#: Largest absolute value of an integer vector's component: sums and squares of differences stay exact.
LARGEST = float(1 << 52)


class Fit(NamedTuple):
    n: int
    sums: np.ndarray  # of each dimension, Python integers
    vectors: np.ndarray  # a column for each component
    values: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int


def scaled(vectors: DataFrame, column: str = "embedding", scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """Rows that take part, with ``x``: the long floor(scale * component) + offset of each component, as doubles first.

    Null vectors, and those with null or non-finite components, are dropped; so are vectors of a component beyond LARGEST,
    and those of another length than most have (of equally frequent lengths the larger counts). Empty vectors go too.
    """
    v = F.col(column)
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * F.lit(scale) < F.lit(LARGEST)))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0) & fits)
    rows = rows.withColumn("x", F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("long") + F.lit(offset).cast("long")))
    length = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).agg(F.max_by("d", F.struct("c", "d")).alias("d"))
    return rows.where(F.size("x") == materialise(length).scalar())


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _centred(x: np.ndarray, middle: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S/n without cancellation: integers less the rounded mean, then the fraction that is left of it."""
    return (x - middle).astype(np.float64) - rest


def _summed(fit: DataFrame, d: int, width: int, block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``block`` (rows x d -> d x width), one matrix from each task, added up by its rows."""
    names = [f"c{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = block(_matrix(batch.column(0), d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *map(pa.array, total.T)], names=["row", *names])

    found = fit.select("x").mapInArrow(run, "row int, " + ", ".join(f"{c} double" for c in names))
    rows = found.groupBy("row").agg(*[F.sum(c).alias(c) for c in names]).collect()
    out = np.zeros((max((r["row"] for r in rows), default=-1) + 1, width))
    for r in rows:
        out[r["row"]] = r[1:]
    return out


def fit_components(fit: DataFrame, k: int = 16, block: int | None = None, tolerance: float = TOLERANCE, seed: int = 0) -> Fit | None:
    """Components of the rows ``x`` (one each), or None for no rows.

    ``block``: columns of the iteration, 2 k unless given. Where the residuals fall by less than half in a pass, the block
    is doubled (up to the dimension, where one more pass is exact), so that close eigenvalues cost few passes.
    The driver and each task hold matrices of dimension x block at most.
    """
    first = fit.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    sums, n = [0] * d, fit.count()
    for r in fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect():
        sums[r["i"]] = int(r["s"])
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([(s - int(m) * n) / n for s, m in zip(sums, middle, strict=True)])

    def times(q: np.ndarray) -> np.ndarray:
        def block_of(x: np.ndarray) -> np.ndarray:
            y = _centred(x, middle, rest)
            return np.hstack([y.T @ (y @ q), (y * y).sum(0)[:, None]])

        return _summed(fit, d, q.shape[1] + 1, block_of) / n

    k, random = min(k, d), np.random.default_rng(seed)
    q = np.linalg.qr(random.standard_normal((d, min(d, block or 2 * k))))[0]
    before, slow, passes = np.inf, 0, 0
    while True:
        z = times(q)
        passes += 1
        trace, z = float(z[:, -1].sum()), z[:, :-1]
        small = q.T @ z
        values, rotation = np.linalg.eigh((small + small.T) / 2)
        values, rotation = values[::-1], rotation[:, ::-1]
        vectors, image = q @ rotation, z @ rotation
        residual = float(np.linalg.norm(image[:, :k] - vectors[:, :k] * values[:k], axis=0).max()) / max(values[0], np.finfo(float).tiny)
        if residual <= tolerance or values[0] <= 0 or passes >= PASSES:
            break
        slow = slow + 1 if residual > before / 2 else 0
        before = residual
        # the image of the best directions, and new ones where the block grows
        more = random.standard_normal((d, min(d - q.shape[1], q.shape[1]) if slow >= PATIENCE else 0))
        slow = 0 if more.shape[1] else slow
        q = np.linalg.qr(np.hstack([image, more]))[0]
    if residual > tolerance and values[0] > 0:
        raise ArithmeticError(f"residual {residual:.1e} after {passes} passes")
    there = int((values[:k] > RANK * trace).sum())
    vectors, values = vectors[:, :there], values[:there]

    def check(x: np.ndarray) -> np.ndarray:
        y = _centred(x, middle, rest) @ vectors / np.sqrt(values)
        return np.hstack([y.T @ y, y.sum(0)[:, None]])

    error = 0.0
    if there:
        both = _summed(fit, d, there + 1, check) / n
        error = float(np.abs(both[:, :-1] - np.outer(both[:, -1], both[:, -1]) - np.eye(there)).max())
    return Fit(n, np.array(sums, object), vectors, values, trace, error, residual, passes)


def whiten(vectors: DataFrame, k: int = 16, column: str = "embedding", name: str = "vec_id") -> DataFrame:
    """Each row's place on the first ``k`` components, with variance one over the fit list: the distinct integer vectors.

    Result: ``name``, n, deviation, whitened (an array), explained (an array), identity_error. The fit list is written
    once and read by each pass; rows themselves are read again at the end and not shuffled. Repeated rows and ids each have their result, but
    a vector counts once for the fit. Rows that ``scaled`` leaves out have none; null ids stay null. A covariance of rank
    below ``k`` (a single vector, constant dimensions) has fewer components; an empty table has no rows. Components of
    equal eigenvalues are some orthonormal basis of their space. A deviation that no long holds is null. Other columns
    are not read, whatever they are named.
    """
    rows = scaled(vectors.select(F.col(name).alias("id"), F.col(column).alias("v")), "v").select("id", "x")
    kind = vectors.schema[name].dataType.simpleString()
    schema = f"{name} {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    found = fit_components(materialise(rows.select("x").distinct()), k)
    if found is None or not len(found.values):
        return vectors.sparkSession.createDataFrame([], schema)
    sent = vectors.sparkSession.sparkContext.broadcast(found)  # dimension x k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        d, m, n = len(f.sums), len(f.values), f.n
        middle = np.array([(2 * int(s) + n) // (2 * n) for s in f.sums], np.int64)
        over = [int(s) - int(c) * n for s, c in zip(f.sums, middle, strict=True)]
        rest, axes = np.array([o / n for o in over]), f.vectors / np.sqrt(f.values)
        explained = np.tile(f.values / f.trace, 1)
        for batch in batches:
            x = _matrix(batch.column(1), d)
            whitened = _centred(x, middle, rest) @ axes
            deviation = [_deviation(row, n, over) for row in (x - middle)] if not _fits(x - middle, n, d) else _fast(x - middle, n, over)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * m)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.full(len(x), n, np.int64)), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(whitened.ravel())),
                pa.ListArray.from_arrays(offsets, pa.array(np.tile(explained, len(x)))), pa.array(np.full(len(x), f.identity_error))],
                names=[name, "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def _fits(difference: np.ndarray, n: int, d: int) -> bool:
    """Whether no sum of squares of n * difference (less than n more) can pass a long."""
    largest = int(np.abs(difference).max(initial=0)) + 1
    return d * (n * largest) ** 2 < 1 << 63


def _fast(difference: np.ndarray, n: int, over: list[int]) -> np.ndarray:
    return ((difference * n - np.array(over, np.int64)) ** 2).sum(1)


def _deviation(difference: np.ndarray, n: int, over: list[int]) -> int | None:
    exact = sum((int(x) * n - o) ** 2 for x, o in zip(difference, over, strict=True))
    return exact if exact < 1 << 63 else None


def whitened_rows(vectors: DataFrame, k: int = 16) -> DataFrame:
    """``whiten`` with a row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = whiten(vectors, k)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "z")
    return rows.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", F.col("z.whitened").alias("whitened"),
        F.col("z.explained").alias("explained"), "identity_error")
