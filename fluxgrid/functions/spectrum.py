"""The largest singular values of operators of any size: block Lanczos on the gram, with thick restarts.

Vectors are the columns of wide tables (p, x): a row for each place, an array with its value in each vector. One
application takes a whole panel of vectors, as items of a stack. All inner products of a step, of the new panel with the
whole basis and with itself, are one aggregation, and so is their second pass (full reorthogonalisation, twice); what the
driver sees are matrices of the basis' width, whatever the core's size. A basis that has grown to WIDEST vectors is
restarted from its best Ritz vectors. Tables that later steps don't read are dropped.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.plans.grid import Grid, ravel, unravel
from fluxgrid.plans.op import Op
from fluxgrid.sources.store import Scratch

#: Vectors of a panel, and of a basis before it is restarted.
PANEL, WIDEST = 32, 384
#: Residual of an eigenvalue of the gram, relative to the largest, at which it has settled.
SETTLED = 1e-6


@dataclass(frozen=True)
class Spectrum:
    """values: the largest singular values, ascending. residuals: |gram u - t u| for the squares t, relative to the largest;
    each square lies within its residual of an exact one. upper: bounds the largest singular value from above (but for
    starts that happen to be orthogonal to its vectors). applications: of the gram, to a panel each."""

    values: np.ndarray
    residuals: np.ndarray
    upper: float
    applications: int
    settled: bool


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((len(column), 0))


def _arrays(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def _products(z: DataFrame, m: int, b: int, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """q^T w (m x b) and w^T w (b x b) over the rows of z (p, q, w), w less q before: partial matrices by task, then one sum."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + b, b))
        for batch in batches:
            q, w = _matrix(batch.column(0), m), _matrix(batch.column(1), b)
            w = w if before is None else w - q @ before
            total += np.hstack([q, w]).T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (i, j, total)], names=["i", "j", "v"])

    rows = z.select("q", "w").mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((m + b, b))
    for r in rows:
        total[r["i"], r["j"]] = r["v"]
    return total[:m], total[m:]


def _mapped(z: DataFrame, m: int, b: int, fn) -> DataFrame:
    """(p, q): fn of the matrices q and w, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(_matrix(batch.column(1), m), _matrix(batch.column(2), b))
            yield pa.RecordBatch.from_arrays([batch.column(0), _arrays(out)], names=["p", "q"])

    return z.mapInArrow(run, "p long, q array<double>")


def _noise(p: Column, b: int, seed: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda j: F.xxhash64(F.lit(seed), p, j) / float(1 << 63))


def _applied(op: Op, basis: DataFrame, b: int) -> DataFrame:
    """(p, w): op on the last b vectors of a basis (p, q)."""
    rows = basis.select("p", F.posexplode(F.slice("q", -b, b)).alias("s", "v"))
    x = Grid(rows.select(F.col("s").cast("long").alias("s"), *unravel(F.col("p"), op.dim), "v"), op.dim)
    flat = op.apply(x).df.select("s", ravel(op.codim).alias("p"), "v")
    column = lambda j: F.coalesce(F.sum(F.when(F.col("s") == j, F.col("v"))), F.lit(0.0))
    return flat.groupBy("p").agg(F.array(*map(column, range(b))).alias("w"))


def _orthonormal(s: np.ndarray, scale: float, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(t, r) with (w t)^T (w t) = 1 and w = (w t) r for w^T w = s; at most `room` directions, without those that are rounding
    next to the largest or to `scale`."""
    values, vectors = np.linalg.eigh((s + s.T) / 2)
    some = (values > max(scale * 1e-24, values[-1] * 1e-14)) & (np.arange(len(values)) >= len(values) - room)
    root = np.sqrt(values[some])
    return vectors[:, some] / root, root[:, None] * vectors[:, some].T


def largest(op: Op, spark: SparkSession, k: int = 1, most: int = 99, panel: int = PANEL, widest: int = WIDEST, settled: float = SETTLED, seed: int = 1) -> Spectrum:
    """The k largest singular values of a linear operator, by at most `most` applications of its gram or cogram."""
    gram = op.gram() if op.dim_size <= op.codim_size else op.cogram()
    n = gram.dim_size
    b = min(n, max(panel, k + 2))
    scratch = Scratch(spark)
    p = F.col("p")
    start = spark.range(n).select(F.col("id").alias("p"), F.array().cast("array<double>").alias("q"), _noise(F.col("id"), b, seed).alias("w"))
    z = scratch.write(start, "z0")
    _, s = _products(z, 0, b)
    t, _ = _orthonormal(s, 0.0, n)
    basis = _mapped(z, 0, b, lambda q, w: w @ t)
    h, last, steps = np.zeros((0, 0)), t.shape[1], 0
    m = last
    try:
        while True:
            zero = F.array_repeat(F.lit(0.0), last)
            steps += 1
            z = scratch.write(basis.join(_applied(gram, basis, last), "p", "left").select(p, "q", F.coalesce("w", zero).alias("w")), f"z{steps}")
            scratch.drop(f"z{steps - 1}")
            first, _ = _products(z, m, last)
            second, s = _products(z, m, last, first)
            grown = np.zeros((m, m))
            grown[: len(h), : len(h)] = h
            grown[:, m - last :] = first + second
            grown[m - last :, :] = grown[:, m - last :].T
            h = (grown + grown.T) / 2
            values, ritz = np.linalg.eigh(h)
            top = max(abs(values[-1]), np.finfo(float).tiny)
            t, r = _orthonormal(s - second.T @ second, top * top, n - m)
            residuals = np.linalg.norm(r @ ritz[m - last :], axis=0) / top if len(r) else np.zeros(m)
            wanted, whole = residuals[-min(k, m) :], len(r) == 0
            if m >= min(k, n) and wanted.max() <= settled or whole or steps >= most:
                break
            both = first + second
            if m + len(r) > widest:
                keep = min(m, k + b)
                chosen = ritz[:, -keep:]
                new = lambda q, w, both=both, t=t, chosen=chosen: np.hstack([q @ chosen, (w - q @ both) @ t])
                h, m = np.diag(values[-keep:]), keep
            else:
                new = lambda q, w, both=both, t=t: np.hstack([q, (w - q @ both) @ t])
            basis = _mapped(z, len(both), last, new)
            last = len(r)
            m += last
    finally:
        scratch.close()
    done = bool(whole or wanted.max() <= settled)
    if not done:
        warnings.warn(f"after {steps} applications, the squared singular values are known to {wanted.max():.1e} of the largest", stacklevel=2)
    found = np.sqrt(np.maximum(values[-k:], 0))
    found = np.concatenate([np.zeros(max(0, k - len(found))), found])
    loose = top * (1 + (residuals[-1] if done else np.linalg.norm(r, 2) / top if len(r) else 0.0))
    return Spectrum(found, wanted, min(math.sqrt(loose), op.lipschitz), steps, done)
