"""Matrices, traces, singular values and line search."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.functions.spectrum import largest
from fluxgrid.plans.grid import Grid, grid, ravel, unravel
from fluxgrid.plans.op import Op
from fluxgrid.plans.op import Property as P

#: Cores up to this size may be brought to the driver as matrices.
DENSE = 2048


def units(spark: SparkSession, shape) -> Grid:
    """An item for each unit vector."""
    n = math.prod(shape)
    return grid(spark.range(n).select(F.col("id").alias("s"), *unravel(F.col("id"), shape), F.lit(1.0).alias("v")), shape)


def asarray(op: Op, spark: SparkSession) -> DataFrame:
    """(row, col, w) with C-order places."""
    out = op.apply(units(spark, op.dim))
    return out.df.select(ravel(out.shape).alias("row"), F.col("s").alias("col"), F.col("v").alias("w"))


def trace(op: Op, spark: SparkSession) -> float:
    """Sum of the diagonal: one application to all unit vectors."""
    return float(asarray(op, spark).where("row = col").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0])


def _matrix(op: Op, spark: SparkSession) -> np.ndarray:
    if max(op.dim_size, op.codim_size) > DENSE:
        raise ValueError(f"a core of over {DENSE} places is not brought to the driver")
    rows = asarray(op, spark).toPandas()
    m = np.zeros((op.codim_size, op.dim_size))
    m[rows["row"], rows["col"]] = rows["w"]
    return m


def svdvals(op: Op, spark: SparkSession, k: int = 1) -> np.ndarray:
    """The k largest singular values, ascending: of the matrix if it is small, of the gram or cogram if one side is, else by
    block Lanczos (fluxgrid.functions.spectrum), which warns where they have not settled."""
    own = getattr(op, "own_svdvals", None)
    if own:
        return np.asarray(own(spark, k))
    if op.has(P.LINEAR_UNITARY) and op.lipschitz == 1:
        return np.ones(k)
    if max(op.dim_size, op.codim_size) <= DENSE:
        return np.sort(np.linalg.svd(_matrix(op, spark), compute_uv=False))[-k:]
    if min(op.dim_size, op.codim_size) <= DENSE:
        squares = np.linalg.eigvalsh(_matrix(op.gram() if op.dim_size <= op.codim_size else op.cogram(), spark))
    else:
        return largest(op, spark, k).values
    return np.sqrt(np.maximum(squares, 0))[-k:]


def _panel(spark: SparkSession, shape, k: int, seed: int) -> Grid:
    n = math.prod(shape)
    sign = F.when(F.pmod(F.xxhash64(F.lit(seed), "s", "p"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    rows = spark.range(n * k).select(F.floor(F.col("id") / n).alias("s"), (F.col("id") % n).alias("p")).withColumn("v", sign)
    return grid(rows.select("s", *unravel(F.col("p"), shape), "v"), shape)


def _products(x: Grid, y: Grid, k: int) -> np.ndarray:
    """k x k inner products of the items."""
    both = x.df.join(y.df.select(F.col("s").alias("q"), *x.keys[1:], F.col("v").alias("w")), x.keys[1:])
    rows = both.groupBy("s", "q").agg(F.sum(F.col("v") * F.col("w")).alias("d")).collect()
    m = np.zeros((k, k))
    for r in rows:
        m[r["s"], r["q"]] = r["d"]
    return m


def _combine(x: Grid, m: np.ndarray) -> Grid:
    """Item q of the result is the sum over s of m[s, q] x_s."""
    weights = F.array(*(F.array(*(F.lit(float(w)) for w in row)) for row in m))
    rows = x.df.select(F.posexplode(F.get(weights, F.col("s").cast("int"))).alias("q", "w"), *x.keys[1:], "v")
    return Grid(rows.select(F.col("q").cast("long").alias("s"), *x.keys[1:], (F.col("v") * F.col("w")).alias("v")), x.shape).summed()


def orthonormal(x: Grid, k: int) -> Grid:
    values, vectors = np.linalg.eigh(_products(x, x, k))
    some = values > values.max() * 1e-12
    return _combine(x, np.where(some, vectors / np.sqrt(np.where(some, values, 1)), 0.0))


def hutchpp(op: Op, spark: SparkSession, m: int = 126, seed: int = 0) -> float:
    """Stochastic trace: exact on a sketch of the range, Hutchinson's estimate on the rest. m applications."""
    k = max(1, m // 3)
    if k >= op.dim_size:
        return trace(op, spark)
    q = orthonormal(op.apply(_panel(spark, op.dim, k, seed)).written(), k).written()
    exact = float(np.trace(_products(q, op.apply(q), k)))
    g = _panel(spark, op.dim, k, seed + 1)
    inside = _combine(q, _products(q, g, k))
    rest = g.plus(inside, 1, -1).written()
    return exact + float(np.trace(_products(rest, op.apply(rest), k))) / k


def estimate_lipschitz(op: Op, spark: SparkSession, method: str = "svd", **kwargs) -> float:
    """A bound for step sizes: the spectral norm (its upper bound where the operator is large), or the Frobenius norm estimated
    by hutchpp."""
    if method == "svd":
        if min(op.dim_size, op.codim_size) <= DENSE or hasattr(op, "own_svdvals"):
            return float(svdvals(op, spark, 1)[-1])
        return largest(op, spark, 1, **kwargs).upper
    small = op.gram() if op.dim_size <= op.codim_size else op.cogram()
    return math.sqrt(max(0.0, hutchpp(small, spark, **kwargs)))


def backtracking_linesearch(f: Op, x: Grid, direction: Grid, gradient: Grid | None = None, a0: float | None = None, r: float = 0.5, c: float = 1e-4, most: int = 40) -> DataFrame:
    """(s, a): for each item the first of a0, r a0, r^2 a0... with f(x + a d) <= f(x) + c a <g, d>."""
    g = f.grad(x) if gradient is None else gradient
    a = (1 / f.diff_lipschitz if 0 < f.diff_lipschitz < math.inf else 1.0) if a0 is None else a0
    slope = g.zip(direction, lambda v, w: v * w).per_item(F.sum("v"), "slope")
    start = f.apply(x).df.select("s", F.col("v").alias("f0"))
    state = start.join(slope, "s").withColumn("a", F.lit(float(a))).withColumn("done", F.lit(False))
    from fluxgrid.sources.store import stage

    for _ in range(most):
        moved = direction.df.join(state.select("s", "a"), "s").select(*direction.keys, (F.col("v") * F.col("a")).alias("v"))
        now = f.apply(x.plus(Grid(moved, direction.shape))).df.select("s", F.col("v").alias("f1"))
        held = state.join(now, "s").withColumn("done", F.col("done") | (F.col("f1") <= F.col("f0") + c * F.col("a") * F.col("slope")))
        state = stage(held.select("s", "f0", "slope", F.when(F.col("done"), F.col("a")).otherwise(F.col("a") * r).alias("a"), "done"))
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("s", "a")
