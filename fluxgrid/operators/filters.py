"""Smoothing, edge and structure filters."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import functions as F

from fluxgrid.operators.stencil import Stencil, gaussian_taps
from fluxgrid.plans.grid import Grid, as_axes, as_shape
from fluxgrid.plans.op import DIFF_MAP, Op


def per_axis(value, rank: int) -> list:
    return list(value) if isinstance(value, list | tuple) else [value] * rank


def separable(dim, kernels: list, centers: list[int], mode) -> Op:
    """A Stencil of one kernel for each axis; kernels of a single 1 cost nothing."""
    if len(dim) == 1:
        return Stencil(dim, kernels[0], centers, mode)
    return Stencil(dim, [np.atleast_1d(np.asarray(k, float)) for k in kernels], centers, mode)


def MovingAverage(dim, size, center=None, mode="constant") -> Op:  # noqa: N802
    """Mean of a box; outside counts as the mode has it. Even sizes need a center."""
    dim = as_shape(dim)
    size = per_axis(size, len(dim))
    if center is None and any(n % 2 == 0 for n in size):
        raise ValueError("even sizes need a center")
    center = [n // 2 for n in size] if center is None else per_axis(center, len(dim))
    return separable(dim, [np.ones(n) / n for n in size], center, mode)


def GaussianFilter(dim, sigma=1.0, truncate=3.0, order=0, mode="constant", sampling=1) -> Op:  # noqa: N802
    """Gaussian smoothing, or its derivative of an order for each axis."""
    dim = as_shape(dim)
    taps = [gaussian_taps(*p) for p in zip(*(per_axis(v, len(dim)) for v in (sigma, order, truncate, sampling)), strict=True)]
    return separable(dim, [k for k, _ in taps], [c for _, c in taps], mode)


def DifferenceOfGaussians(dim, low_sigma=1.0, high_sigma=None, low_truncate=3.0, high_truncate=3.0, mode="constant", sampling=1) -> Op:  # noqa: N802
    """A narrow Gaussian less a wide one (1.6 times by default)."""
    dim = as_shape(dim)
    high = [1.6 * s for s in per_axis(low_sigma, len(dim))] if high_sigma is None else high_sigma
    return GaussianFilter(dim, low_sigma, low_truncate, 0, mode, sampling) - GaussianFilter(dim, high, high_truncate, 0, mode, sampling)


DoG = DifferenceOfGaussians


def _one_axis(dim, axis: int, kernel, center: int, mode) -> Op:
    shape = [1] * len(dim)
    shape[axis] = len(kernel)
    return Stencil(dim, np.asarray(kernel, float).reshape(shape), [center if k == axis else 0 for k in range(len(dim))], mode)


def Laplace(dim, mode="constant", sampling=1) -> Op:  # noqa: N802
    """Sum of second differences, each divided by its sampling (not squared)."""
    dim = as_shape(dim)
    steps = per_axis(sampling, len(dim))
    return reduce(lambda a, b: a + b, (_one_axis(dim, k, np.array([1.0, -2.0, 1.0]) / steps[k], 1, mode) for k in range(len(dim))))


def _edges(dim, smooth: list[float], axis, mode, sampling) -> Op:
    """First differences of step 2 smoothed across; of several axes the root of the sum of squares over sqrt(rank)."""
    from fluxgrid.operators.maps import Sqrt, Square

    dim = as_shape(dim)
    steps, axes = per_axis(sampling, len(dim)), as_axes(axis, len(dim))
    ops = [separable(dim, [np.array([-1.0, 0.0, 1.0] if k == a else smooth) / steps[k] for k in range(len(dim))], [1] * len(dim), mode) for a in axes]
    if len(ops) == 1:
        return ops[0]
    return (Sqrt(dim) * reduce(lambda a, b: a + b, (Square(dim) * o for o in ops))) * (1 / math.sqrt(len(dim)))


def Sobel(dim, axis=None, mode="constant", sampling=1) -> Op:  # noqa: N802
    return _edges(dim, [0.25, 0.5, 0.25], axis, mode, sampling)


def Prewitt(dim, axis=None, mode="constant", sampling=1) -> Op:  # noqa: N802
    return _edges(dim, [1 / 3, 1 / 3, 1 / 3], axis, mode, sampling)


def Scharr(dim, axis=None, mode="constant", sampling=1) -> Op:  # noqa: N802
    return _edges(dim, [3 / 16, 10 / 16, 3 / 16], axis, mode, sampling)


class StructureTensor(Op):
    """Products of first derivatives, one for each pair of axes in order, smoothed: (rank (rank + 1) / 2, *dim)."""

    def __init__(self, dim, method="fd", smooth_sigma=1.0, smooth_truncate=3.0, mode="constant", sampling=1, **options):
        from fluxgrid.operators.diff import Gradient

        dim = as_shape(dim)
        self.pairs = list(combinations_with_replacement(range(len(dim)), 2))
        super().__init__(dim, (len(self.pairs), *dim), DIFF_MAP)
        if method == "fd":
            options.setdefault("scheme", "central")
        self.slopes = Gradient(dim, method=method, mode=mode, sampling=sampling, **options)
        self.smooth = GaussianFilter(dim, smooth_sigma, smooth_truncate, 0, mode, sampling) if smooth_sigma else None

    def apply(self, x):
        rank = x.rank
        slopes = self.slopes.apply(x).df
        axes = [F.col(f"i{k + 1}").alias(f"i{k}") for k in range(rank)]
        # One row for each place with all slopes, then a row for each pair.
        wide = slopes.groupBy("s", *axes).agg(*(F.sum(F.when(F.col("i0") == k, F.col("v")).otherwise(0.0)).alias(f"g{k}") for k in range(rank)))
        products = F.array(*(F.col(f"g{a}") * F.col(f"g{b}") for a, b in self.pairs))
        rows = wide.select("s", *x.keys[1:], F.posexplode(products).alias("pair", "v"))
        if self.smooth is None:
            out = rows.select("s", "pair", *x.keys[1:], "v")
        else:
            # The pair rides along in the stack key.
            n = len(self.pairs)
            packed = Grid(rows.select((F.col("s") * n + F.col("pair")).alias("s"), *x.keys[1:], "v"), x.shape)
            done = self.smooth.apply(packed).df
            out = done.select(F.floor(F.col("s") / n).alias("s"), F.pmod("s", F.lit(n)).alias("pair"), *x.keys[1:], "v")
        return Grid(out.select("s", F.col("pair").cast("long").alias("i0"), *(F.col(f"i{k}").alias(f"i{k + 1}") for k in range(rank)), "v"), self.codim)
