"""Derivatives by finite differences (fd) or Gaussian derivatives (gd), and what is built from them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import functions as F

from fluxgrid.operators.axes import SqueezeAxes, Sum
from fluxgrid.operators.blocks import BlockDiag, Stack
from fluxgrid.operators.filters import per_axis, separable
from fluxgrid.operators.linop import Diagonal
from fluxgrid.operators.stencil import finite_difference_taps, gaussian_taps
from fluxgrid.plans.grid import Grid, as_axes, as_shape
from fluxgrid.plans.op import Op


def finite_difference(dim, order, scheme="forward", accuracy=1, mode="constant", sampling=1) -> Op:
    """Mixed partial derivative: an order for each axis."""
    dim = as_shape(dim)
    order = list(order) if isinstance(order, Sequence) else [order] * len(dim)
    taps = [finite_difference_taps(o, s, a, h) if o else (np.ones(1), 0) for o, s, a, h in zip(order, per_axis(scheme, len(dim)), per_axis(accuracy, len(dim)), per_axis(sampling, len(dim)), strict=True)]
    return separable(dim, [k for k, _ in taps], [c for _, c in taps], mode)


def gaussian_derivative(dim, order, sigma=1.0, truncate=3.0, mode="constant", sampling=1) -> Op:
    """The same with kernels that differentiate a Gaussian; axes of order 0 are smoothed only if another one is not."""
    dim = as_shape(dim)
    order = list(order) if isinstance(order, Sequence) else [order] * len(dim)
    taps = [gaussian_taps(s, o, t, h) for o, s, t, h in zip(order, per_axis(sigma, len(dim)), per_axis(truncate, len(dim)), per_axis(sampling, len(dim)), strict=True)]
    return separable(dim, [k for k, _ in taps], [c for _, c in taps], mode)


def _partial(dim, order: list[int], method: str, mode, sampling, options: dict) -> Op:
    if method == "fd":
        return finite_difference(dim, order, options.get("scheme", "forward"), options.get("accuracy", 1), mode, sampling)
    if method == "gd":
        taps = [gaussian_taps(s, o, t, h) if o else (np.ones(1), 0) for o, s, t, h in zip(order, per_axis(options.get("sigma", 1.0), len(dim)), per_axis(options.get("truncate", 3.0), len(dim)), per_axis(sampling, len(dim)), strict=True)]
        return separable(dim, [k for k, _ in taps], [c for _, c in taps], mode)
    raise ValueError(f"unknown method {method}")


def _orders(rank: int, *axes: int) -> list[int]:
    return [axes.count(k) for k in range(rank)]


def Gradient(dim, directions=None, method="fd", mode="constant", sampling=1, **options) -> Op:  # noqa: N802
    """First partial derivatives on a new first axis; forward differences by default."""
    dim = as_shape(dim)
    return Stack([_partial(dim, _orders(len(dim), a), method, mode, sampling, options) for a in as_axes(directions, len(dim))])


def pairs_of(directions, rank: int) -> list[tuple[int, int]]:
    """Pairs of axes: "all" (upper triangle), one axis, a pair, or several pairs."""
    if isinstance(directions, str):
        return list(combinations_with_replacement(range(rank), 2))
    if isinstance(directions, int):
        return [(directions, directions)]
    if all(isinstance(d, int) for d in directions):
        return [tuple(as_axes(directions, rank))]
    return [tuple(as_axes(d, rank)) for d in directions]


def Hessian(dim, directions="all", method="fd", mode="constant", sampling=1, **options) -> Op:  # noqa: N802
    """Second partial derivatives on a new first axis; on the diagonal central, off it forward differences by default."""
    dim = as_shape(dim)
    ops = []
    for a, b in pairs_of(directions, len(dim)):
        own = {"scheme": "central" if a == b else "forward"} | options if method == "fd" else options
        ops.append(_partial(dim, _orders(len(dim), a, b), method, mode, sampling, own))
    return Stack(ops)


def Jacobian(dim, directions=None, method="fd", mode="constant", sampling=1, **options) -> Op:  # noqa: N802
    """The gradient of each channel; the first axis counts channels, directions begin at 1."""
    dim = as_shape(dim)
    inner = None if directions is None else [d - 1 for d in (directions if isinstance(directions, Sequence) else [directions])]
    return BlockDiag([Gradient(dim[1:], inner, method, mode, sampling, **options) for _ in range(dim[0])])


_TURNED = {"central": "central", "forward": "backward", "backward": "forward"}


def Divergence(dim, directions=None, method="fd", mode="constant", sampling=1, **options) -> Op:  # noqa: N802
    """Sum of the derivatives of each component along its axis; forward and backward change places, central by default."""
    dim = as_shape(dim)
    directions = [k + 1 for k in range(len(dim) - 1)] if directions is None else list(directions)
    if method == "fd":
        options = options | {"scheme": _TURNED[options.get("scheme", "central")]}
    parts = [_partial(dim[1:], _orders(len(dim) - 1, d - 1), method, mode, sampling, options) for d in directions]
    inner = BlockDiag(parts)
    return SqueezeAxes((1, *dim[1:]), 0) * Sum(inner.codim, 0) * inner


def Laplacian(dim, directions=None, method="fd", mode="constant", sampling=1, **options) -> Op:  # noqa: N802
    """Sum of second derivatives along some axes (all by default)."""
    dim = as_shape(dim)
    if method == "fd":
        options = {"scheme": "central"} | options
    ops = [_partial(dim, _orders(len(dim), a, a), method, mode, sampling, options) for a in as_axes(directions, len(dim))]
    return reduce(lambda a, b: a + b, ops)


def _unit(direction, rank: int):
    """A constant direction as a unit vector, or a Grid (rank, *dim) with unit vectors place by place."""
    if isinstance(direction, Grid):
        rows = direction.df
        axes = [f"i{k + 1}" for k in range(rank)]
        square = rows.groupBy(*axes).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
        return Grid(rows.join(square, axes).select("s", "i0", *axes, (F.col("v") / F.col("n")).alias("v")), direction.shape)
    d = np.asarray(direction, float)
    return d / np.linalg.norm(d)


def _times(op: Op, weight) -> Op:
    return op * float(weight) if isinstance(weight, float | int) else Diagonal(weight, shared=True) * op


def _component(unit, k: int):
    if not isinstance(unit, Grid):
        return float(unit[k])
    rows = unit.df.where(F.col("i0") == k)
    return Grid(rows.select("s", *(F.col(f"i{j + 1}").alias(f"i{j}") for j in range(unit.rank - 1)), "v"), unit.shape[1:])


def _product(a, b):
    if not isinstance(a, Grid) and not isinstance(b, Grid):
        return a * b
    a, b = (b, a) if not isinstance(a, Grid) else (a, b)
    if not isinstance(b, Grid):
        return a.scale(b)
    return a.zip(b, lambda v, w: v * w)


def _sum(ops: list[Op]) -> Op:
    return reduce(lambda a, b: a + b, ops)


def DirectionalDerivative(dim, order, directions, method="fd", mode="constant", sampling=1, **options) -> Op:  # noqa: N802
    """First (<gradient, d>) or second (d^T H d, or d^T H e for two directions) derivative along unit directions."""
    dim = as_shape(dim)
    rank = len(dim)
    if order == 1:
        unit = _unit(directions, rank)
        return _sum([_times(_partial(dim, _orders(rank, k), method, mode, sampling, options), _component(unit, k)) for k in range(rank)])
    if order != 2:
        raise ValueError("order 1 or 2")
    two = isinstance(directions, tuple) and len(directions) == 2 and not all(isinstance(d, int | float) for d in directions)
    a, b = (_unit(d, rank) for d in (directions if two else (directions, directions)))
    ops = []
    for i, j in combinations_with_replacement(range(rank), 2):
        own = {"scheme": "central" if i == j else "forward"} | options if method == "fd" else options
        weight = _product(_component(a, i), _component(b, j))
        weight = weight if i == j else (weight.scale(2.0) if isinstance(weight, Grid) else 2 * weight)
        ops.append(_times(_partial(dim, _orders(rank, i, j), method, mode, sampling, own), weight))
    return _sum(ops)


def DirectionalGradient(dim, directions, method="fd", mode="constant", sampling=1, **options) -> Op:  # noqa: N802
    """First derivatives along several directions, on a new first axis."""
    return Stack([DirectionalDerivative(dim, 1, d, method, mode, sampling, **options) for d in directions])


def DirectionalLaplacian(dim, directions, weights=None, method="fd", mode="constant", sampling=1, **options) -> Op:  # noqa: N802
    """Weighted sum of second derivatives along directions."""
    weights = [1.0] * len(directions) if weights is None else weights
    return _sum([DirectionalDerivative(dim, 2, d, method, mode, sampling, **options) * float(w) for d, w in zip(directions, weights, strict=True)])


def DirectionalHessian(dim, directions, method="gd", mode="constant", sampling=1, **options) -> Op:  # noqa: N802
    """Second derivatives along every pair of directions in order, on a new first axis; Gaussian derivatives by default."""
    return Stack([DirectionalDerivative(dim, 2, (a, b), method, mode, sampling, **options) for a, b in combinations_with_replacement(directions, 2)])


_ = math
