"""Correlation and convolution with a small kernel.

The core is cut into tiles with halos in one exchange, also for a separable kernel, which goes axis by axis inside a tile.
Taps of weight 0 are left out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from fluxgrid.operators.select import MODES, Pad
from fluxgrid.operators.tiles import Pass, reach, tiled, weigh
from fluxgrid.plans.grid import Grid, as_shape
from fluxgrid.plans.op import SQUARE, Op


class Stencil(Op):
    """y[n] = sum_q k[q] x[n + q - center], x continued at the borders as `mode` has it (one for all axes, or for each).
    kernel: an array with as many axes as the core, or a list of one vector for each axis (separable)."""

    sign = 1
    weigh = staticmethod(weigh)

    def __init__(self, dim, kernel, center, mode="constant"):
        dim = as_shape(dim)
        self.kernels = [np.atleast_1d(np.asarray(k, float)) for k in kernel] if isinstance(kernel, list | tuple) and len(kernel) == len(dim) and np.ndim(kernel[0]) == 1 and len(dim) > 1 else [np.asarray(kernel, float)]
        self.separable = len(self.kernels) == len(dim) > 1
        if not self.separable and self.kernels[0].ndim != len(dim):
            raise ValueError("the kernel needs as many axes as the core")
        self.center, self.modes = as_shape(center), [mode] * len(dim) if isinstance(mode, str) else list(mode)
        if any(m not in MODES for m in self.modes):
            raise ValueError(f"unknown mode in {self.modes}")
        sizes = [len(k) for k in self.kernels] if self.separable else list(self.kernels[0].shape)
        if any(not 0 <= c < n for c, n in zip(self.center, sizes, strict=True)):
            raise ValueError("the center lies outside the kernel")
        super().__init__(dim, dim, SQUARE)
        before = [c if self.sign > 0 else n - 1 - c for c, n in zip(self.center, sizes, strict=True)]
        self.widths = [(0, 0) if m == "constant" else (b, n - 1 - b) for b, n, m in zip(before, sizes, self.modes, strict=True)]
        self.pad = Pad(dim, self.widths, self.modes) if any(w != (0, 0) for w in self.widths) else None
        self.lipschitz = float(np.prod([np.abs(k).sum() for k in self.kernels])) * (self.pad.lipschitz if self.pad else 1.0)

    def _taps(self) -> list[list[tuple[tuple[int, ...], float]]]:
        """For each pass the (offsets, weight) at which a place reads its input."""
        rank, passes = len(self.dim), []
        for axis, k in enumerate(self.kernels):
            taps = []
            for q in np.argwhere(k != 0):
                d = [0] * rank
                for j, p in enumerate(q.tolist()):
                    at = axis if self.separable else j
                    d[at] = self.sign * (p - self.center[at])
                taps.append((tuple(d), float(k[tuple(q)])))
            passes.append(taps)
        return passes

    def _to_core(self, x: Grid, sign: int) -> Grid:
        return Grid(x.df.select("s", *((F.col(f"i{k}") + sign * a).alias(f"i{k}") for k, (a, _) in enumerate(self.widths)), "v"), x.shape)

    def _correlated(self, x: Grid, passes: list[Pass], first: list[int], size) -> Grid:
        if not all(passes):
            return Grid(x.df.where("false"), tuple(size))
        weigh_ = self.weigh

        def fn(windows: np.ndarray) -> np.ndarray:
            for taps in passes:
                windows = weigh_(windows, taps)
            return windows

        return tiled(x, first, size, *reach(passes, len(self.dim)), fn)

    def apply(self, x):
        x = self._to_core(self.pad.apply(x), -1) if self.pad else x
        return self._correlated(x, self._taps(), [0] * len(self.dim), self.dim)

    def adjoint(self, y):
        back = [[(tuple(-o for o in d), w) for d, w in taps] for taps in reversed(self._taps())]
        if not self.pad:
            return self._correlated(y, back, [0] * len(self.dim), self.dim)
        spread = self._correlated(y, back, [-a for a, _ in self.widths], self.pad.codim)
        return self.pad.adjoint(self._to_core(spread, 1))


Correlate = Stencil


class Convolve(Stencil):
    """y[n] = sum_q k[q] x[n - q + center]"""

    sign = -1


def finite_difference_taps(order: int, scheme: str = "forward", accuracy: int = 1, sampling: float = 1.0) -> tuple[np.ndarray, int]:
    """Weights and center of a difference that is exact for polynomials up to its number of taps."""
    if scheme == "central":
        half = (2 * ((order + 1) // 2) - 1 + accuracy) // 2
        at = np.arange(-half, half + 1)
    elif scheme in ("forward", "backward"):
        at = np.arange(order + accuracy)
        at = at if scheme == "forward" else at - at[-1]
    else:
        raise ValueError(f"unknown scheme {scheme}")
    powers = np.array([at.astype(float) ** k for k in range(len(at))])
    want = np.zeros(len(at))
    want[order] = math.factorial(order)
    return np.linalg.solve(powers, want) / sampling**order, int(np.flatnonzero(at == 0)[0])


def gaussian_taps(sigma: float, order: int = 0, truncate: float = 3.0, sampling: float = 1.0) -> tuple[np.ndarray, int]:
    """Sampled Gaussian derivative of an order as a correlation kernel, and its center."""
    width = sigma / sampling
    radius = int(truncate * width + 0.5)
    x = np.arange(-radius, radius + 1, dtype=float)
    bell = np.exp(-0.5 * (x / width) ** 2)
    bell /= bell.sum()
    poly = np.polynomial.Polynomial([1.0])
    slope = np.polynomial.Polynomial([0.0, -1.0 / width**2])
    for _ in range(order):
        poly = poly.deriv() + poly * slope
    return (poly(x) * bell)[::-1] / sampling**order, radius
