"""Langevin samplers: unadjusted, and with a proximable term through its Moreau envelope."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxgrid.operators.linop import NullFunc
from fluxgrid.plans.grid import Grid
from fluxgrid.plans.op import Op


def _uniform(*parts: Column) -> Column:
    """In (0, 1], from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 1) / float(1 << 52)


def normal(keys: list[str], seed: int, step: int) -> Column:
    """A standard normal number for each row that depends on the seed, the step and the row's keys alone."""
    parts = [F.lit(seed), F.lit(step), *map(F.col, keys)]
    return F.sqrt(-2 * F.ln(_uniform(F.lit(0), *parts))) * F.cos(2 * math.pi * _uniform(F.lit(1), *parts))


class ULA:
    """x <- x - gamma grad f(x) + sqrt(2 gamma) N(0, 1); every item is a chain. gamma is 0.98 / dL by default."""

    def __init__(self, f: Op, gamma: float | None = None):
        self.f, self.beta = f, f.diff_lipschitz
        if gamma is None:
            if not 0 < self.beta < math.inf:
                raise ValueError("no finite Lipschitz constant of the gradient: give gamma")
            gamma = 0.98 / self.beta
        self.gamma = gamma

    def drift(self, x: Grid) -> Grid:
        return self.f.grad(x)

    def samples(self, x0: Grid, seed: int = 0) -> Iterator[Grid]:
        """States without end; the same seed gives the same chain on any cluster."""
        x, k = x0.dense().written(), 0
        while True:
            moved = x.plus(self.drift(x), 1, -self.gamma)
            noise = normal(moved.keys, seed, k) * math.sqrt(2 * self.gamma)
            x = Grid(moved.df.select(*moved.keys, (F.col("v") + noise).alias("v")), x.shape).written()
            k += 1
            yield x

    def objective(self, x: Grid) -> Grid:
        return self.f.apply(x)


class MYULA(ULA):
    """ULA on f + the Moreau envelope of g; lambda is min(2, 1 / dL) by default."""

    def __init__(self, f: Op | None = None, g: Op | None = None, gamma: float | None = None, lamb: float | None = None):
        if f is None and g is None:
            raise ValueError("f or g")
        self.g = g
        f = f or NullFunc(g.dim)
        dl = f.diff_lipschitz
        self.lamb = lamb or (min(2.0, 1 / dl) if 0 < dl < math.inf else 2.0)
        total = dl + (1 / self.lamb if g else 0.0)
        super().__init__(f, gamma if gamma is not None else 0.98 / total)

    def drift(self, x):
        g = self.f.grad(x)
        return g.plus(x.plus(self.g.prox(x, self.lamb), 1 / self.lamb, -1 / self.lamb)) if self.g else g

    def objective(self, x):
        out = self.f.apply(x)
        return out.plus(self.g.apply(x)) if self.g else out
