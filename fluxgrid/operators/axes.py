"""Operators that move, merge, repeat or sum axes: arithmetic on place columns."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fluxgrid.plans.grid import Grid, as_axes, as_shape, axes_of, ravel, unravel
from fluxgrid.plans.op import LIN_FUNC, LINEAR, SQUARE, UNITARY, Op


def _moved(x: Grid, columns, shape) -> Grid:
    return Grid(x.df.select("s", *columns, "v"), shape)


class TransposeAxes(Op):
    """Axes in another order (reversed by default)."""

    lipschitz = 1.0

    def __init__(self, dim, axes=None):
        dim = as_shape(dim)
        self.axes = as_axes(axes, len(dim)) if axes is not None else tuple(reversed(range(len(dim))))
        if sorted(self.axes) != list(range(len(dim))):
            raise ValueError("axes must be a permutation")
        super().__init__(dim, tuple(dim[a] for a in self.axes), UNITARY)

    def apply(self, x):
        return _moved(x, [F.col(f"i{a}").alias(f"i{k}") for k, a in enumerate(self.axes)], self.codim)

    def adjoint(self, y):
        return _moved(y, [F.col(f"i{self.axes.index(a)}").alias(f"i{a}") for a in range(len(self.dim))], self.dim)


class SqueezeAxes(Op):
    """Without axes of one place; one axis stays at least."""

    lipschitz = 1.0

    def __init__(self, dim, axes=None):
        dim = as_shape(dim)
        drop = tuple(k for k, n in enumerate(dim) if n == 1) if axes is None else as_axes(axes, len(dim))
        if any(dim[a] != 1 for a in drop):
            raise ValueError("only axes of one place can be squeezed")
        self.keep = [k for k in range(len(dim)) if k not in drop]
        if not self.keep:
            raise ValueError("one axis must stay")
        super().__init__(dim, tuple(dim[k] for k in self.keep), UNITARY)

    def apply(self, x):
        return _moved(x, [F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(self.keep)], self.codim)

    def adjoint(self, y):
        place = {k: F.col(f"i{j}") for j, k in enumerate(self.keep)}
        return _moved(y, [place.get(k, F.lit(0).cast("long")).alias(f"i{k}") for k in range(len(self.dim))], self.dim)


class ReshapeAxes(Op):
    """The same values in C order under another shape; one length may be -1."""

    lipschitz = 1.0

    def __init__(self, dim, codim):
        dim, codim = as_shape(dim), list(as_shape(codim))
        if codim.count(-1) == 1:
            codim[codim.index(-1)] = math.prod(dim) // -math.prod(codim)
        if math.prod(codim) != math.prod(dim):
            raise ValueError(f"{dim} cannot be reshaped to {codim}")
        super().__init__(dim, codim, UNITARY)

    @staticmethod
    def _through(x: Grid, shape) -> Grid:
        flat = x.df.select("s", ravel(x.shape).alias("k"), "v")
        return Grid(flat.select("s", *unravel(F.col("k"), shape), "v"), shape)

    def apply(self, x):
        return self._through(x, self.codim)

    def adjoint(self, y):
        return self._through(y, self.dim)


def _repeat(x: Grid, columns: list, sizes: dict[int, int], shape) -> Grid:
    """Every row once for each place of the axes in `sizes`."""
    df = x.df.select("s", *columns, "v")
    for k, n in sizes.items():
        df = df.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return Grid(df.select("s", *axes_of(len(shape)), "v"), shape)


class BroadcastAxes(Op):
    """Repeats axes of one place, and adds axes in front."""

    def __init__(self, dim, codim):
        dim, codim = as_shape(dim), as_shape(codim)
        self.lead = len(codim) - len(dim)
        if self.lead < 0 or any(n not in (1, codim[self.lead + k]) for k, n in enumerate(dim)):
            raise ValueError(f"{dim} does not broadcast to {codim}")
        super().__init__(dim, codim, SQUARE if dim == codim else LINEAR)
        self.times = math.prod(codim) // math.prod(dim)
        self.lipschitz = math.sqrt(self.times)

    def apply(self, x):
        wide = {k: n for k, n in enumerate(self.codim) if k < self.lead or (self.dim[k - self.lead] == 1 and n > 1)}
        columns = [F.col(f"i{k}").alias(f"i{k + self.lead}") for k in range(len(self.dim)) if k + self.lead not in wide]
        return _repeat(x, columns, wide, self.codim)

    def adjoint(self, y):
        columns = [(F.lit(0).cast("long") if n == 1 else F.col(f"i{k + self.lead}")).alias(f"i{k}") for k, n in enumerate(self.dim)]
        return _moved(y, columns, self.dim).summed()

    def gram(self):
        from fluxgrid.operators.linop import Homothety

        return Homothety(self.dim, float(self.times))

    def pinv(self, y, damp=0.0, **fit):
        return self.adjoint(y).scale(1 / (self.times + damp))


class RechunkAxes(Op):
    """Another partitioning of the rows; the values stay."""

    lipschitz = 1.0

    def __init__(self, dim, parts: int, axes=None):
        super().__init__(dim, dim, UNITARY)
        self.parts, self.axes = parts, ["s", *(f"i{a}" for a in as_axes(axes, len(self.dim)))]

    def apply(self, x):
        return Grid(x.df.repartition(self.parts, *self.axes), x.shape)

    def adjoint(self, y):
        return y


class Sum(Op):
    """Sums over axes, which stay with one place."""

    def __init__(self, dim, axis=None):
        dim = as_shape(dim)
        self.axis = as_axes(axis, len(dim))
        codim = tuple(1 if k in self.axis else n for k, n in enumerate(dim))
        self.single = math.prod(codim) == 1
        super().__init__(dim, codim, LIN_FUNC if codim == (1,) else LINEAR)
        self.lipschitz = math.sqrt(math.prod(dim) / math.prod(codim))

    def apply(self, x):
        return _moved(x, [(F.lit(0).cast("long") if k in self.axis else F.col(f"i{k}")).alias(f"i{k}") for k in range(x.rank)], self.codim).summed()

    def adjoint(self, y):
        wide = {k: self.dim[k] for k in self.axis}
        return _repeat(y, [F.col(f"i{k}") for k in range(y.rank) if k not in wide], wide, self.dim)


def sums_over(x: Grid, axes_sets) -> "F.DataFrame":
    """Sums over several sets of axes in one pass (grouping sets); summed axes are null."""
    names = x.keys[1:]
    sets = [[n for k, n in enumerate(names) if k not in as_axes(a, x.rank)] for a in axes_sets]
    return x.df.groupingSets([[F.col("s"), *map(F.col, s)] for s in sets], F.col("s"), *map(F.col, names)).agg(F.sum("v").alias("v"))
