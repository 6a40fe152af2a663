"""Operators side by side: stacked on one input, or each on its slice."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from fluxgrid.plans.grid import Grid, axes_of
from fluxgrid.plans.op import DIFF_MAP, LINEAR, MAP, Op
from fluxgrid.plans.op import Property as P

_BLOCK = {P.LINEAR_SELF_ADJOINT, P.LINEAR_NORMAL, P.LINEAR_UNITARY, P.LINEAR_IDEMPOTENT, P.LINEAR_POSITIVE_DEFINITE, P.LINEAR_SQUARE, P.LINEAR, P.DIFFERENTIABLE, P.CAN_EVAL}


def _lift(g: Grid, k: int) -> Grid:
    """g as the k-th slice of a new first axis."""
    return Grid(g.df.select("s", F.lit(k).cast("long").alias("i0"), *(F.col(a).alias(f"i{j + 1}") for j, a in enumerate(axes_of(g.rank))), "v"), (1, *g.shape))


def _slice(g: Grid, k: int) -> Grid:
    return Grid(g.df.where(F.col("i0") == k).select("s", *(F.col(f"i{j + 1}").alias(f"i{j}") for j in range(g.rank - 1)), "v"), g.shape[1:])


def _union(parts: list[Grid], shape) -> Grid:
    return Grid(reduce(lambda a, b: a.unionByName(b), (p.df for p in parts)), shape)


class Stack(Op):
    """x -> (A_0 x, A_1 x, ...) on a new first axis."""

    def __init__(self, ops: list[Op]):
        if len({(o.dim, o.codim) for o in ops}) != 1:
            raise ValueError("the operators need equal shapes")
        kind = LINEAR if all(o.has(P.LINEAR) for o in ops) else DIFF_MAP if all(o.has(P.DIFFERENTIABLE) for o in ops) else MAP
        super().__init__(ops[0].dim, (len(ops), *ops[0].codim), kind)
        self.ops = ops
        self.lipschitz = math.sqrt(sum(o.lipschitz**2 for o in ops))
        if not self.has(P.LINEAR):
            self.diff_lipschitz = math.sqrt(sum(o.diff_lipschitz**2 for o in ops))

    def apply(self, x):
        return _union([_lift(o.apply(x), k) for k, o in enumerate(self.ops)], self.codim)

    def adjoint(self, y):
        return _union([o.adjoint(_slice(y, k)) for k, o in enumerate(self.ops)], self.dim).summed()

    def jacobian(self, x):
        return self if self.has(P.LINEAR) else Stack([o.jacobian(x) for o in self.ops])

    def children(self):
        return tuple(self.ops)


class BlockDiag(Op):
    """The k-th operator on the k-th slice of the first axis."""

    def __init__(self, ops: list[Op]):
        if len({(o.dim, o.codim) for o in ops}) != 1:
            raise ValueError("the operators need equal shapes")
        shared = frozenset.intersection(*(o.props for o in ops)) & _BLOCK
        super().__init__((len(ops), *ops[0].dim), (len(ops), *ops[0].codim), frozenset(shared) | MAP)
        self.ops, self.lipschitz = ops, max(o.lipschitz for o in ops)
        if not self.has(P.LINEAR):
            self.diff_lipschitz = max(o.diff_lipschitz for o in ops)

    def _each(self, x: Grid, shape, how) -> Grid:
        return _union([_lift(how(o, _slice(x, k)), k) for k, o in enumerate(self.ops)], shape)

    def apply(self, x):
        return self._each(x, self.codim, lambda o, g: o.apply(g))

    def adjoint(self, y):
        return self._each(y, self.dim, lambda o, g: o.adjoint(g))

    def pinv(self, y, damp=0.0, **fit):
        return self._each(y, self.dim, lambda o, g: o.pinv(g, damp, **fit))

    def gram(self):
        return BlockDiag([o.gram() for o in self.ops])

    def cogram(self):
        return BlockDiag([o.cogram() for o in self.ops])

    def trace(self, spark, **kwargs):
        return math.fsum(o.trace(spark, **kwargs) for o in self.ops)

    def own_svdvals(self, spark, k: int = 1):
        """The k largest of the k largest of each block."""
        each = [o.svdvals(spark, min(k, o.dim_size, o.codim_size)) for o in self.ops]
        return np.sort(np.concatenate(each))[-k:]

    def asarray(self, spark):
        n, m = self.ops[0].codim_size, self.ops[0].dim_size
        parts = [o.asarray(spark).select((F.col("row") + k * n).alias("row"), (F.col("col") + k * m).alias("col"), "w") for k, o in enumerate(self.ops)]
        return reduce(lambda a, b: a.unionByName(b), parts)

    def jacobian(self, x):
        return self if self.has(P.LINEAR) else BlockDiag([o.jacobian(_slice(x, k)) for k, o in enumerate(self.ops)])

    def children(self):
        return tuple(self.ops)


def stack(ops: list[Op]) -> Op:
    return Stack(list(ops))


def block_diag(ops: list[Op]) -> Op:
    return BlockDiag(list(ops))
