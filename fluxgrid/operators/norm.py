"""Norms, losses, indicators of sets and quadratics, with their proximal operators.

Values are aggregates by item; proximal operators are column expressions. Those that need an item's norm, or a threshold
among its sorted values (projection on the l1 ball, prox of l-infinity and of the squared l1 norm), take both from a
window over the item where the core has SMALL places at most. Larger items never meet in one task: norms are partial
sums joined back, thresholds are found by selection in histograms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.plans.grid import Grid, as_axes
from fluxgrid.plans.op import DIFF_FUNC, INF, PROX_FUNC, QUADRATIC, SMALL, Op, beside


def _soft(v: Column, t) -> Column:
    return F.signum(v) * F.greatest(F.abs(v) - t, F.lit(0.0))


def _by_item(x: Grid, aggregate, value, name: str = "t") -> Grid:
    """v -> value(v, t), t an aggregate of the item."""
    rows = beside(x.df, ["s"], x.size, **{name: aggregate})
    return Grid(rows.select(*x.keys, value(F.col("v"), F.col(name)).cast("double").alias("v")), x.shape)


def _bracket(x: DataFrame, bin_: Column, rule, known: DataFrame | None) -> DataFrame:
    """(s, bin, k0, c0): in each item the bin of values in which the rule begins to fail, with the number and the sum of the
    values above; bin is null where it fails nowhere. One aggregation; bins are few whatever the item's size."""
    bins = x.groupBy("s", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("sum"), F.min("u").alias("low"))
    down = Window.partitionBy("s").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    k, c = F.sum("n").over(down), F.sum("sum").over(down)
    if known is not None:
        bins = bins.join(known, "s")
        k, c = k + F.col("k0"), c + F.col("c0")
    held = bins.select("*", k.alias("k"), c.alias("c")).withColumn("holds", F.col("low") > rule(F.col("k").cast("double"), F.col("c")))
    first = [F.lit(0.0) if known is None else F.first(name) for name in ("k0", "c0")]
    above = [F.coalesce(F.max(F.when(F.col("holds"), F.struct("k", "c")))[name], start) for name, start in zip("kc", first, strict=True)]
    return held.groupBy("s").agg(F.max(F.when(~F.col("holds"), F.col("bin"))).alias("bin"), above[0].cast("double").alias("k0"), above[1].alias("c0"))


def _thresholds(x: Grid, rule) -> DataFrame:
    """(s, t, n1): rule gives, for the number k and the sum c of the k largest absolute values, the threshold that holds if
    the k-th is above it; t is that of the largest such k, and n1 the sum of all.

    Selection by histograms: 256 bins for each power of two, then 4,096 bins inside the one where the rule begins to fail; only
    the distinct values of one of those are put in order."""
    plain = x.df.select("s", F.abs("v").alias("u")).where("u > 0")
    scale = F.floor(F.log2("u") * 256)
    one = _bracket(plain, scale, rule, None)
    inside = plain.join(one.where("bin is not null").withColumnRenamed("bin", "at"), "s").where(scale == F.col("at"))
    edge = F.pow(F.lit(2.0), F.col("at") / 256)
    fine = F.floor((F.col("u") / edge - 1) * (4096 * 256))
    two = _bracket(inside.select("s", "u", "at"), fine, rule, one.select("s", "k0", "c0"))
    few = inside.select("s", "u", fine.alias("fine")).join(two.where("bin is not null"), "s").where(F.col("fine") == F.col("bin"))
    values = few.groupBy("s", "u").agg(F.count(F.lit(1)).alias("n"), F.first("k0").alias("k0"), F.first("c0").alias("c0"))
    down = Window.partitionBy("s").orderBy(F.desc("u")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.select("s", "u", (F.col("k0") + F.sum("n").over(down)).alias("k"), (F.col("c0") + F.sum(F.col("u") * F.col("n")).over(down)).alias("c"))
    last = ranked.where(F.col("u") > rule(F.col("k"), F.col("c"))).groupBy("s").agg(F.max(F.struct("k", "c")).alias("last")).select("s", "last.k", "last.c")
    ends = one.select("s", "k0", "c0").unionByName(two.select("s", "k0", "c0")).unionByName(last.select("s", F.col("k").alias("k0"), F.col("c").alias("c0")))
    final = ends.groupBy("s").agg(F.max(F.struct("k0", "c0")).alias("e")).select("s", F.col("e.k0").alias("k"), F.col("e.c0").alias("c"))
    total = x.df.groupBy("s").agg(F.sum(F.abs("v")).alias("n1"))
    t = F.when(F.col("k") > 0, rule(F.col("k"), F.col("c"))).otherwise(F.lit(0.0))
    return total.join(final, "s", "left").select("s", F.coalesce(t, F.lit(0.0)).alias("t"), "n1")


def _sorted_threshold(x: Grid, rule) -> DataFrame:
    """x with t and n1 of its item: from one sorted window where a core is small, else by selection."""
    if x.size > SMALL:
        return x.df.join(_thresholds(x, rule), "s")
    down = Window.partitionBy("s").orderBy(F.desc("__u"), *x.keys[1:])
    ranked = x.df.withColumn("__u", F.abs("v")).withColumn("__k", F.row_number().over(down)).withColumn("__c", F.sum("__u").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    theta = rule(F.col("__k").cast("double"), F.col("__c"))
    whole = Window.partitionBy("s")
    found = ranked.withColumn("__t", theta).withColumn("__last", F.max(F.when(F.col("__u") > F.col("__t"), F.struct("__k", "__t"))).over(whole))
    return found.withColumn("t", F.coalesce(F.col("__last.__t"), F.lit(0.0))).withColumn("n1", F.sum("__u").over(whole))


class Functional(Op):
    def __init__(self, dim, props=PROX_FUNC):
        super().__init__(dim, (1,), props)

    def value(self, v: Column) -> Column:
        """The aggregate of an item's values."""
        raise NotImplementedError

    def apply(self, x):
        return x.scalar(x.per_item(self.value(F.col("v"))), F.col("t"))


class L1Norm(Functional):
    def __init__(self, dim):
        super().__init__(dim)
        self.lipschitz = math.sqrt(self.dim_size)

    def value(self, v):
        return F.sum(F.abs(v))

    def prox(self, x, tau):
        return x.map(lambda v: _soft(v, F.lit(float(tau))))


class PositiveL1Norm(L1Norm):
    """The l1 norm of non-negative values, infinite elsewhere."""

    def __init__(self, dim):
        super().__init__(dim)
        self.lipschitz = INF

    def value(self, v):
        return F.when(F.min(F.when(v >= 0, 1).otherwise(0)) == 1, F.sum(v)).otherwise(F.lit(INF))

    def prox(self, x, tau):
        return x.map(lambda v: F.greatest(v - float(tau), F.lit(0.0)))


class L2Norm(Functional):
    lipschitz = 1.0

    def value(self, v):
        return F.sqrt(F.sum(v * v))

    def prox(self, x, tau):
        return _by_item(x, F.sum(F.col("v") * F.col("v")), lambda v, t: v * (1 - tau / F.greatest(F.sqrt(t), F.lit(float(tau)))))


class SquaredL2Norm(Functional):
    diff_lipschitz = 2.0

    def __init__(self, dim):
        super().__init__(dim, QUADRATIC)

    def value(self, v):
        return F.sum(v * v)

    def grad(self, x):
        return x.scale(2.0)

    def prox(self, x, tau):
        return x.scale(1 / (1 + 2 * tau))

    def quad_spec(self):
        from fluxgrid.operators.linop import Homothety

        return Homothety(self.dim, 2.0), None, 0.0


class SquaredL1Norm(Functional):
    def value(self, v):
        return F.pow(F.sum(F.abs(v)), F.lit(2.0))

    def prox(self, x, tau):
        rows = _sorted_threshold(x, lambda k, c: 2 * tau * c / (1 + 2 * tau * k))
        return Grid(rows.select(*x.keys, _soft(F.col("v"), F.col("t")).alias("v")), x.shape)


def project_l1(x: Grid, radius: float) -> Grid:
    """The nearest point of the l1 ball."""
    rows = _sorted_threshold(x, lambda k, c: (c - radius) / k)
    return Grid(rows.select(*x.keys, F.when(F.col("n1") <= radius, F.col("v")).otherwise(_soft(F.col("v"), F.col("t"))).alias("v")), x.shape)


class LInfinityNorm(Functional):
    lipschitz = 1.0

    def value(self, v):
        return F.max(F.abs(v))

    def prox(self, x, tau):
        return x.zip(project_l1(x, tau), lambda v, w: v - w)


class L21Norm(Functional):
    """Sum, over the other axes, of the l2 norms along l2_axis."""

    def __init__(self, dim, l2_axis=(0,)):
        super().__init__(dim)
        if len(self.dim) < 2:
            raise ValueError("two axes at least")
        self.inner = as_axes(l2_axis, len(self.dim))
        self.outer = [f"i{k}" for k in range(len(self.dim)) if k not in self.inner]
        self.lipschitz = math.sqrt(math.prod(n for k, n in enumerate(self.dim) if k not in self.inner))

    def apply(self, x):
        norms = x.df.groupBy("s", *self.outer).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
        return x.scalar(norms.groupBy("s").agg(F.sum("n").alias("t")), F.col("t"))

    def prox(self, x, tau):
        cells = math.prod(self.dim[k] for k in self.inner)
        rows = beside(x.df, ["s", *self.outer], cells, n=F.sum(F.col("v") * F.col("v")))
        return Grid(rows.select(*x.keys, (F.col("v") * (1 - tau / F.greatest(F.sqrt("n"), F.lit(float(tau))))).alias("v")), x.shape)


class KLDivergence(Functional):
    """sum of y ln(y / x) - y + x for data y >= 0 (a Grid with one item): x where y is 0; infinite where x is too small."""

    def __init__(self, data: Grid):
        super().__init__(data.shape)
        self.data = data

    def _joined(self, x: Grid):
        axes = x.keys[1:]
        return x.dense().df.join(self.data.df.select(*axes, F.col("v").alias("y")), axes, "left").withColumn("y", F.coalesce("y", F.lit(0.0)))

    def apply(self, x):
        v, y = F.col("v"), F.col("y")
        term = F.when((y > 0) & (v > 0), y * F.ln(y / F.when(v > 0, v)) - y + v).when((y == 0) & (v >= 0), v).otherwise(F.lit(INF))
        return x.scalar(self._joined(x).groupBy("s").agg(F.sum(term).alias("t")), F.col("t"))

    def prox(self, x, tau):
        m = F.col("v") - float(tau)
        return Grid(self._joined(x).select(*x.keys, ((m + F.sqrt(m * m + 4 * tau * F.col("y"))) / 2).alias("v")), x.shape)


class Indicator(Functional):
    """0 inside a set, infinite outside; prox is the projection, whatever tau is."""

    def inside(self, x: Grid):
        """(s, t): whether each item lies in the set."""
        raise NotImplementedError

    def apply(self, x):
        return x.scalar(self.inside(x), F.when(F.col("t"), 0.0).otherwise(F.lit(INF)))


class L1Ball(Indicator):
    def __init__(self, dim, radius: float = 1.0):
        super().__init__(dim)
        self.radius = float(radius)

    def inside(self, x):
        return x.per_item(F.sum(F.abs("v")) <= self.radius)

    def prox(self, x, tau=1.0):
        return project_l1(x, self.radius)


class L2Ball(L1Ball):
    def inside(self, x):
        return x.per_item(F.sqrt(F.sum(F.col("v") * F.col("v"))) <= self.radius)

    def prox(self, x, tau=1.0):
        r = self.radius
        return _by_item(x, F.sum(F.col("v") * F.col("v")), lambda v, t: v * r / F.greatest(F.sqrt(t), F.lit(r)))


class LInfinityBall(L1Ball):
    def inside(self, x):
        return x.per_item(F.max(F.abs("v")) <= self.radius)

    def prox(self, x, tau=1.0):
        return x.map(lambda v: F.greatest(F.lit(-self.radius), F.least(F.lit(self.radius), v)))


class PositiveOrthant(Indicator):
    def inside(self, x):
        return x.per_item(F.bool_and((F.col("v") >= 0) & ~F.isnan("v")))

    def prox(self, x, tau=1.0):
        return x.map(lambda v: F.greatest(v, F.lit(0.0)))


class HyperSlab(Indicator):
    """low <= <a, x> <= high; a (a Grid with one item) and the bounds are divided by the norm of a."""

    def __init__(self, a: Grid, low: float, high: float):
        if low >= high:
            raise ValueError("low must be below high")
        super().__init__(a.shape)
        self.a, self.low, self.high = a, float(low), float(high)

    def _dots(self, x: Grid):
        axes = x.keys[1:]
        return x.df.join(self.a.df.select(*axes, F.col("v").alias("w")), axes)

    def inside(self, x):
        dot = F.sum(F.col("v") * F.col("w"))
        return self._dots(x).groupBy("s").agg(((dot >= self.low) & (dot <= self.high)).alias("t"))

    def prox(self, x, tau=1.0):
        rows = beside(self._dots(x), ["s"], x.size, dot=F.sum(F.col("v") * F.col("w")), n=F.sum(F.col("w") * F.col("w")))
        move = F.when(F.col("dot") < self.low, self.low - F.col("dot")).when(F.col("dot") > self.high, self.high - F.col("dot")).otherwise(0.0)
        return Grid(rows.select(*x.keys, (F.col("v") + move * F.col("w") / F.col("n")).alias("v")), x.shape)


class RangeSet(Indicator):
    """The range of a linear operator; projection by its pseudo-inverse."""

    def __init__(self, op: Op, tolerance: float = 1e-4):
        super().__init__(op.codim)
        self.op, self.tolerance = op, tolerance

    def prox(self, x, tau=1.0):
        return self.op.apply(self.op.pinv(x))

    def inside(self, x):
        gap = x.zip(self.prox(x), lambda v, w: F.abs(v - w))
        return gap.per_item(F.max("v") <= self.tolerance)


class QuadraticFunc(Functional):
    """<x, Q x> / 2 + c(x) + t with Q positive; prox by conjugate gradients on Q + 1 / tau."""

    def __init__(self, dim, q: Op | None = None, c: Op | None = None, t: float = 0.0):
        from fluxgrid.operators.linop import Identity

        super().__init__(dim, QUADRATIC)
        self.q, self.c, self.t = q or Identity(dim), c, float(t)
        self.diff_lipschitz = self.q.lipschitz

    def apply(self, x):
        half = x.zip(self.q.apply(x), lambda v, w: v * w / 2)
        out = x.scalar(half.per_item(F.sum("v")), F.col("t"))
        out = out.plus(self.c.apply(x)) if self.c else out
        return out.map(lambda v: v + self.t) if self.t else out

    def grad(self, x):
        g = self.q.apply(x)
        return g.plus(self.c.grad(x)) if self.c else g

    def prox(self, x, tau):
        from fluxgrid.operators.linop import Homothety
        from fluxgrid.solvers.cg import CG
        from fluxgrid.solvers.stop import MaxIter

        b = x.scale(1 / tau)
        b = b.plus(self.c.grad(x), 1, -1) if self.c else b
        solver = CG(self.q + Homothety(self.dim, 1 / tau))
        return solver.fit(b=b, stop=solver.default_stop() | MaxIter(2 * self.dim_size)).solution()

    def quad_spec(self):
        return self.q, self.c, self.t


class MoreauEnvelope(Functional):
    """f smoothed: min over z of f(z) + |x - z|^2 / (2 mu)"""

    def __init__(self, f: Op, mu: float):
        super().__init__(f.dim, DIFF_FUNC)
        self.f, self.mu, self.diff_lipschitz = f, float(mu), 1 / float(mu)
        self.lipschitz = f.lipschitz

    def apply(self, x):
        p = self.f.prox(x, self.mu)
        gap = x.zip(p, lambda v, w: (v - w) * (v - w) / (2 * self.mu))
        return self.f.apply(p).plus(x.scalar(gap.per_item(F.sum("v")), F.col("t")))

    def grad(self, x):
        return x.plus(self.f.prox(x, self.mu), 1 / self.mu, -1 / self.mu)
