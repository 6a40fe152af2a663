"""Proximal gradient descent and adaptive moments."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fluxgrid.operators.linop import NullFunc
from fluxgrid.plans.grid import Grid, constant
from fluxgrid.plans.op import Op
from fluxgrid.solvers.base import Solver
from fluxgrid.solvers.stop import RelError


def step_of(f: Op, tau: float | None) -> float:
    if tau is not None:
        return tau
    if f.diff_lipschitz == 0:
        return 1.0
    if not math.isfinite(f.diff_lipschitz):
        raise ValueError("no finite Lipschitz constant of the gradient: give tau")
    return 1 / f.diff_lipschitz


class PGD(Solver):
    """min f + g, f with a gradient, g with a prox; momentum k / (k + 1 + d)."""

    def __init__(self, f: Op | None = None, g: Op | None = None, **kwargs):
        if f is None and g is None:
            raise ValueError("f or g")
        super().__init__(**kwargs)
        self.f, self.g = f or NullFunc(g.dim), g or NullFunc(f.dim)

    def init(self, x0: Grid, tau: float | None = None, acceleration: bool = True, d: float = 75):
        self.tau, self.fast, self.d = step_of(self.f, tau), acceleration, d
        self.state.update(x=x0, x_prev=x0)

    def step(self):
        x, k = self.state["x"], self.idx - 1
        a = k / (k + 1 + self.d) if self.fast else 0.0
        y = x.plus(self.state["x_prev"], 1 + a, -a) if a else x
        z = y.plus(self.f.grad(y), 1, -self.tau)
        self.state.update(x=self.g.prox(z, self.tau), x_prev=x)

    def default_stop(self):
        return RelError(1e-4, "x")

    def objective(self):
        x = self.state["x"]
        return self.f.apply(x).plus(self.g.apply(x))


class Adam(Solver):
    """min f with adaptive moments: adam, amsgrad or padam (power p). The clipped second moment is the state."""

    def __init__(self, f: Op, **kwargs):
        super().__init__(**kwargs)
        self.f = f

    def init(self, x0: Grid, variant: str = "adam", a: float | None = None, b1: float = 0.9, b2: float = 0.999, p: float = 0.5, eps_var: float = 1e-6):
        if variant not in ("adam", "amsgrad", "padam") or not 0 < p <= 0.5:
            raise ValueError("adam, amsgrad or padam with p in (0, 0.5]")
        self.variant, self.a, self.b1, self.b2, self.p, self.eps = variant, step_of(self.f, a), b1, b2, p if variant == "padam" else 0.5, eps_var
        zero = constant(x0, x0.shape, 0.0)
        self.state.update(x=x0, mean=zero, variance=zero, variance_hat=zero)

    def step(self):
        x, keys, b1, b2 = self.state["x"], self.state["x"].keys, self.b1, self.b2
        wide = x.df.withColumnRenamed("v", "x")
        for name, g in (("g", self.f.grad(x)), ("m", self.state["mean"]), ("w", self.state["variance"]), ("h", self.state["variance_hat"])):
            # Tables of equal values are tiny as files, from which Spark would take them for small enough to broadcast.
            wide = wide.join(g.df.withColumnRenamed("v", name).hint("merge"), keys, "left")
        wide = wide.na.fill(0.0, ["g", "m", "w", "h"])
        m, w = b1 * F.col("m") + (1 - b1) * F.col("g"), F.greatest(b2 * F.col("w") + (1 - b2) * F.col("g") * F.col("g"), F.lit(self.eps))
        wide = wide.select(*keys, "x", m.alias("m"), w.alias("w"), "h")
        h = F.col("w") if self.variant == "adam" else F.greatest("h", "w")
        wide = wide.withColumn("h", h)
        if self.variant == "adam":
            lean, scale = 1 - b1**self.idx, 1 - b2**self.idx
        else:
            lean = scale = 1.0
        x_new = F.col("x") - self.a * (F.col("m") / lean) / F.pow(F.col("h") / scale, F.lit(self.p))
        self.wide(wide.withColumn("x", x_new), x.shape, x="x", mean="m", variance="w", variance_hat="h")

    def default_stop(self):
        return RelError(1e-4, "x")

    def objective(self):
        return self.f.apply(self.state["x"])
