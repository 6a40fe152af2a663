"""Conjugate gradients, linear and non-linear."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxgrid.functions.linalg import backtracking_linesearch
from fluxgrid.plans.grid import Grid, constant
from fluxgrid.plans.op import Op
from fluxgrid.solvers.base import Solver
from fluxgrid.solvers.stop import AbsError


def _ratio(a, b):
    """a / b, 0 where that is 0 / 0 (an item that is solved)."""
    return F.when(b != 0, a / b).otherwise(0.0)


class CG(Solver):
    """A x = b for positive definite A, every item a right-hand side of its own; restarts every dim_size steps."""

    def __init__(self, op: Op, **kwargs):
        super().__init__(**kwargs)
        self.op = op

    def init(self, b: Grid, x0: Grid | None = None, restart_rate: int | None = None):
        x = constant(b, b.shape, 0.0) if x0 is None else x0.dense()
        r = b.dense() if x0 is None else b.plus(self.op.apply(x), 1, -1)
        self.state.update(b=b, x=x, residual=r, direction=r)
        self.restart = restart_rate or self.op.dim_size

    def step(self):
        x, r, p = (self.state[k] for k in ("x", "residual", "direction"))
        keys = x.keys
        ap = self.op.apply(p)
        wide = x.df.withColumnRenamed("v", "x")
        for g, name in ((r, "r"), (p, "p"), (ap, "q")):
            wide = wide.join(g.df.withColumnRenamed("v", name), keys, "left")
        wide = wide.na.fill(0.0, ["r", "p", "q"])
        sums = wide.groupBy("s").agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("p") * F.col("q")).alias("pq"))
        a = _ratio(F.col("rr"), F.col("pq"))
        wide = wide.join(sums, "s").select(*keys, (F.col("x") + a * F.col("p")).alias("x"), (F.col("r") - a * F.col("q")).alias("r"), "p", "rr")
        again = wide.groupBy("s").agg(F.sum(F.col("r") * F.col("r")).alias("now"))
        beta = F.lit(0.0) if self.idx % self.restart == 0 else _ratio(F.col("now"), F.col("rr"))
        wide = wide.join(again, "s").select(*keys, "x", "r", (F.col("r") + beta * F.col("p")).alias("p"))
        self.wide(wide, x.shape, x="x", residual="r", direction="p")

    def default_stop(self):
        return AbsError(1e-4, "residual")

    def objective(self):
        x, b = self.state["x"], self.state["b"]
        half = x.zip(self.op.apply(x), lambda v, w: v * w / 2)
        return x.scalar(half.plus(x.zip(b, lambda v, w: v * w), 1, -1).per_item(F.sum("v")), F.col("t"))


class NLCG(Solver):
    """min f(x) by non-linear conjugate gradients: Polak-Ribiere (not below 0) or Fletcher-Reeves, with backtracking."""

    def __init__(self, f: Op, **kwargs):
        super().__init__(**kwargs)
        self.f = f

    def init(self, x0: Grid, variant: str = "PR", restart_rate: int | None = None, **search):
        if variant not in ("PR", "FR"):
            raise ValueError("PR or FR")
        self.variant, self.search, self.restart = variant, search, restart_rate or self.f.dim_size
        g = self.f.grad(x0)
        self.state.update(x=x0, gradient=g, direction=g.scale(-1))

    def step(self):
        x, g, p = (self.state[k] for k in ("x", "gradient", "direction"))
        a = backtracking_linesearch(self.f, x, p, g, **self.search)
        move = Grid(p.df.join(a, "s").select(*p.keys, (F.col("v") * F.col("a")).alias("v")), p.shape)
        x = self.held(x.plus(move))
        new = self.held(self.f.grad(x))
        if self.idx % self.restart == 0:
            p = new.scale(-1)
        else:
            change = new.plus(g, 1, -1) if self.variant == "PR" else new
            top = new.zip(change, lambda v, w: v * w).per_item(F.sum("v"), "top")
            low = g.per_item(F.sum(F.col("v") * F.col("v")), "low")
            beta = top.join(low, "s").select("s", F.greatest(_ratio(F.col("top"), F.col("low")), F.lit(0.0)).alias("b"))
            turned = Grid(p.df.join(beta, "s").select(*p.keys, (F.col("v") * F.col("b")).alias("v")), p.shape)
            p = turned.plus(new, 1, -1)
        self.state.update(x=x, gradient=new, direction=p)

    def default_stop(self):
        return AbsError(1e-4, "gradient")

    def objective(self):
        return self.f.apply(self.state["x"])
