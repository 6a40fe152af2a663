"""Primal-dual splitting for min f(x) + g(x) + h(K x): f smooth, g and h proximable, K linear."""

from __future__ import annotations

import math

from fluxgrid.operators.linop import Homothety, Identity, Null, NullFunc
from fluxgrid.operators.norm import SquaredL2Norm
from fluxgrid.plans.grid import Grid, constant
from fluxgrid.plans.op import Op
from fluxgrid.plans.op import Property as P
from fluxgrid.solvers.base import Solver
from fluxgrid.solvers.cg import CG, NLCG
from fluxgrid.solvers.stop import MaxIter, RelError


class PrimalDual(Solver):
    """tau and sigma are chosen from the constants of f and K unless given. tuning 1-3: gamma = beta, beta / 1.9 or beta,
    and for 3 the largest relaxation rho = delta - 0.1 instead of 1."""

    def __init__(self, f: Op | None = None, g: Op | None = None, h: Op | None = None, K: Op | None = None, beta: float | None = None, **kwargs):  # noqa: N803
        super().__init__(**kwargs)
        some = f or g or h
        if some is None:
            raise ValueError("one function at least")
        dim = f.dim if f else g.dim if g else K.dim if K else h.dim
        self.has_h = h is not None
        self.f, self.g = f or NullFunc(dim), g or NullFunc(dim)
        self.K = K or Identity(dim) if h is not None else Null(dim, dim)
        self.h = h or NullFunc(self.K.codim)
        self.beta = self.f.diff_lipschitz if beta is None else beta

    def init(self, x0: Grid, z0: Grid | None = None, tau: float | None = None, sigma: float | None = None, rho: float | None = None, tuning: int = 1):
        if tuning not in (1, 2, 3):
            raise ValueError("tuning is 1, 2 or 3")
        self.gamma = self.beta / 1.9 if tuning == 2 else self.beta
        if tau is None or sigma is None:
            if not math.isfinite(self.gamma) or (self.has_h and not math.isfinite(self.K.lipschitz)):
                raise ValueError("no finite Lipschitz constants: give tau and sigma")
            tau, sigma = self.sizes(tau, sigma)
        self.tau, self.sigma = tau, sigma
        self.rho = rho if rho is not None else (self.delta() - 0.1 if tuning == 3 else 1.0)
        z = z0 if z0 is not None else constant(x0, self.K.codim, 0.0)
        self.state.update(x=x0, z=z, **self.more(x0))

    def more(self, x0: Grid) -> dict:
        return {}

    def sizes(self, tau, sigma) -> tuple[float, float]:
        raise NotImplementedError

    def delta(self) -> float:
        return 2.0 if self.beta == 0 or (self.f.has(P.QUADRATIC) and self.gamma <= self.beta) else 2 - self.beta / (2 * self.gamma)

    def relaxed(self, new: Grid, old: Grid) -> Grid:
        return new if self.rho == 1 else new.plus(old, self.rho, 1 - self.rho)

    def default_stop(self):
        x = RelError(1e-4, "x")
        return x & RelError(1e-4, "z") if self.has_h else x

    def solution(self, which: str = "primal"):
        return self.state["x" if which == "primal" else "z"]

    def objective(self):
        x = self.state["x"]
        out = self.f.apply(x).plus(self.g.apply(x))
        return out.plus(self.h.apply(self.K.apply(x))) if self.has_h else out


class CondatVu(PrimalDual):
    def sizes(self, tau, sigma):
        k, half = self.K.lipschitz if self.has_h else 0.0, self.gamma / 2
        if k == 0:
            return tau or (1 / self.gamma if self.gamma else 1.0), sigma or 1.0
        if tau is not None:
            return tau, max(0.0, (1 / tau - half)) / k**2
        if sigma is not None:
            return 1 / (half + sigma * k**2), sigma
        both = (-half + math.sqrt(half * half + 4 * k * k)) / (2 * k * k)
        return both, both

    def step(self):
        x, z = self.state["x"], self.state["z"]
        down = x.plus(self.f.grad(x), 1, -self.tau)
        if self.has_h:
            down = down.plus(self.K.adjoint(z), 1, -self.tau)
        x_new = self.held(self.g.prox(down, self.tau))
        if self.has_h:
            ahead = z.plus(self.K.apply(x_new.plus(x, 2, -1)), 1, self.sigma)
            self.state["z"] = self.relaxed(self.h.fenchel_prox(self.held(ahead), self.sigma), z)
        self.state["x"] = self.relaxed(x_new, x)


class PD3O(PrimalDual):
    """The three-operator splitting; larger steps than CondatVu where f matters."""

    def sizes(self, tau, sigma):
        k = self.K.lipschitz if self.has_h else 0.0
        most = min(math.sqrt(0.99) / k if k else math.inf, 1 / self.gamma if self.gamma else math.inf)
        most = most if math.isfinite(most) else 1.0
        return tau or most, sigma or (most if tau is None or not k else 0.99 / (tau * k * k))

    def more(self, x0):
        """Without h nothing but u would move in the first step, and the solver would stop where it began: u starts one
        gradient step ahead."""
        return {"u": x0 if self.has_h else x0.plus(self.f.grad(x0), 1, -self.tau)}

    def step(self):
        z, u = self.state["z"], self.state["u"]
        x = self.held(self.g.prox(u, self.tau))
        down = self.held(x.plus(self.f.grad(x), 1, -self.tau))
        if self.has_h:
            back = self.K.adjoint(z)
            ahead = z.plus(self.K.apply(x.plus(down).plus(u, 1, -1).plus(back, 1, -self.tau)), 1, self.sigma)
            z_new = self.held(self.relaxed(self.h.fenchel_prox(self.held(ahead), self.sigma), z))
            self.state["z"] = z_new
            down = down.plus(self.K.adjoint(z_new), 1, -self.tau)
        self.state.update(x=x, u=self.relaxed(down, u))


def ChambollePock(g=None, h=None, K=None, base=CondatVu, **kwargs):  # noqa: N802, N803
    """f = 0"""
    return base(None, g, h, K, **kwargs)


class LorisVerhoeven(PD3O):
    """g = 0"""

    def __init__(self, f=None, h=None, K=None, **kwargs):  # noqa: N803
        super().__init__(f, None, h, K, **kwargs)

    def sizes(self, tau, sigma):
        tau = tau or (1 / self.gamma if self.gamma else 1.0)
        k = self.K.lipschitz if self.has_h else 0.0
        return tau, sigma or (0.99 / (tau * k * k) if k else 1.0)


class DavisYin(PD3O):
    """K = 1"""

    def __init__(self, f, g=None, h=None, **kwargs):
        super().__init__(f, g, h, None, **kwargs)

    def sizes(self, tau, sigma):
        tau = tau or (1 / self.gamma if self.gamma else 1.0)
        return tau, sigma or 0.99 / tau


class _DouglasRachford:
    def sizes(self, tau, sigma):
        tau = tau or 1.0
        return tau, sigma or 1 / tau


def DouglasRachford(g=None, h=None, base=CondatVu, **kwargs):  # noqa: N802
    """f = 0, K = 1, sigma = 1 / tau"""
    return type("DouglasRachford", (_DouglasRachford, base), {})(None, g, h, None, **kwargs)


class ForwardBackward(CondatVu):
    """h = 0"""

    def __init__(self, f=None, g=None, **kwargs):
        super().__init__(f, g, None, None, **kwargs)


def ProximalPoint(g=None, base=CondatVu, **kwargs):  # noqa: N802
    """g alone"""
    return base(None, g, None, None, **kwargs)


class ADMM(PrimalDual):
    """min f(x) + h(K x). The x-update is f's prox if K = 1, conjugate gradients if f is quadratic or absent, non-linear
    ones if it is smooth, or `solver`(target, tau), which minimises f(x) + |K x - target|^2 / (2 tau)."""

    def __init__(self, f=None, h=None, K=None, solver=None, inner: dict | None = None, **kwargs):  # noqa: N803
        super().__init__(f, None, h, K, **kwargs)
        self.no_f, self.own, self.inner = f is None, solver, inner or {}

    def init(self, x0, z0=None, tau: float | None = None, rho: float | None = None, **kwargs):
        self.tau, self.rho, self.sigma = tau or 1.0, rho or 1.0, 1 / (tau or 1.0)
        z = z0 if z0 is not None else self.K.apply(x0)
        self.state.update(x=x0, z=z, u=constant(x0, self.K.codim, 0.0))

    def _update(self, target: Grid, x: Grid) -> Grid:
        if self.own:
            return self.own(target, self.tau)
        if isinstance(self.K, Identity) and self.f.has(P.PROXIMABLE):
            return self.f.prox(target, self.tau)
        if self.no_f or self.f.has(P.QUADRATIC):
            normal, b = self.K.gram() * (1 / self.tau), self.K.adjoint(target).scale(1 / self.tau)
            if not self.no_f:
                q, c, _ = self.f.quad_spec()
                normal, b = normal + q, b.plus(c.grad(x), 1, -1) if c else b
            solver = CG(normal)
            return solver.fit(b=self.held(b), x0=x, stop=solver.default_stop() | MaxIter(self.inner.get("max_iter", 2 * self.K.dim_size))).solution()
        smooth = self.f + (SquaredL2Norm(self.K.codim).argshift(target.scale(-1)) * (1 / (2 * self.tau))) * self.K
        solver = NLCG(smooth)
        return solver.fit(x0=x, stop=solver.default_stop() | MaxIter(self.inner.get("max_iter", 10))).solution()

    def step(self):
        x, z, u = (self.state[k] for k in "xzu")
        x = self.held(self._update(self.held(z.plus(u, 1, -1)), x))
        kx = self.K.apply(x)
        kx = kx if self.rho == 1 else kx.plus(z, self.rho, 1 - self.rho)
        point = self.held(kx.plus(u))
        z = self.held(self.h.prox(point, self.tau))
        self.state.update(x=x, z=z, u=point.plus(z, 1, -1))


CV, CP, LV, DY, DR, FB, PP = CondatVu, ChambollePock, LorisVerhoeven, DavisYin, DouglasRachford, ForwardBackward, ProximalPoint
