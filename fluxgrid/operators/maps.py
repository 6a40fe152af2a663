"""Element-wise maps with their Lipschitz constants and Jacobians, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxgrid.plans.grid import Grid, constant, quotient
from fluxgrid.plans.op import DIFF_MAP, FUNC, INF, MAP, PROX_DIFF_FUNC, Op, Pointwise

NAN, ONE = F.lit, 1.0


def _sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def _log(v: Column) -> Column:
    """The logarithm of floating-point arithmetic: -inf at 0, NaN below."""
    return F.when(v > 0, F.ln(v)).when(v == 0, F.lit(-INF)).otherwise(F.lit(math.nan))


def _root(v: Column) -> Column:
    return F.sqrt(v)


def _pow2(v: Column) -> Column:
    return v * v


class Ufunc(Pointwise):
    """A map of values: `fn`, and `slope` where it is differentiable."""

    slope = None

    def __init__(self, dim):
        super().__init__(dim, dim, DIFF_MAP if self.slope else MAP)

    def jacobian(self, x: Grid) -> Op:
        from fluxgrid.operators.linop import Diagonal

        if not self.slope:
            return super().jacobian(x)
        return Diagonal(x.dense().map(self.slope))


def _make(name: str, fn, slope=None, lipschitz: float = INF, diff: float = INF, keeps_zero: bool = True, doc: str = "") -> type:
    body = {"fn": staticmethod(fn), "lipschitz": lipschitz, "diff_lipschitz": diff, "keeps_zero": keeps_zero, "__doc__": doc or f"{name}, value by value", "__module__": __name__}
    if slope:
        body["slope"] = staticmethod(slope)
    return type(name, (Ufunc,), body)


R3 = math.sqrt(3)
Sin = _make("Sin", F.sin, F.cos, 1, 1)
Cos = _make("Cos", F.cos, lambda v: -F.sin(v), 1, 1, keeps_zero=False)
Tan = _make("Tan", F.tan, lambda v: 1 / _pow2(F.cos(v)))
ArcSin = _make("ArcSin", F.asin, lambda v: quotient(F.lit(1.0), _root(1 - v * v)))
ArcCos = _make("ArcCos", F.acos, lambda v: -quotient(F.lit(1.0), _root(1 - v * v)), keeps_zero=False)
ArcTan = _make("ArcTan", F.atan, lambda v: 1 / (1 + v * v), 1, 3 * R3 / 8)
Sinh = _make("Sinh", F.sinh, F.cosh)
Cosh = _make("Cosh", F.cosh, F.sinh, keeps_zero=False)
Tanh = _make("Tanh", F.tanh, lambda v: 1 - _pow2(F.tanh(v)), 1, 4 / (3 * R3))
ArcSinh = _make("ArcSinh", F.asinh, lambda v: 1 / _root(1 + v * v), 1, 2 / (3 * R3))
ArcCosh = _make("ArcCosh", F.acosh, lambda v: quotient(F.lit(1.0), _root(v * v - 1)), keeps_zero=False)
ArcTanh = _make("ArcTanh", F.atanh, lambda v: quotient(F.lit(1.0), 1 - v * v))
Sqrt = _make("Sqrt", F.sqrt, lambda v: quotient(F.lit(0.5), F.sqrt(v)))
Cbrt = _make("Cbrt", F.cbrt, lambda v: quotient(F.lit(1.0), 3 * _pow2(F.cbrt(v))))
Square = _make("Square", _pow2, lambda v: 2 * v, INF, 2)
Abs = _make("Abs", F.abs, None, 1)
Sign = _make("Sign", F.signum)
Gaussian = _make("Gaussian", lambda v: F.exp(-v * v), lambda v: -2 * v * F.exp(-v * v), math.sqrt(2 / math.e), 2, keeps_zero=False)
Sigmoid = _make("Sigmoid", _sigmoid, lambda v: _sigmoid(v) * (1 - _sigmoid(v)), 0.25, 1 / (6 * R3), keeps_zero=False)
SoftPlus = _make("SoftPlus", lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v))), _sigmoid, 1, 0.25, keeps_zero=False)
SiLU = _make("SiLU", lambda v: v * _sigmoid(v), lambda v: _sigmoid(v) * (1 + v * (1 - _sigmoid(v))), 1.1, 0.5)


class Exp(Ufunc):
    """base ** v"""

    keeps_zero = False

    def __init__(self, dim, base: float = math.e):
        self.log = math.log(base)
        super().__init__(dim)

    def fn(self, v):
        return F.exp(v * self.log)

    def slope(self, v):
        return self.log * F.exp(v * self.log)


class Log(Ufunc):
    """The logarithm to a base; -inf at 0, NaN below."""

    keeps_zero = False

    def __init__(self, dim, base: float = math.e):
        self.log = math.log(base)
        super().__init__(dim)

    def fn(self, v):
        return _log(v) / self.log

    def slope(self, v):
        return quotient(F.lit(1 / self.log), v)


class Clip(Ufunc):
    """v kept within [low, high]; either may be None. NaN stays."""

    keeps_zero, lipschitz = False, 1.0

    def __init__(self, dim, low: float | None = None, high: float | None = None):
        if low is None and high is None:
            raise ValueError("one bound at least")
        self.low, self.high = low, high
        super().__init__(dim)

    def fn(self, v):
        out = v if self.low is None else F.greatest(v, F.lit(float(self.low)))
        out = out if self.high is None else F.least(out, F.lit(float(self.high)))
        return F.when(F.isnan(v), v).otherwise(out)


class LeakyReLU(Ufunc):
    """v where v >= 0, alpha * v elsewhere."""

    def __init__(self, dim, alpha: float):
        if alpha < 0:
            raise ValueError("alpha must not be negative")
        self.alpha = float(alpha)
        super().__init__(dim)
        self.lipschitz = max(self.alpha, 1.0)

    def fn(self, v):
        return F.when(v >= 0, v).otherwise(v * self.alpha)


class ReLU(LeakyReLU):
    """LeakyReLU with alpha 0"""

    def __init__(self, dim):
        super().__init__(dim, 0.0)


class ConstantValued(Op):
    """c everywhere in the codomain; a functional of it is its own prox's identity."""

    lipschitz = diff_lipschitz = 0.0

    def __new__(cls, dim, codim, value: float):
        from fluxgrid.operators.linop import Null

        return Null(dim, codim) if abs(value) < 1e-12 else super().__new__(cls)

    def __init__(self, dim, codim, value: float):
        functional = codim in (1, (1,), [1])
        super().__init__(dim, codim, PROX_DIFF_FUNC if functional else DIFF_MAP)
        self.value = value

    def apply(self, x):
        return constant(x, self.codim, self.value)

    def grad(self, x):
        return constant(x, self.dim, 0.0)

    def jacobian(self, x):
        from fluxgrid.operators.linop import Null

        return Null(self.dim, self.codim)

    def prox(self, x, tau):
        return x


class AtZero(Op):
    """x -> A(0): what is left of an operator whose argument is scaled by 0."""

    lipschitz = diff_lipschitz = 0.0

    def __init__(self, op: Op):
        super().__init__(op.dim, op.codim, PROX_DIFF_FUNC if op.codim == (1,) else DIFF_MAP, f"AtZero({op.name})")
        self.op = op

    def apply(self, x):
        return self.op.apply(x.scale(0.0))

    def grad(self, x):
        return constant(x, self.dim, 0.0)

    def prox(self, x, tau):
        return x


#: Maps without parameters, by name.
UFUNCS = {c.__name__.lower(): c for c in (Sin, Cos, Tan, ArcSin, ArcCos, ArcTan, Sinh, Cosh, Tanh, ArcSinh, ArcCosh, ArcTanh, Sqrt, Cbrt, Square, Abs, Sign, Gaussian, Sigmoid, SoftPlus, SiLU, Exp, Log, ReLU)}
_ = FUNC
