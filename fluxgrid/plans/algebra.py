"""Expression nodes and the rules that infer their class, constants and simplifications."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fluxgrid.plans.grid import Grid, constant
from fluxgrid.plans.op import FUNC, LIN_FUNC, LINEAR, PROX_DIFF_FUNC, SELF_ADJOINT, Op, implied
from fluxgrid.plans.op import Property as P


def _close(a: float, b: float) -> bool:
    return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)


def _times(a: float, b: float) -> float:
    return 0.0 if a == 0 or b == 0 else a * b


class Scale(Op):
    """a * A"""

    @classmethod
    def of(cls, op: Op, a: float) -> Op:
        from fluxgrid.operators.linop import Null

        if _close(a, 0):
            return Null(op.dim, op.codim)
        if _close(a, 1):
            return op
        return cls(op.op, a * op.a) if isinstance(op, Scale) else cls(op, a)

    def __init__(self, op: Op, a: float):
        lost = {P.LINEAR_IDEMPOTENT}
        if a < 0:
            lost |= {P.LINEAR_POSITIVE_DEFINITE, P.QUADRATIC} | (set() if op.has(P.LINEAR) else {P.PROXIMABLE})
        if not _close(abs(a), 1):
            lost |= {P.LINEAR_UNITARY}
        super().__init__(op.dim, op.codim, op.props - lost, f"Scale({a:g})")
        self.op, self.a = op, a
        self.lipschitz, self.diff_lipschitz = abs(a) * op.lipschitz, _times(abs(a), op.diff_lipschitz)

    def apply(self, x):
        return self.op.apply(x).scale(self.a)

    def adjoint(self, y):
        return self.op.adjoint(y).scale(self.a)

    def grad(self, x):
        return self.op.grad(x).scale(self.a)

    def jacobian(self, x):
        return self.op.jacobian(x) * self.a

    def prox(self, x, tau):
        return self.op.prox(x, self.a * tau)

    def gram(self):
        return self.op.gram() * (self.a * self.a)

    def trace(self, spark, **kwargs):
        return self.a * self.op.trace(spark, **kwargs)

    def own_svdvals(self, spark, k: int = 1):
        return abs(self.a) * self.op.svdvals(spark, k)

    def asarray(self, spark):
        return self.op.asarray(spark).select("row", "col", (F.col("w") * self.a).alias("w"))

    def quad_spec(self):
        q, c, t = self.op.quad_spec()
        return q * self.a, c * self.a, t * self.a

    def children(self):
        return (self.op,)


class ArgScale(Op):
    """x -> A(a x)"""

    @classmethod
    def of(cls, op: Op, a: float) -> Op:
        from fluxgrid.operators.maps import AtZero

        if _close(a, 0):
            return AtZero(op)
        if op.has(P.LINEAR):
            return op * a
        return op if _close(a, 1) else cls(op, a)

    def __init__(self, op: Op, a: float):
        super().__init__(op.dim, op.codim, op.props, f"ArgScale({a:g})")
        self.op, self.a = op, a
        self.lipschitz, self.diff_lipschitz = abs(a) * op.lipschitz, _times(a * a, op.diff_lipschitz)

    def apply(self, x):
        return self.op.apply(x.scale(self.a))

    def grad(self, x):
        return self.op.grad(x.scale(self.a)).scale(self.a)

    def jacobian(self, x):
        return self.op.jacobian(x.scale(self.a)) * self.a

    def prox(self, x, tau):
        return self.op.prox(x.scale(self.a), self.a * self.a * tau).scale(1 / self.a)

    def quad_spec(self):
        q, c, t = self.op.quad_spec()
        return q * (self.a * self.a), c * self.a, t

    def children(self):
        return (self.op,)


class ArgShift(Op):
    """x -> A(x + c); argshift(-y) makes a data-fidelity term. c is a number or a Grid with one item (s = 0) for all."""

    @classmethod
    def of(cls, op: Op, c) -> Op:
        return op if isinstance(c, int | float) and c == 0 else cls(op, c)

    def __init__(self, op: Op, c):
        lost = {p for p in P if p.name.startswith("LINEAR")}
        props = op.props - lost
        if op.has(P.LINEAR, P.FUNCTIONAL):
            props = PROX_DIFF_FUNC
        super().__init__(op.dim, op.codim, props, "ArgShift")
        self.op, self.c = op, c
        self.lipschitz, self.diff_lipschitz = op.lipschitz, op.diff_lipschitz

    def _moved(self, x: Grid, sign: float) -> Grid:
        if isinstance(self.c, int | float):
            return x.dense().map(lambda v: v + F.lit(sign * float(self.c)))
        axes = x.keys[1:]
        shift = self.c.df.select(*axes, F.col("v").alias("w"))
        both = x.dense().df.join(shift, axes, "left")
        return Grid(both.select(*x.keys, (F.col("v") + sign * F.coalesce("w", F.lit(0.0))).alias("v")), x.shape)

    def apply(self, x):
        return self.op.apply(self._moved(x, 1))

    def grad(self, x):
        return self.op.grad(self._moved(x, 1))

    def jacobian(self, x):
        return self.op.jacobian(self._moved(x, 1))

    def prox(self, x, tau):
        return self._moved(self.op.prox(self._moved(x, 1), tau), -1)

    def children(self):
        return (self.op,)


class Add(Op):
    """A + B; codomains broadcast, so that a functional may be added to a map."""

    @classmethod
    def of(cls, a: Op, b: Op) -> Op:
        if a.dim != b.dim:
            raise ValueError(f"cannot add operators on {a.dim} and {b.dim}")
        if a.codim != b.codim:
            out = _broadcast(a.codim, b.codim)
            a, b = (o if o.codim == out else o.broadcast_to(out) for o in (a, b))
        if a.has(P.QUADRATIC) and b.has(P.QUADRATIC) or a.has(P.QUADRATIC) and b.has(P.LINEAR, P.FUNCTIONAL) or b.has(P.QUADRATIC) and a.has(P.LINEAR, P.FUNCTIONAL):
            from fluxgrid.operators.norm import QuadraticFunc

            (q, c, t), (r, d, u) = (o.quad_spec() if o.has(P.QUADRATIC) else (None, o, 0.0) for o in (a, b))
            return QuadraticFunc(a.dim, q + r if q and r else q or r, c + d if c and d else c or d, t + u)
        return cls(a, b)

    def __init__(self, a: Op, b: Op):
        both = a.props & b.props
        props = both - {P.PROXIMABLE, P.LINEAR_IDEMPOTENT, P.LINEAR_UNITARY, P.QUADRATIC, P.LINEAR_NORMAL}
        if both >= {P.LINEAR_SELF_ADJOINT}:
            props |= {P.LINEAR_NORMAL}
        one_linear = a.has(P.LINEAR, P.FUNCTIONAL) or b.has(P.LINEAR, P.FUNCTIONAL)
        if both >= {P.PROXIMABLE} and one_linear:
            props |= {P.PROXIMABLE}
        super().__init__(a.dim, a.codim, props, "Add")
        self.a, self.b = a, b
        self.lipschitz = a.lipschitz + b.lipschitz
        if not self.has(P.LINEAR):
            self.diff_lipschitz = a.diff_lipschitz + b.diff_lipschitz

    def apply(self, x):
        return self.a.apply(x).plus(self.b.apply(x))

    def adjoint(self, y):
        return self.a.adjoint(y).plus(self.b.adjoint(y))

    def grad(self, x):
        return self.a.grad(x).plus(self.b.grad(x))

    def jacobian(self, x):
        return self.a.jacobian(x) + self.b.jacobian(x)

    def prox(self, x, tau):
        f, line = (self.a, self.b) if self.b.has(P.LINEAR) else (self.b, self.a)
        return f.prox(x.plus(line.grad(x), 1, -tau), tau)

    def children(self):
        return self.a, self.b


def _broadcast(a, b):
    n = max(len(a), len(b))
    a, b = ((1,) * (n - len(x)) + tuple(x) for x in (a, b))
    if any(x != y and 1 not in (x, y) for x, y in zip(a, b, strict=True)):
        raise ValueError(f"{a} and {b} do not broadcast")
    return tuple(map(max, a, b))


class Chain(Op):
    """A after B"""

    @classmethod
    def of(cls, a: Op, b: Op) -> Op:
        from fluxgrid.operators.linop import Identity

        if a.dim != b.codim:
            raise ValueError(f"cannot compose {a.dim} with {b.codim}")
        if isinstance(a, Identity):
            return b
        if isinstance(b, Identity):
            return a
        return cls(a, b)

    def __init__(self, a: Op, b: Op):
        props = {P.CAN_EVAL} | ({P.FUNCTIONAL} & a.props) | ({P.DIFFERENTIABLE} & a.props & b.props)
        if a.has(P.LINEAR) and b.has(P.LINEAR):
            props |= LIN_FUNC if a.has(P.FUNCTIONAL) else LINEAR
            if b.dim == a.codim and not a.has(P.FUNCTIONAL):
                props |= {P.LINEAR_SQUARE}
            if a.has(P.LINEAR_UNITARY) and b.has(P.LINEAR_UNITARY):
                props |= {P.LINEAR_UNITARY}
        if a.has(P.QUADRATIC) and b.has(P.LINEAR):
            props |= {P.QUADRATIC}
        if a.has(P.PROXIMABLE) and b.has(P.LINEAR_UNITARY):
            props |= {P.PROXIMABLE}
        super().__init__(b.dim, a.codim, implied(frozenset(props)), "Chain")
        self.a, self.b = a, b
        self.lipschitz = _times(a.lipschitz, b.lipschitz)
        if not self.has(P.LINEAR) and self.has(P.DIFFERENTIABLE):
            if b.has(P.LINEAR):
                self.diff_lipschitz = _times(a.diff_lipschitz, b.lipschitz**2)
            elif a.has(P.LINEAR):
                self.diff_lipschitz = _times(a.lipschitz, b.diff_lipschitz)
            else:
                self.diff_lipschitz = _times(a.diff_lipschitz, b.lipschitz**2) + _times(a.lipschitz, b.diff_lipschitz)

    def apply(self, x):
        return self.a.apply(self.b.apply(x))

    def adjoint(self, y):
        return self.b.adjoint(self.a.adjoint(y))

    def grad(self, x):
        if self.has(P.LINEAR):
            return super().grad(x)
        inner = self.b if self.b.has(P.LINEAR) else self.b.jacobian(x)
        return inner.adjoint(self.a.grad(self.b.apply(x)))

    def jacobian(self, x):
        return self if self.has(P.LINEAR) else self.a.jacobian(self.b.apply(x)) * self.b.jacobian(x)

    def prox(self, x, tau):
        if self.has(P.LINEAR):
            return super().prox(x, tau)
        if self.has(P.QUADRATIC) and not self.b.has(P.LINEAR_UNITARY):
            return self._as_quadratic().prox(x, tau)
        return self.b.adjoint(self.a.prox(self.b.apply(x), tau))

    def quad_spec(self):
        q, c, t = self.a.quad_spec()
        normal = (self.b.T * q * self.b).asop(SELF_ADJOINT)
        normal.lipschitz = _times(q.lipschitz, self.b.lipschitz**2)
        return normal, c * self.b if c else None, t

    def _as_quadratic(self):
        from fluxgrid.operators.norm import QuadraticFunc

        return QuadraticFunc(self.dim, *self.quad_spec())

    def children(self):
        return self.a, self.b


class Transpose(Op):
    """The adjoint as an operator."""

    @classmethod
    def of(cls, op: Op) -> Op:
        if isinstance(op, Transpose):
            return op.op
        return op if op.has(P.LINEAR_SELF_ADJOINT) else cls(op)

    def __init__(self, op: Op):
        props = {p for p in op.props if p.name.startswith("LINEAR")}
        super().__init__(op.codim, op.dim, LIN_FUNC if op.dim == (1,) else frozenset(props), "Transpose")
        self.op, self.lipschitz = op, op.lipschitz

    def apply(self, x):
        return self.op.adjoint(x)

    def adjoint(self, y):
        return self.op.apply(y)

    def gram(self):
        return Gram(self)

    def children(self):
        return (self.op,)


class Gram(Op):
    """A* A; of a unitary operator the identity, of an orthogonal projection itself."""

    def __new__(cls, op: Op):
        from fluxgrid.operators.linop import Identity

        if op.has(P.LINEAR_UNITARY):
            return Identity(op.dim)
        if op.has(P.LINEAR_IDEMPOTENT, P.LINEAR_SELF_ADJOINT):
            return op
        return super().__new__(cls)

    def __init__(self, op: Op):
        super().__init__(op.dim, op.dim, SELF_ADJOINT, "Gram")
        self.op, self.lipschitz = op, op.lipschitz**2

    def apply(self, x):
        return self.op.adjoint(self.op.apply(x))

    def children(self):
        return (self.op,)


class Dagger(Op):
    """The (damped) pseudo-inverse; forward by conjugate gradients."""

    def __init__(self, op: Op, damp: float, fit: dict):
        super().__init__(op.codim, op.dim, LINEAR, "Dagger")
        self.op, self.damp, self.fit = op, damp, fit

    def apply(self, x):
        return self.op.pinv(x, self.damp, **self.fit)

    def adjoint(self, y):
        return self.op.T.pinv(y, self.damp, **self.fit)

    def children(self):
        return (self.op,)


class Cast(Op):
    """A node with other properties and the methods of the node below."""

    def __init__(self, op: Op, props: frozenset):
        super().__init__(op.dim, op.codim, props, f"Cast({op.name})")
        self.op, self.lipschitz, self.diff_lipschitz = op, op.lipschitz, op.diff_lipschitz

    def __getattr__(self, name):
        return getattr(self.__dict__["op"], name)

    def apply(self, x):
        return self.op.apply(x)

    def adjoint(self, y):
        return self.op.adjoint(y)

    def grad(self, x):
        return self.op.grad(x)

    def prox(self, x, tau):
        return self.op.prox(x, tau)

    def children(self):
        return (self.op,)


def zero(x: Grid, shape) -> Grid:
    return constant(x, shape, 0.0)


_ = FUNC
