"""Stopping criteria. Each looks at the solver's state before a step; `|` and `&` combine them."""

from __future__ import annotations

import math
import time
from datetime import timedelta

from pyspark.sql import functions as F

from fluxgrid.plans.grid import Grid


class Criterion:
    def stop(self, state: dict) -> bool:
        raise NotImplementedError

    def info(self) -> dict[str, float]:
        return {}

    def clear(self) -> None:
        pass

    def restore(self, calls: int, before: dict | None) -> None:
        """After a resumed fit: how often stop was called, and the state of the last call where it is still there."""

    def __or__(self, other: "Criterion") -> "Criterion":
        return Both(self, other, any)

    def __and__(self, other: "Criterion") -> "Criterion":
        return Both(self, other, all)


class Both(Criterion):
    """Two criteria, both asked every time."""

    def __init__(self, a: Criterion, b: Criterion, how):
        self.a, self.b, self.how = a, b, how

    def stop(self, state):
        return self.how([self.a.stop(state), self.b.stop(state)])

    def info(self):
        return self.a.info() | self.b.info()

    def clear(self):
        self.a.clear()
        self.b.clear()

    def restore(self, calls, before):
        self.a.restore(calls, before)
        self.b.restore(calls, before)


class MaxIter(Criterion):
    """True from call n + 1 on."""

    def __init__(self, n: int):
        self.n, self.i = int(n), 0

    def stop(self, state):
        self.i += 1
        return self.i > self.n

    def info(self):
        return {"N_iter": float(self.i)}

    def clear(self):
        self.i = 0

    def restore(self, calls, before):
        self.i = calls


class ManualStop(Criterion):
    def stop(self, state):
        return False


class MaxDuration(Criterion):
    def __init__(self, t: timedelta):
        self.t, self.since = t.total_seconds(), time.monotonic()

    def stop(self, state):
        return time.monotonic() - self.since > self.t

    def info(self):
        return {"duration": time.monotonic() - self.since}

    def clear(self):
        self.since = time.monotonic()


class Memorize(Criterion):
    """Keeps a scalar of the state in the history; never stops."""

    def __init__(self, var: str):
        self.var, self.value = var, math.nan

    def stop(self, state):
        value = state[self.var]
        self.value = float(value.df.agg(F.sum("v")).first()[0]) if isinstance(value, Grid) else float(value)
        return False

    def info(self):
        return {f"Memorize[{self.var}]": self.value}

    def clear(self):
        self.value = math.nan


def norm_of(v, ord) -> "F.Column":
    """The aggregate of a column that is its norm of an order (0 counts what is not about 0)."""
    if ord == 0:
        return F.sum(F.when(F.abs(v) > 1e-8, 1.0).otherwise(0.0))
    if ord == 1:
        return F.sum(F.abs(v))
    if ord == 2:
        return F.sqrt(F.sum(v * v))
    if ord == math.inf:
        return F.max(F.abs(v))
    return F.pow(F.sum(F.pow(F.abs(v), F.lit(float(ord)))), F.lit(1 / ord))


class AbsError(Criterion):
    """Norm of f(var), over the last `rank` axes of each item (all by default), at most eps - for all items or any."""

    def __init__(self, eps: float, var: str = "x", rank: int | None = None, f=None, norm=2, satisfy_all: bool = True):
        self.eps, self.var, self.rank, self.f, self.norm, self.all = eps, var, rank, f, norm, satisfy_all
        self.value = math.nan

    def _keys(self, x: Grid) -> list[str]:
        return ["s", *x.keys[1 : 1 + x.rank - (self.rank or x.rank)]]

    def stop(self, state):
        x = self.f(state[self.var]) if self.f else state[self.var]
        rows = x.df.groupBy(*self._keys(x)).agg(norm_of(F.col("v"), self.norm).alias("n"))
        low, high = rows.agg(F.min("n"), F.max("n")).first()
        self.value = high if self.all else low
        return self.value is not None and self.value <= self.eps

    def info(self):
        return {f"AbsError[{self.var}]": self.value}

    def clear(self):
        self.value = math.nan


class RelError(AbsError):
    """Norm of the change of f(var) at most eps times the norm of what it was; the first call never stops."""

    def __init__(self, *args, **kwargs):
        super().__init__(*args, **kwargs)
        self.before: Grid | None = None

    def stop(self, state):
        x = self.f(state[self.var]) if self.f else state[self.var]
        before, self.before = self.before, x
        if before is None:
            return False
        both = x.df.join(before.df.withColumnRenamed("v", "w"), x.keys, "full").select(*x.keys, F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("w", F.lit(0.0)).alias("w"))
        rows = both.groupBy(*self._keys(x)).agg(norm_of(F.col("v") - F.col("w"), self.norm).alias("d"), norm_of(F.col("w"), self.norm).alias("n"))
        ratio = F.when(F.col("d") == 0, 0.0).when(F.col("n") == 0, F.lit(math.inf)).otherwise(F.col("d") / F.col("n"))
        low, high = rows.agg(F.min(ratio), F.max(ratio)).first()
        self.value = high if self.all else low
        return self.value <= self.eps

    def info(self):
        return {f"RelError[{self.var}]": self.value}

    def clear(self):
        super().clear()
        self.before = None

    def restore(self, calls, before):
        if before and self.var in before:
            self.before = self.f(before[self.var]) if self.f else before[self.var]
