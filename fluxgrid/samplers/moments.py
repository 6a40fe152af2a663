"""Statistics over samples (rows of a table, or items of a stack), place by place, and their arithmetic.

Each is an aggregate expression of population moments, so it partially aggregates, merges and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.plans.grid import Grid


class Stat:
    """An aggregate of v; + - * / combine statistics and numbers."""

    def __init__(self, expr: Column):
        self.expr = expr

    def of(self, samples: Grid | DataFrame, by: list[str] | None = None, name: str = "v") -> DataFrame:
        df, keys = (samples.df, samples.keys[1:]) if isinstance(samples, Grid) else (samples, by or [])
        return df.groupBy(*keys).agg(self.expr.alias(name))

    @staticmethod
    def _expr(x) -> Column:
        return x.expr if isinstance(x, Stat) else F.lit(float(x))

    def __add__(self, o):
        return Stat(self.expr + self._expr(o))

    def __sub__(self, o):
        return Stat(self.expr - self._expr(o))

    def __mul__(self, o):
        return Stat(self.expr * self._expr(o))

    __radd__, __rmul__ = __add__, __mul__

    def __truediv__(self, o):
        return Stat(self.expr / F.nullif(self._expr(o), F.lit(0.0)))

    def __pow__(self, k: float):
        return Stat(F.pow(self.expr, F.lit(float(k))))


def Moment(order: int = 1, column: str = "v") -> Stat:  # noqa: N802
    return Stat(F.avg(F.pow(F.col(column), F.lit(float(order)))) if order != 1 else F.avg(column))


def Variance(column: str = "v") -> Stat:  # noqa: N802
    return Stat(F.var_pop(column))


def Std(column: str = "v") -> Stat:  # noqa: N802
    return Stat(F.stddev_pop(column))


def Skewness(column: str = "v") -> Stat:  # noqa: N802
    return Stat(F.skewness(column))


def Kurtosis(column: str = "v") -> Stat:  # noqa: N802
    """Not the excess: 3 for a normal distribution."""
    return Stat(F.kurtosis(column) + 3)


def centered_moment(samples: Grid, order: int) -> DataFrame:
    """Mean of (v - mean)^order, place by place, in two passes."""
    keys = samples.keys[1:]
    mean = samples.df.groupBy(*keys).agg(F.avg("v").alias("m"))
    return samples.df.join(mean, keys).groupBy(*keys).agg(F.avg(F.pow(F.col("v") - F.col("m"), F.lit(float(order)))).alias("v"))
