"""Signals as coordinate tables.

A Grid is a DataFrame (s, i0, ..., v): s numbers the items of a stack, i0... are the places in the core of shape
`shape`, v is the value. A missing row is 0. Linear operators keep it that way; whatever maps 0 to something else makes
the table dense first.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Shape = tuple[int, ...]


def as_shape(x: int | Sequence[int]) -> Shape:
    return (int(x),) if isinstance(x, int) else tuple(int(k) for k in x)


def as_axes(axes: int | Sequence[int] | None, rank: int) -> Shape:
    """Axes from 0, None for all; out-of-range axes raise."""
    found = tuple(range(rank)) if axes is None else as_shape(axes)
    if any(not -rank <= a < rank for a in found):
        raise ValueError(f"axes {axes} do not fit rank {rank}")
    return tuple(a % rank for a in found)


def axes_of(rank: int) -> list[str]:
    return [f"i{k}" for k in range(rank)]


def ravel(shape: Shape, names: Sequence[str] | None = None) -> Column:
    """The place in C order."""
    out = F.lit(0).cast("long")
    for n, name in zip(shape, names or axes_of(len(shape)), strict=True):
        out = out * n + F.col(name)
    return out


def unravel(k: Column, shape: Shape) -> list[Column]:
    out, step = [], math.prod(shape)
    for d, n in enumerate(shape):
        step //= n
        q = (k - F.pmod(k, F.lit(step))) / step if step > 1 else k
        out.append((F.pmod(q.cast("long"), F.lit(n)) if d else q).cast("long").alias(f"i{d}"))
    return out


@dataclass(frozen=True)
class Grid:
    df: DataFrame
    shape: Shape

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def keys(self) -> list[str]:
        return ["s", *axes_of(self.rank)]

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def map(self, f) -> "Grid":
        """v -> f(v), row by row."""
        return Grid(self.df.select(*self.keys, f(F.col("v")).cast("double").alias("v")), self.shape)

    def dense(self) -> "Grid":
        """All places of every item that has any row; one left join."""
        at = self.df.select("s").distinct()
        for k, n in enumerate(self.shape):
            at = at.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        return Grid(at.join(self.df, self.keys, "left").select(*self.keys, F.coalesce("v", F.lit(0.0)).alias("v")), self.shape)

    def summed(self) -> "Grid":
        """One row for each place: values of equal places add up, before the shuffle and after."""
        return Grid(self.df.groupBy(*self.keys).agg(F.sum("v").alias("v")), self.shape)

    def scale(self, a: float) -> "Grid":
        return self if a == 1 else self.map(lambda v: v * F.lit(float(a)))

    def plus(self, other: "Grid", a: float = 1.0, b: float = 1.0) -> "Grid":
        """a * self + b * other, by a union and one aggregation."""
        return Grid(self.scale(a).df.unionByName(other.scale(b).df), self.shape).summed()

    def zip(self, other: "Grid", f) -> "Grid":
        """f(v, w) at the places of both; a place that one lacks counts as 0 there."""
        right = other.df.withColumnRenamed("v", "w")
        both = self.df.join(right, self.keys, "full")
        return Grid(both.select(*self.keys, f(F.coalesce("v", F.lit(0.0)), F.coalesce("w", F.lit(0.0))).cast("double").alias("v")), self.shape)

    def per_item(self, value: Column, name: str = "t") -> DataFrame:
        return self.df.groupBy("s").agg(value.alias(name))

    def dot(self, other: "Grid") -> float:
        both = self.df.join(other.df.withColumnRenamed("v", "w"), self.keys)
        return float(both.agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0))).first()[0])

    def norm(self) -> float:
        return math.sqrt(float(self.df.agg(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).first()[0]))

    def scalar(self, df: DataFrame, value: Column) -> "Grid":
        """A functional's result: one value for each item."""
        return Grid(df.select("s", F.lit(0).cast("long").alias("i0"), value.cast("double").alias("v")), (1,))

    def to_numpy(self, most: int = 10_000_000) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the items, array (items, *core)) on the driver, of `most` values at most; more raise."""
        items = np.array([r["s"] for r in self.df.select("s").distinct().orderBy("s").limit(most // self.size + 1).collect()], "i8")
        if len(items) * self.size > most:
            raise ValueError(f"over {most} values are not brought to the driver")
        rows = self.summed().df.toPandas()
        out = np.zeros((len(items), *self.shape))
        out[(np.searchsorted(items, rows["s"]), *(rows[k] for k in self.keys[1:]))] = rows["v"]
        return items, out

    def written(self) -> "Grid":
        """Cuts lineage by a table in the shared folder."""
        from fluxgrid.sources.store import stage

        return Grid(stage(self.df), self.shape)


def grid(df: DataFrame, shape: int | Sequence[int]) -> Grid:
    shape = as_shape(shape)
    names = ["s", *axes_of(len(shape))]
    df = df if "s" in df.columns else df.withColumn("s", F.lit(0))
    return Grid(df.select(*(F.col(c).cast("long").alias(c) for c in names), F.col("v").cast("double").alias("v")), shape)


def constant(like: Grid, shape: Shape, value: float) -> Grid:
    """`value` everywhere, for the items of `like`."""
    at = like.df.select("s").distinct()
    for k, n in enumerate(shape):
        at = at.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return Grid(at.withColumn("v", F.lit(float(value))), shape)


def from_numpy(spark: SparkSession, a: np.ndarray, stacked: bool = False) -> Grid:
    """A dense array as one item, or (stacked) with the items on its first axis."""
    import pandas as pd

    a = np.asarray(a, float) if stacked else np.asarray(a, float)[None]
    names = ["s", *axes_of(a.ndim - 1)]
    at = np.indices(a.shape).reshape(a.ndim, -1)
    df = spark.createDataFrame(pd.DataFrame(dict(zip(names, at, strict=True)) | {"v": a.ravel()}), ", ".join([*(f"{n} long" for n in names), "v double"]))
    return Grid(df, a.shape[1:])


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating-point arithmetic has it: no error and no null at b = 0."""
    at_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf")))
    return F.when(b != 0, a / b).otherwise(at_zero)


def fresh(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:8]}"
