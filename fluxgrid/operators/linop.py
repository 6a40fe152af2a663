"""Basic, diagonal and explicit linear operators."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.plans.grid import Grid, as_shape, constant, ravel, unravel
from fluxgrid.plans.op import LIN_FUNC, LINEAR, ORTH_PROJECTION, POS_DEF, SELF_ADJOINT, SQUARE, UNITARY, Op
from fluxgrid.plans.op import Property as P


class Identity(Op):
    """x"""

    lipschitz = 1.0

    def __init__(self, dim):
        super().__init__(dim, dim, ORTH_PROJECTION | POS_DEF | UNITARY)

    def apply(self, x):
        return x

    def adjoint(self, y):
        return y

    def pinv(self, y, damp=0.0, **fit):
        return y.scale(1 / (1 + damp))


class Null(Op):
    """0"""

    lipschitz = 0.0

    def __init__(self, dim, codim):
        codim, dim = as_shape(codim), as_shape(dim)
        super().__init__(dim, codim, LIN_FUNC if codim == (1,) else SQUARE if math.prod(dim) == math.prod(codim) else LINEAR)

    def apply(self, x):
        return constant(x, self.codim, 0.0)

    def adjoint(self, y):
        return constant(y, self.dim, 0.0)

    def prox(self, x, tau):
        return x

    def pinv(self, y, damp=0.0, **fit):
        return self.adjoint(y)


def NullFunc(dim) -> Null:  # noqa: N802
    """The functional that is 0."""
    return Null(dim, (1,))


class Homothety(Op):
    """c * x"""

    def __new__(cls, dim, c: float):
        if abs(c) < 1e-12:
            return Null(dim, dim)
        return Identity(dim) if abs(c - 1) < 1e-12 else super().__new__(cls)

    def __init__(self, dim, c: float):
        super().__init__(dim, dim, POS_DEF if c > 0 else SELF_ADJOINT)
        self.c, self.lipschitz = float(c), abs(float(c))

    def apply(self, x):
        return x.scale(self.c)

    def pinv(self, y, damp=0.0, **fit):
        return y.scale(self.c / (self.c**2 + damp))


class Diagonal(Op):
    """w * x, place by place. w is a Grid; with items of its own (as a Jacobian has) it is joined by item as well."""

    def __init__(self, w: Grid, positive: bool = False, lipschitz: float = math.inf, shared: bool = False):
        super().__init__(w.shape, w.shape, POS_DEF if positive else SELF_ADJOINT)
        self.w, self.shared, self.lipschitz = w, shared, lipschitz

    def _joined(self, x: Grid, f) -> Grid:
        on = x.keys[1:] if self.shared else x.keys
        right = self.w.df.select(*on, F.col("v").alias("w"))
        return Grid(x.df.join(right, on).select(*x.keys, f(F.col("v"), F.col("w")).cast("double").alias("v")), x.shape)

    def apply(self, x):
        return self._joined(x, lambda v, w: v * w)

    def pinv(self, y, damp=0.0, **fit):
        """w / (w^2 + damp); 0 where that is 0 / 0."""
        return self._joined(y, lambda v, w: F.when((w == 0) & F.lit(damp == 0), 0.0).otherwise(v * w / F.nullif(w * w + damp, F.lit(0.0))))

    def largest(self, k: int) -> DataFrame:
        """The k largest singular values, in ascending order."""
        top = self.w.df.select(F.abs("v").alias("sv")).orderBy(F.desc("sv")).limit(k)
        return top.orderBy("sv")

    def own_svdvals(self, spark, k: int = 1):
        return np.array([r["sv"] for r in self.largest(k).collect()])

    def trace(self, spark, **kwargs):
        return float(self.w.df.agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0])


class Explicit(Op):
    """A matrix given by a table (row, col, w); rows and columns are C-order places of codim and dim."""

    def __init__(self, table: DataFrame, dim, codim, props: frozenset | None = None, lipschitz: float = math.inf):
        dim, codim = as_shape(dim), as_shape(codim)
        square = SQUARE if math.prod(dim) == math.prod(codim) else LINEAR
        super().__init__(dim, codim, props or (LIN_FUNC if codim == (1,) else square))
        self.table, self.lipschitz = table.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("w").cast("double")), lipschitz

    def _times(self, x: Grid, take: str, give: str, shape) -> Grid:
        flat = x.df.select("s", ravel(x.shape).alias(take), "v")
        out = flat.join(self.table, take).groupBy("s", give).agg(F.sum(F.col("w") * F.col("v")).alias("v"))
        return Grid(out.select("s", *unravel(F.col(give), shape), "v"), shape)

    def apply(self, x):
        return self._times(x, "col", "row", self.codim)

    def adjoint(self, y):
        return self._times(y, "row", "col", self.dim)

    def asarray(self, spark):
        return self.table


def from_array(a, spark, dim=None, codim=None, props: frozenset | None = None, rows: int = 1_000_000) -> Explicit:
    """A matrix from a dense array, a sparse one (anything with tocoo(), as SciPy's have), or (rows, columns, values) arrays with
    dim and codim; the non-zero cells go to Spark `rows` at a time."""
    if hasattr(a, "tocoo"):
        coo = a.tocoo()
        at, to, w, shape = coo.row, coo.col, coo.data, coo.shape
    elif isinstance(a, tuple):
        (at, to, w), shape = map(np.asarray, a), (math.prod(as_shape(codim)), math.prod(as_shape(dim)))
    else:
        a = np.asarray(a, float)
        if a.ndim != 2:
            raise ValueError("a matrix has two axes")
        (at, to), shape = np.nonzero(a), a.shape
        w = a[at, to]
    if len(w) and not (0 <= min(at) and max(at) < shape[0] and 0 <= min(to) and max(to) < shape[1]):
        raise ValueError("a cell lies outside the matrix")
    schema = "row long, col long, w double"
    parts = [spark.createDataFrame(pd.DataFrame({"row": at[k : k + rows], "col": to[k : k + rows], "w": np.asarray(w[k : k + rows], float)}), schema) for k in range(0, len(w), rows)]
    table = reduce(lambda x, y: x.unionByName(y), parts) if parts else spark.createDataFrame([], schema)
    # Sparse formats may name a cell more than once.
    table = table.groupBy("row", "col").agg(F.sum("w").alias("w")) if not isinstance(a, np.ndarray) else table
    return Explicit(table, dim if dim is not None else shape[1], codim if codim is not None else shape[0], props)


class LinFunc(Op):
    """<a, x> for a Grid a with one item, or with an item for each of x's."""

    def __init__(self, a: Grid, shared: bool = False, lipschitz: float = math.inf):
        super().__init__(a.shape, (1,), LIN_FUNC)
        self.a, self.shared, self.lipschitz = a, shared, lipschitz

    def apply(self, x):
        on = x.keys[1:] if self.shared else x.keys
        both = x.df.join(self.a.df.select(*on, F.col("v").alias("w")), on)
        return x.scalar(both.groupBy("s").agg(F.sum(F.col("v") * F.col("w")).alias("t")), F.col("t"))

    def adjoint(self, y):
        rows = y.df.select("s", F.col("v").alias("t"))
        if self.shared:
            at = self.a.df.select(*self.a.keys[1:], F.col("v").alias("w"))
            both = rows.crossJoin(F.broadcast(at)) if self.dim_size <= 1 << 20 else rows.crossJoin(at)
        else:
            both = rows.join(self.a.df.withColumnRenamed("v", "w"), "s")
        return Grid(both.select(*self.a.keys, (F.col("t") * F.col("w")).alias("v")), self.dim)


_OF_BOTH = {P.LINEAR_SELF_ADJOINT, P.LINEAR_NORMAL, P.LINEAR_UNITARY, P.LINEAR_IDEMPOTENT, P.LINEAR_POSITIVE_DEFINITE, P.LINEAR_SQUARE, P.LINEAR}


#: Columns up to which a matrix is laid out as one row for each of its rows, and cells up to which these are broadcast.
NARROW, BROADCAST_CELLS = 32, 2_000_000
#: Values of a product that one task makes.
TASK_VALUES = 4_000_000


def _narrow(o: Op) -> bool:
    return isinstance(o, Explicit) and o.dim_size <= NARROW


def _laid_out(rows: DataFrame, by: list[str], place: str, value: str, n: int, name: str) -> DataFrame:
    """One row for each of `by`, with the values at n places as columns; null where there is none."""
    return rows.groupBy(*by).agg(*(F.sum(F.when(F.col(place) == k, F.col(value))).alias(f"{name}{k}") for k in range(n)))


def _rows_of(o: Explicit, row: str, name: str) -> DataFrame:
    """The rows of a narrow matrix; broadcast while small."""
    df = _laid_out(o.table.withColumnRenamed("row", row), [row], "col", "w", o.dim_size, name)
    return F.broadcast(df) if o.codim_size * o.dim_size <= BROADCAST_CELLS else df


def _outer(rows: DataFrame, o: Explicit, place: str, other: str, size: int) -> DataFrame:
    """A narrow matrix along `place` of rows (s, place, other, v): every vector meets every row of it, and of the product,
    which can be far larger than both (`size` places of `other`), nothing is shuffled."""
    x, tasks = _laid_out(rows, ["s", other], place, "v", o.dim_size, "v"), min(4096, o.codim_size * size // TASK_VALUES)
    x = x.repartition(tasks, "s", other) if tasks > 1 else x
    terms = [F.col(f"v{k}") * F.col(f"w{k}") for k in range(o.dim_size)]
    some = x.crossJoin(_rows_of(o, place, "w")).where(reduce(lambda a, b: a | b, (t.isNotNull() for t in terms)))
    return some.select("s", other, place, reduce(lambda a, b: a + b, (F.coalesce(t, F.lit(0.0)) for t in terms)).alias("v"))


def _sums(rows: DataFrame, by: list[str], weights: list[Column], place: str) -> DataFrame:
    """by, place and v: sums of v by each weight, one aggregation for all; a weight that is null everywhere has no row."""
    sums = rows.groupBy(*by).agg(*(F.sum(F.col("v") * w).alias(f"t{k}") for k, w in enumerate(weights)))
    listed = sums.select(*by, F.posexplode(F.array(*(f"t{k}" for k in range(len(weights))))).alias(place, "v"))
    return listed.where(F.col("v").isNotNull()).withColumn(place, F.col(place).cast("long"))


def _inner(rows: DataFrame, o: Explicit, place: str, other: str) -> DataFrame:
    """The adjoint of a narrow matrix along `place` of rows (s, place, other, v), which are added up where they are."""
    weights = [F.col(f"w{k}") for k in range(o.dim_size)]
    return _sums(rows.join(_rows_of(o, place, "w"), place), ["s", other], weights, place)


class Kron(Op):
    """The Kronecker product of two linear operators, never formed: A X B^T for the matrix X of an item."""

    def __init__(self, a: Op, b: Op):
        super().__init__(a.dim_size * b.dim_size, a.codim_size * b.codim_size, LINEAR | (a.props & b.props & _OF_BOTH))
        self.a, self.b, self.lipschitz = a, b, a.lipschitz * b.lipschitz

    @staticmethod
    def _factor(df: DataFrame, run, shape, size: int, place: str, other: str) -> DataFrame:
        """One factor along `place`; items are told apart by s and by the place in the other factor, of `size`."""
        x = Grid(df.select((F.col("s") * size + F.col(other)).alias("s"), *unravel(F.col(place), shape), "v"), shape)
        y = run(x)
        back = F.floor(F.col("s") / size).alias("s"), F.pmod("s", F.lit(size)).alias(other)
        return y.df.select(*back, ravel(y.shape).alias(place), "v")

    @staticmethod
    def _places(x: Grid, n: int) -> DataFrame:
        """s, a, b (of n places) and v."""
        return x.df.select("s", F.floor(F.col("i0") / n).alias("a"), F.pmod("i0", F.lit(n)).alias("b"), "v")

    def apply(self, x):
        a, b = self.a, self.b
        rows = self._places(x, b.dim_size)
        if _narrow(b) and not _narrow(a):
            rows = self._factor(rows, a.apply, a.dim, b.dim_size, "a", "b")
            rows = _outer(rows, b, "b", "a", a.codim_size)
        else:
            rows = self._factor(rows, b.apply, b.dim, a.dim_size, "b", "a")
            rows = _outer(rows, a, "a", "b", b.codim_size) if _narrow(a) else self._factor(rows, a.apply, a.dim, b.codim_size, "a", "b")
        return Grid(rows.select("s", (F.col("a") * b.codim_size + F.col("b")).alias("i0"), "v"), self.codim)

    def adjoint(self, y):
        a, b = self.a, self.b
        rows = self._places(y, b.codim_size)
        if _narrow(a) and not _narrow(b):
            rows = _inner(rows, a, "a", "b")
            rows = self._factor(rows, b.adjoint, b.codim, a.dim_size, "b", "a")
        else:
            rows = _inner(rows, b, "b", "a") if _narrow(b) else self._factor(rows, b.adjoint, b.codim, a.codim_size, "b", "a")
            rows = self._factor(rows, a.adjoint, a.codim, b.dim_size, "a", "b")
        return Grid(rows.select("s", (F.col("a") * b.dim_size + F.col("b")).alias("i0"), "v"), self.dim)

    def gram(self):
        return Kron(self.a.gram(), self.b.gram())

    def cogram(self):
        return Kron(self.a.cogram(), self.b.cogram())

    def trace(self, spark, **kwargs):
        return self.a.trace(spark, **kwargs) * self.b.trace(spark, **kwargs)

    def own_svdvals(self, spark, k: int = 1):
        """The k largest products of values of both factors."""
        each = [o.svdvals(spark, min(k, o.dim_size, o.codim_size)) for o in (self.a, self.b)]
        return np.sort(np.outer(*each).ravel())[-k:]

    def children(self):
        return self.a, self.b


class KhatriRao(Op):
    """The column-wise Kronecker product, never formed: column c is that of A times that of B."""

    def __init__(self, a: Op, b: Op):
        if a.dim != b.dim:
            raise ValueError("the matrices need as many columns")
        super().__init__(a.dim, a.codim_size * b.codim_size, LINEAR)
        self.a, self.b, self.lipschitz = a, b, a.lipschitz * b.lipschitz

    def _second(self, spark) -> DataFrame:
        return self.b.asarray(spark).select(F.col("row").alias("b"), F.col("col").alias("c"), "w")

    def apply(self, x):
        n = self.b.codim_size
        flat = x.df.select("s", ravel(x.shape).alias("c"), "v").join(self._second(x.spark), "c")
        if _narrow(self.a):
            rows = _outer(flat.select("s", "b", "c", (F.col("v") * F.col("w")).alias("v")).withColumnRenamed("c", "a"), self.a, "a", "b", n)
            return Grid(rows.select("s", (F.col("a") * n + F.col("b")).alias("i0"), "v"), self.codim)
        items = flat.select((F.col("s") * n + F.col("b")).alias("s"), *unravel(F.col("c"), self.dim), (F.col("v") * F.col("w")).alias("v"))
        y = self.a.apply(Grid(items, self.dim))
        place = ravel(y.shape) * n + F.pmod("s", F.lit(n))
        return Grid(y.df.select(F.floor(F.col("s") / n).alias("s"), place.alias("i0"), "v"), self.codim)

    def adjoint(self, y):
        n = self.b.codim_size
        if _narrow(self.a) and _narrow(self.b):
            rows = Kron._places(y, n).join(_rows_of(self.b, "b", "w"), "b").join(_rows_of(self.a, "a", "u"), "a")
            total = _sums(rows, ["s"], [F.col(f"w{k}") * F.col(f"u{k}") for k in range(self.dim_size)], "c")
            return Grid(total.select("s", *unravel(F.col("c"), self.dim), "v"), self.dim)
        rows = y.df.select((F.col("s") * n + F.pmod("i0", F.lit(n))).alias("s"), *unravel(F.floor(F.col("i0") / n), self.a.codim), "v")
        x = self.a.adjoint(Grid(rows, self.a.codim))
        flat = x.df.select(F.floor(F.col("s") / n).alias("s"), F.pmod("s", F.lit(n)).alias("b"), ravel(x.shape).alias("c"), "v").join(self._second(y.spark), ["b", "c"])
        total = flat.groupBy("s", "c").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
        return Grid(total.select("s", *unravel(F.col("c"), self.dim), "v"), self.dim)

    def children(self):
        return self.a, self.b


def _operator(m: Op | DataFrame, shape) -> Op:
    return m if isinstance(m, Op) else Explicit(m, shape[1], shape[0])


def kron(a: Op | DataFrame, b: Op | DataFrame, shape_a=None, shape_b=None) -> Kron:
    """Of two operators, or of two matrices (row, col, w) with their shapes."""
    return Kron(_operator(a, shape_a), _operator(b, shape_b))


def khatri_rao(a: Op | DataFrame, b: Op | DataFrame, shape_a=None, shape_b=None) -> KhatriRao:
    """Of two operators, or of two matrices (row, col, w) with their shapes."""
    return KhatriRao(_operator(a, shape_a), _operator(b, shape_b))
