"""Queries over the test tables, one for each operator, and the SQL that each is checked against."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid import sqltext as t
from fluxgrid.functions import linalg
from fluxgrid.functions.complex import as_real_matrix, view_as_complex, view_as_real
from fluxgrid.functions.interop import from_matvec, from_source, vectorize
from fluxgrid.operators import axes, blocks, diff, fft, filters, linop, maps, norm, select, stencil
from fluxgrid.plans.grid import Grid, grid
from fluxgrid.plans.op import DIFF_FUNC, LINEAR, POS_DEF, Op
from fluxgrid.samplers import moments
from fluxgrid.samplers.langevin import MYULA, ULA
from fluxgrid.solvers import cg, gradient, splitting
from fluxgrid.solvers.stop import AbsError, MaxIter, RelError
from fluxgrid.sources import signals
from fluxgrid.streaming.moments import windowed_moments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def out(g: Grid, item: bool = False, rename: dict[str, str] | None = None) -> DataFrame:
    """Places and values to 6 digits."""
    ks = g.keys if item else g.keys[1:]
    return g.df.select(*(F.col(k).alias((rename or {}).get(k, k)) for k in ks), (F.round("v", 6) + F.lit(0.0)).alias("v"))


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def on(name: str, signal: str, make: Callable[[Grid], Grid] | Op, sql: str | None = None, dense: bool = False, rename: dict[str, str] | None = None) -> None:
    """A query that applies an operator, or a function of the signal, to a signal."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = getattr(signals, signal)(spark, sf_dir)
        y = make(x) if isinstance(make, Op) or callable(make) else make
        return out(y.dense() if dense else y, signal in ("vec", "tile"), rename)

    add(name, query, sql)


# -- element-wise maps and their Jacobians ------------------------------------------------------------------------------
# name: (class, the argument as an expression of an embedding's value, SQL of the map, SQL of its slope)
_SIG = "(1 / (1 + exp(-x)))"
_UFUNCS = {
    "sin": (maps.Sin, "v", "sin(x)", "cos(x)"), "cos": (maps.Cos, "v", "cos(x)", "-sin(x)"), "tan": (maps.Tan, "v", "tan(x)", "1 / (cos(x) * cos(x))"),
    "arcsin": (maps.ArcSin, "tanh(v)", "asin(x)", "1 / sqrt(1 - x * x)"), "arccos": (maps.ArcCos, "tanh(v)", "acos(x)", "-1 / sqrt(1 - x * x)"), "arctan": (maps.ArcTan, "v", "atan(x)", "1 / (1 + x * x)"),
    "sinh": (maps.Sinh, "v", "sinh(x)", "cosh(x)"), "cosh": (maps.Cosh, "v", "cosh(x)", "sinh(x)"), "tanh": (maps.Tanh, "v", "tanh(x)", "1 - tanh(x) * tanh(x)"),
    "arcsinh": (maps.ArcSinh, "v", "asinh(x)", "1 / sqrt(1 + x * x)"), "arccosh": (maps.ArcCosh, "2 + abs(v)", "acosh(x)", "1 / sqrt(x * x - 1)"), "arctanh": (maps.ArcTanh, "tanh(v) / 2", "atanh(x)", "1 / (1 - x * x)"),
    "exp": (maps.Exp, "v", "exp(x)", "exp(x)"), "log": (maps.Log, "1 + abs(v)", "ln(x)", "1 / x"), "sqrt": (maps.Sqrt, "1 + abs(v)", "sqrt(x)", "0.5 / sqrt(x)"), "cbrt": (maps.Cbrt, "1 + abs(v)", "cbrt(x)", "1 / (3 * cbrt(x) * cbrt(x))"),
    "square": (maps.Square, "v", "x * x", "2 * x"), "abs": (maps.Abs, "v", "abs(x)", None), "sign": (maps.Sign, "v", "sign(x)", None), "gaussian": (maps.Gaussian, "v", "exp(-x * x)", "-2 * x * exp(-x * x)"),
    "sigmoid": (maps.Sigmoid, "v", _SIG, f"{_SIG} * (1 - {_SIG})"), "softplus": (maps.SoftPlus, "v", "ln(1 + exp(x))", _SIG), "silu": (maps.SiLU, "v", f"x * {_SIG}", f"{_SIG} * (1 + x * (1 - {_SIG}))"), "relu": (maps.ReLU, "v", "greatest(x, 0.0)", None),
}
for _n, (_c, _arg, _f, _d) in _UFUNCS.items():
    def _apply(x: Grid, c=_c, a=_arg) -> Grid:
        return c(x.shape).apply(Grid(x.df.withColumn("v", F.expr(a)), x.shape))

    def _slope(x: Grid, c=_c, a=_arg) -> Grid:
        return c(x.shape).jacobian(Grid(x.df.withColumn("v", F.expr(a)), x.shape)).apply(x)

    on(f"uf_{_n}", "vec", _apply, t.each("vec", _f.replace("exp", "EXP").replace("x", f"({_arg})").replace("EXP", "exp") if "max" not in _f else _f))
    if _d:
        on(f"jac_{_n}", "vec", _slope, t.each("vec", "v * (" + _d.replace("exp", "EXP").replace("x", f"({_arg})").replace("EXP", "exp") + ")"))
on("uf_exp_base2", "vec", lambda x: maps.Exp(64, 2).apply(x), t.each("vec", "pow(2.0, v)"))
on("uf_log_base10", "vec", lambda x: maps.Log(64, 10).apply(x.map(lambda v: F.abs(v) + 1)), t.each("vec", "log10(abs(v) + 1)"))
on("uf_log_edges", "vec", lambda x: maps.Log(64).apply(x.map(lambda v: F.when(v > 0, 0.0).otherwise(1.0))), t.each("vec", "case when v > 0 then '-inf'::double else 0.0 end"))
on("uf_clip", "vec", lambda x: maps.Clip(64, -0.5, 0.25).apply(x), t.each("vec", "greatest(-0.5, least(0.25, v))"))
on("uf_leakyrelu", "vec", lambda x: maps.LeakyReLU(64, 0.1).apply(x), t.each("vec", "case when v >= 0 then v else 0.1 * v end"))
on("uf_constant", "vec", lambda x: maps.ConstantValued(64, 64, 2.5).apply(x), t.each("vec", "2.5"))

# -- axes, selection, padding, sums -------------------------------------------------------------------------------------
_H, _TI = t.with_("heat"), t.with_("tile")
on("ax_transpose", "heat", axes.TransposeAxes((30, 24)), _H + f"select i1::bigint as i0, i0::bigint as i1, {t.rounded('v')} from heat")
on("ax_squeeze", "heat", lambda x: axes.SqueezeAxes((30, 1, 24)).apply(axes.ReshapeAxes((30, 24), (30, 1, 24)).apply(x)), t.each("heat", "v"))
on("ax_reshape", "heat", axes.ReshapeAxes((30, 24), (20, -1)), _H + f"select ((i0 * 24 + i1) // 36)::bigint as i0, ((i0 * 24 + i1) % 36)::bigint as i1, {t.rounded('v')} from heat")
on("ax_broadcast", "daily", lambda x: axes.BroadcastAxes((2499,), (3, 2499)).apply(x), t.with_("daily") + f"select k::bigint as i0, i0::bigint as i1, {t.rounded('v')} from daily cross join (select unnest([0, 1, 2]) k)")
on("ax_broadcast_adj", "heat", lambda x: axes.BroadcastAxes((1, 24), (30, 24)).adjoint(x), _H + f"select 0::bigint as i0, i1::bigint as i1, {t.rounded('sum(v)')} from heat group by i1")
on("ax_rechunk", "heat", axes.RechunkAxes((30, 24), 4), t.each("heat", "v"))
on("sub_int", "heat", select.SubSample((30, 24), 3), _H + f"select 0::bigint as i0, i1::bigint as i1, {t.rounded('v')} from heat where i0 = 3")
on("sub_list", "heat", select.SubSample((30, 24), [-2, 9, 4]), _H + f"select case i0 when 28 then 0 when 9 then 1 else 2 end::bigint as i0, i1::bigint as i1, {t.rounded('v')} from heat where i0 in (28, 9, 4)")
on("sub_bool", "heat", select.SubSample((30, 24), slice(None), [True, False] * 12), _H + f"select i0::bigint as i0, (i1 // 2)::bigint as i1, {t.rounded('v')} from heat where i1 % 2 = 0")
on("sub_slice_neg", "daily", select.SubSample((2499,), slice(2400, 100, -7)), t.with_("daily") + f"select ((2400 - i0) // 7)::bigint as i0, {t.rounded('v')} from daily where i0 <= 2400 and i0 > 100 and (2400 - i0) % 7 = 0")
on("sub_adj", "daily", lambda x: (lambda s: s.adjoint(s.apply(x)).dense())(select.SubSample((2499,), slice(0, None, 3))), t.each("daily", "case when i0 % 3 = 0 then v else 0.0 end"))
on("sub_twice_adj", "heat", lambda x: (lambda s: s.adjoint(s.apply(x)))(select.SubSample((30, 24), [5, 5, 7])), _H + f"select i0::bigint as i0, i1::bigint as i1, {t.rounded('v * case i0 when 5 then 2 else 1 end')} from heat where i0 in (5, 7)")
on("trim", "heat", select.Trim((30, 24), ((2, 3), (1, 2))), _H + f"select (i0 - 2)::bigint as i0, (i1 - 1)::bigint as i1, {t.rounded('v')} from heat where i0 between 2 and 26 and i1 between 1 and 21")


def _padded(modes: tuple[str, str], widths: tuple[int, int]) -> str:
    a, b = widths
    ij = [t.source(f"(g.i{k} - {w})", n, m) for k, (w, n, m) in enumerate(zip(widths, (30, 24), modes, strict=True))]
    return _H + f"select g.i0::bigint as i0, g.i1::bigint as i1, {t.rounded('x.v')} from (select * from (select unnest(generate_series(0, {29 + 2 * a})) i0) cross join (select unnest(generate_series(0, {23 + 2 * b})) i1)) g join heat x on x.i0 = {ij[0]} and x.i1 = {ij[1]}"


def _unpadded(modes: tuple[str, str], widths: tuple[int, int]) -> str:
    """The adjoint on the signal padded with zeros and 1 added: y[j] = 1 + x[j - w]."""
    a, b = widths
    ij = [t.source(f"(g.i{k} - {w})", n, m) for k, (w, n, m) in enumerate(zip(widths, (30, 24), modes, strict=True))]
    y = f"(select g.i0, g.i1, 1 + coalesce(x.v, 0.0) v from (select * from (select unnest(generate_series(0, {29 + 2 * a})) i0) cross join (select unnest(generate_series(0, {23 + 2 * b})) i1)) g left join heat x on x.i0 = g.i0 - {a} and x.i1 = g.i1 - {b})"
    return _H + f"select i0::bigint as i0, i1::bigint as i1, {t.rounded('sum(v)')} from (select {ij[0]} i0, {ij[1]} i1, g.v from {y} g) where i0 between 0 and 29 and i1 between 0 and 23 group by i0, i1"


for _m in select.MODES:
    on(f"pad_{_m}", "heat", lambda x, m=_m: select.Pad((30, 24), (3, 2), m).apply(x), _padded((_m, _m), (3, 2)))
    on(f"pad_{_m}_adj", "heat", lambda x, m=_m: select.Pad((30, 24), (3, 2), m).adjoint(select.Pad((30, 24), (3, 2)).apply(x).dense().map(lambda v: v + 1)), _unpadded((_m, _m), (3, 2)))
on("pad_mixed_2d", "heat", lambda x: select.Pad((30, 24), (3, 2), ("wrap", "reflect")).apply(x), _padded(("wrap", "reflect"), (3, 2)))
on("sum_all", "heat", axes.Sum((30, 24)), _H + f"select 0::bigint as i0, 0::bigint as i1, {t.rounded('sum(v)')} from heat")
on("sum_axis0", "heat", axes.Sum((30, 24), 0), _H + f"select 0::bigint as i0, i1::bigint as i1, {t.rounded('sum(v)')} from heat group by i1")
on("sum_axis01", "tile", axes.Sum((8, 8), (0, 1)), _TI + f"select s::bigint as s, 0::bigint as i0, 0::bigint as i1, {t.rounded('sum(v)')} from tile group by s")
on("sum_adj", "heat", lambda x: (lambda s: s.adjoint(s.apply(x)))(axes.Sum((30, 24), 1)), _H + f"select i0::bigint as i0, i1::bigint as i1, {t.rounded('sum(v) over (partition by i0)')} from heat")
add("sum_multi_axes", lambda spark, d: axes.sums_over(signals.heat(spark, d), [(0,), (1,), (0, 1)]).select(*(F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("i0", "i1")), "v"), _H + "select coalesce(i0, -1)::bigint as i0, coalesce(i1, -1)::bigint as i1, sum(v) as v from heat group by grouping sets ((i1), (i0), ())")

# -- linear operators ---------------------------------------------------------------------------------------------------
_M = t.with_("mat unit")


def _matrix(spark: SparkSession, d: str) -> linop.Explicit:
    table, n = signals.mat(spark, d)
    return linop.Explicit(table, 7, n)


def _values(spark: SparkSession, values) -> DataFrame:
    """Singular values, numbered from the smallest."""
    return spark.createDataFrame([(k, round(float(v), 4)) for k, v in enumerate(values)], "k long, sv double")


def _seven(spark: SparkSession) -> Grid:
    return grid(spark.range(7).select(F.col("id").alias("i0"), (F.col("id") + 1).alias("v")), 7)


on("homothety", "vec", linop.Homothety(64, 2.5), t.each("vec", "2.5 * v"))
on("identity", "vec", linop.Identity(64), t.each("vec", "v"))
on("null_op", "vec", lambda x: linop.Null(64, 64).apply(x), t.each("vec", "0.0"))


def _ramp(x: Grid) -> Grid:
    return grid(x.spark.range(64).select(F.col("id").alias("i0"), (F.col("id") - 20).alias("v")), 64)


on("diagonal", "vec", lambda x: linop.Diagonal(_ramp(x), shared=True).apply(x), t.each("vec", "v * (i0 - 20)"))
on("diagonal_pinv", "vec", lambda x: linop.Diagonal(_ramp(x), shared=True).pinv(x, 0.5), t.each("vec", "v * (i0 - 20) / ((i0 - 20) * (i0 - 20) + 0.5)"))
add("diagonal_topk", lambda spark, d: linop.Diagonal(signals.daily(spark, d)).largest(10).select(F.round("sv", 6).alias("sv")), t.with_("daily") + "select round(abs(v), 6) as sv from daily order by abs(v) desc limit 10")
add("matvec", lambda spark, d: out(_matrix(spark, d).apply(_seven(spark))), _M + f"select r::bigint as i0, {t.rounded('sum(w * v)')} from mat join unit using (c) group by r")
add("matvec_adj", lambda spark, d: out((lambda a: a.adjoint(grid(spark.range(a.codim[0]).select(F.col("id").alias("i0"), (F.col("id") % 5).alias("v")), a.codim)))(_matrix(spark, d))), _M + f"select c::bigint as i0, {t.rounded('sum(w * (r % 5))')} from mat group by c")
add("gram", lambda spark, d: out(_matrix(spark, d).gram().apply(_seven(spark))), _M + f"select a.c::bigint as i0, {t.rounded('sum(a.w * b.w * u.v)')} from mat a join mat b on a.r = b.r join unit u on u.c = b.c group by a.c")
add("cogram", lambda spark, d: out((lambda a: a.cogram().apply(grid(spark.range(a.codim[0]).select(F.col("id").alias("i0"), (F.col("id") % 5).alias("v")), a.codim)))(_matrix(spark, d))), _M + f"select a.r::bigint as i0, {t.rounded('sum(a.w * b.t)')} from mat a join (select c, sum(w * (r % 5)) t from mat group by c) b using (c) group by a.r")
add("transpose_op", lambda spark, d: out((lambda a: a.T.apply(grid(spark.range(a.codim[0]).select(F.col("id").alias("i0"), (F.col("id") % 3).alias("v")), a.codim)))(_matrix(spark, d))), _M + f"select c::bigint as i0, {t.rounded('sum(w * (r % 3))')} from mat group by c")
add("trace", lambda spark, d: spark.createDataFrame([(float(_matrix(spark, d).gram().trace(spark)),)], "tr double"), _M + "select sum(w * w) as tr from mat")
add("asarray", lambda spark, d: linalg.asarray(_matrix(spark, d).gram() * 0.5, spark).where("w <> 0"), _M + "select a.c::bigint as row, b.c::bigint as col, sum(a.w * b.w) / 2 as w from mat a join mat b using (r) group by a.c, b.c")
add("kron", lambda spark, d: out(linop.kron(_matrix(spark, d), _matrix(spark, d)).apply(grid(spark.range(49).select(F.col("id").alias("i0"), (F.col("id") % 4).alias("v")), 49))), _M + f"select (a.r * n + b.r)::bigint as i0, {t.rounded('sum(a.w * b.w * ((a.c * 7 + b.c) % 4))')} from mat a cross join mat b cross join (select count(*) n from supplier) group by 1")
_PAIRED = lambda spark, n, k: grid(spark.range(n).select(F.col("id").alias("i0"), (F.col("id") % k).alias("v")), n)
add("kron_adj", lambda spark, d: out((lambda o: o.adjoint(_PAIRED(spark, o.codim[0], 5)))(linop.kron(_matrix(spark, d), _matrix(spark, d)))), _M + f"select (a.c * 7 + b.c)::bigint as i0, {t.rounded('sum(a.w * b.w * ((a.r * n + b.r) % 5))')} from mat a cross join mat b cross join (select count(*) n from supplier) group by 1")
add("kron_trace", lambda spark, d: spark.createDataFrame([(float((lambda g: linop.kron(g, g * 2.0))(_matrix(spark, d).gram()).trace(spark)),)], "tr double"), _M + "select 2 * sum(w * w) * sum(w * w) as tr from mat")
add("kron_svdvals", lambda spark, d: _values(spark, (lambda w: linop.kron(w, w * 0.5).svdvals(spark, 6))(linop.Diagonal(signals.daily(spark, d)))), t.with_("daily") + "select (6 - row_number() over (order by p desc))::bigint as k, round(p, 4) as sv from (select a.v * b.v / 2 as p from daily a cross join daily b) order by p desc limit 6")
add("khatri_rao_adj", lambda spark, d: out((lambda o: o.adjoint(_PAIRED(spark, o.codim[0], 5)))(linop.khatri_rao(_matrix(spark, d), _matrix(spark, d)))), _M + f"select a.c::bigint as i0, {t.rounded('sum(a.w * b.w * ((a.r * n + b.r) % 5))')} from mat a join mat b using (c) cross join (select count(*) n from supplier) group by 1")
_BLOCKS = lambda spark, d: (lambda a: blocks.block_diag([a, a * 2.0]))(_matrix(spark, d))
add("block_asarray", lambda spark, d: _BLOCKS(spark, d).asarray(spark), _M + "select (k * n + r)::bigint as row, (k * 7 + c)::bigint as col, w * (k + 1) as w from mat cross join (select unnest([0, 1]) k) cross join (select count(*) n from supplier)")
add("block_gram", lambda spark, d: _BLOCKS(spark, d).gram().asarray(spark).where("w <> 0"), _M + "select (k * 7 + a.c)::bigint as row, (k * 7 + b.c)::bigint as col, sum(a.w * b.w) * (k + 1) * (k + 1) as w from mat a join mat b using (r) cross join (select unnest([0, 1]) k) group by k, a.c, b.c")
add("block_trace", lambda spark, d: spark.createDataFrame([(float(_BLOCKS(spark, d).gram().trace(spark)),)], "tr double"), _M + "select 5 * sum(w * w) as tr from mat")
add("block_svdvals", lambda spark, d: _values(spark, (lambda w: blocks.block_diag([w, w * 1.5]).svdvals(spark, 8))(linop.Diagonal(signals.daily(spark, d)))), t.with_("daily") + "select (8 - row_number() over (order by p desc))::bigint as k, round(p, 4) as sv from (select v * f as p from daily cross join (select unnest([1.0, 1.5]) f)) order by p desc limit 8")


def _circulant(spark: SparkSession, d: str) -> Op:
    """Correlation of 2,499 places with the sums of the embeddings' 64 components."""
    rows = signals.read(spark, d, "embeddings").select(F.posexplode("embedding").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("double")).alias("w")).orderBy("k").limit(64).collect()
    return stencil.Stencil(2499, [r["w"] for r in rows], 0, "wrap")


_SPECTRUM = """with w as (select k, sum(v::double) as w from (select unnest(generate_series(0, 63)) as k, unnest(embedding) as v from embeddings) group by k),
    s as (select n, sqrt(pow(sum(w * cos(2 * pi() * ((k * n) % 2499) / 2499)), 2) + pow(sum(w * sin(2 * pi() * ((k * n) % 2499) / 2499)), 2)) as sv from w cross join (select unnest(generate_series(0, 2498)) n) group by n)
    """
add("svdvals_circulant", lambda spark, d: _values(spark, _circulant(spark, d).svdvals(spark, 3)), _SPECTRUM + "select (3 - row_number() over (order by sv desc))::bigint as k, round(sv, 4) as sv from s order by sv desc limit 3")
add("khatri_rao", lambda spark, d: out((lambda m, n: linop.khatri_rao(m, m, (n, 7), (n, 7)))(*signals.mat(spark, d)).apply(_seven(spark))), _M + f"select (a.r * n + b.r)::bigint as i0, {t.rounded('sum(a.w * b.w * u.v)')} from mat a join mat b using (c) join unit u using (c) cross join (select count(*) n from supplier) group by 1")
on("linfunc_dot", "vec", lambda x: linop.LinFunc(_ramp(x), shared=True).apply(x), t.with_("vec") + f"select s::bigint as s, 0::bigint as i0, {t.rounded('sum(v * (i0 - 20))')} from vec group by s")
add("svdvals", lambda spark, d: spark.createDataFrame([(k, float(v)) for k, v in enumerate(_matrix(spark, d).svdvals(spark, 3))], "k long, sv double"))
# The cogram has a place for each supplier and a rank of 7, within which a sketch of 8 is exact; the sums are whole numbers.
add("hutchpp", lambda spark, d: spark.createDataFrame([(round(float(_matrix(spark, d).cogram().trace(spark, method="hutchpp", m=24)), 0),)], "tr double"), _M + "select round(sum(w * w), 0) as tr from mat")
add("lipschitz", lambda spark, d: spark.createDataFrame([(round((linop.Diagonal(signals.daily(spark, d)) * 0.5).estimate_lipschitz(spark), 6),)], "l double"), t.with_("daily") + "select round(max(abs(v)) / 2, 6) as l from daily")

# -- stencils, filters, derivatives -------------------------------------------------------------------------------------
_SMOOTH = {-1: 0.25, 0: 0.5, 1: 0.25}
_K2 = {(a, b): float(1 + (2 * (a + 1) + b) % 5) for a in (-1, 0, 1) for b in (0, 1)}


def _k2():
    import numpy as np

    return np.array([[_K2[a, b] for b in (0, 1)] for a in (-1, 0, 1)])


for _m in select.MODES:
    on(f"stencil_1d_{_m}", "daily", lambda x, m=_m: stencil.Stencil(2499, [1.0, 2.0, 3.0, 4.0], 1, m).apply(x), t.filled("daily", t.correlate("daily", t.outer({-1: 1.0, 0: 2.0, 1: 3.0, 2: 4.0}), _m)))
    on(f"stencil_2d_{_m}", "heat", lambda x, m=_m: stencil.Stencil((30, 24), _k2(), (1, 0), m).apply(x), t.filled("heat", t.correlate("heat", _K2, _m)))
    on(f"stencil_adj_{_m}", "heat", lambda x, m=_m: stencil.Stencil((30, 24), _k2(), (1, 0), m).adjoint(x).dense(), t.filled("heat", t.correlate("heat", _K2, _m, back=True)))
on("stencil_separable", "heat", lambda x: stencil.Stencil((30, 24), [[0.25, 0.5, 0.25], [1.0, -1.0]], (1, 0), ("reflect", "edge")).apply(x), t.filled("heat", t.correlate("heat", t.outer(_SMOOTH, {0: 1.0, 1: -1.0}), ["reflect", "edge"])))
on("convolve", "daily", lambda x: stencil.Convolve(2499, [1.0, 2.0, 3.0, 4.0], 1).apply(x), t.filled("daily", t.correlate("daily", t.outer({1: 1.0, 0: 2.0, -1: 3.0, -2: 4.0}))))
on("fft_correlate", "tile", lambda x: fft.FFTCorrelate((8, 8), _k2(), (1, 0), "wrap").apply(x), t.filled("tile", t.correlate("tile", _K2, "wrap")))
on("fft_convolve", "tile", lambda x: fft.FFTConvolve((8, 8), _k2(), (1, 0)).apply(x), t.filled("tile", t.correlate("tile", {(-a, -b): w for (a, b), w in _K2.items()})))
on("moving_average", "daily", lambda x: filters.MovingAverage(2499, 7).apply(x), t.filled("daily", t.correlate("daily", t.outer({k: 1 / 7 for k in range(-3, 4)}))))
on("gaussian_filter", "heat", lambda x: filters.GaussianFilter((30, 24), 1.0, mode="reflect").apply(x), t.filled("heat", t.correlate("heat", t.outer(t.bell(1.0), t.bell(1.0)), "reflect")))
on("gaussian_filter_order1", "heat", lambda x: filters.GaussianFilter((30, 24), 1.0, order=(1, 0)).apply(x), t.filled("heat", t.correlate("heat", t.outer(t.bell_slope(1.0), t.bell(1.0)))))
on("dog", "daily", lambda x: filters.DoG(2499, 1.0).apply(x), t.filled("daily", t.correlate("daily", t.mix((1, t.outer(t.bell(1.0))), (-1, t.outer(t.bell(1.6)))))))
on("laplace", "heat", lambda x: filters.Laplace((30, 24)).apply(x), t.filled("heat", t.correlate("heat", t.mix((1, t.outer(t.SECOND, t.ONE)), (1, t.outer(t.ONE, t.SECOND))))))
_EDGE, _D2 = {-1: -1.0, 1: 1.0}, "sqrt(coalesce(c.v, 0.0)) / sqrt(2.0)"
for _n, _f, _w in (("sobel", filters.Sobel, (0.25, 0.5)), ("prewitt", filters.Prewitt, (1 / 3, 1 / 3)), ("scharr", filters.Scharr, (3 / 16, 10 / 16))):
    _s = {-1: _w[0], 0: _w[1], 1: _w[0]}
    _a, _b = t.correlate("heat", t.outer(_EDGE, _s)), t.correlate("heat", t.outer(_s, _EDGE))
    on(_n, "heat", lambda x, f=_f: f((30, 24)).apply(x), t.filled("heat", f"(select i0, i1, sum(v * v) v from (select * from {_a} union all select * from {_b}) group by i0, i1)", _D2))
    on(f"{_n}_axis0", "heat", lambda x, f=_f: f((30, 24), axis=0).apply(x), t.filled("heat", _a))
_GX, _GY = t.correlate("heat", t.outer(t.CENTRAL, t.ONE)), t.correlate("heat", t.outer(t.ONE, t.CENTRAL))
_PAIR = "gs as (select x.i0, x.i1, coalesce(a.v, 0.0) a, coalesce(b.v, 0.0) b from heat x left join {} a using (i0, i1) left join {} b using (i0, i1))".format(_GX, _GY)
on("structure_tensor", "heat", lambda x: filters.StructureTensor((30, 24), smooth_sigma=0).apply(x), t.with_("heat", _PAIR) + " union all ".join(f"select {k}::bigint as i0, i0::bigint as i1, i1::bigint as i2, {t.rounded(e)} from gs" for k, e in enumerate(("a * a", "a * b", "b * b"))))
_BELLS = t.outer(t.bell(1.0), t.bell(1.0))
on("structure_tensor_smooth", "heat", lambda x: filters.StructureTensor((30, 24)).apply(x), t.with_("heat", _PAIR, *(f"p{k} as (select i0, i1, {e} v from gs)" for k, e in enumerate(("a * a", "a * b", "b * b")))) + " union all ".join(f"select {k}::bigint as i0, i0::bigint as i1, i1::bigint as i2, {t.rounded('v')} from {t.correlate('heat', _BELLS, of=f'p{k}')}" for k in range(3)))

_FW, _C2 = t.FORWARD, t.SECOND
_D0, _D1 = t.outer(_FW, t.ONE), t.outer(t.ONE, _FW)
_H00, _H01, _H11 = t.outer(_C2, t.ONE), t.outer(_FW, _FW), t.outer(t.ONE, _C2)
_K0 = {"i0": "k0", "i1": "i0", "i2": "i1"}


def _stacked(*taps) -> str:
    return t.stacked("heat", [t.correlate("heat", x) for x in taps])


def _conv(*taps, mode="constant") -> str:
    return t.filled("heat", t.correlate("heat", t.mix(*taps), mode))


_S = (30, 24)
on("pd_fd", "heat", lambda x: diff.finite_difference(_S, (1, 0)).apply(x), _conv((1, _D0)))
on("pd_fd_mixed_backward", "heat", lambda x: diff.finite_difference(_S, (2, 1), scheme="backward", mode=("edge", "constant")).apply(x), t.filled("heat", t.correlate("heat", t.outer({-2: 1.0, -1: -2.0, 0: 1.0}, {-1: -1.0, 0: 1.0}), ["edge", "constant"])))
on("pd_gd", "heat", lambda x: diff.gaussian_derivative(_S, (1, 0)).apply(x), _conv((1, t.outer(t.bell_slope(1.0), t.bell(1.0)))))
on("gradient", "heat", lambda x: diff.Gradient(_S).apply(x), _stacked(_D0, _D1), rename=_K0)
on("gradient_adj", "heat", lambda x: (lambda g: g.adjoint(g.apply(x)).dense())(diff.Gradient(_S)), t.filled("heat", "(select i0, i1, sum(v) v from (select * from {} union all select * from {}) group by i0, i1)".format(*(t.correlate("heat", k, of=f"(select * from {t.correlate('heat', k)})", back=True) for k in (_D0, _D1)))))
on("gradient_gd", "heat", lambda x: diff.Gradient(_S, method="gd").apply(x), _stacked(t.outer(t.bell_slope(1.0), t.ONE), t.outer(t.ONE, t.bell_slope(1.0))), rename=_K0)
on("hessian", "heat", lambda x: diff.Hessian(_S).apply(x), _stacked(_H00, _H01, _H11), rename=_K0)
on("laplacian", "heat", lambda x: diff.Laplacian(_S).apply(x), _conv((1, _H00), (1, _H11)))
on("laplacian_axis1", "heat", lambda x: diff.Laplacian(_S, directions=[1]).apply(x), _conv((1, _H11)))


def _field(x: Grid) -> Grid:
    """Two channels: the signal and twice the signal."""
    return Grid(x.df.select("s", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("v").alias("w")), F.struct(F.lit(1).alias("k"), (2 * F.col("v")).alias("w")))).alias("c"), "i0", "i1").select("s", F.col("c.k").cast("long").alias("i0"), F.col("i0").alias("i1"), F.col("i1").alias("i2"), F.col("c.w").alias("v")), (2, *x.shape))


on("divergence", "heat", lambda x: diff.Divergence((2, *_S)).apply(_field(x)), _conv((1, t.outer(t.CENTRAL, t.ONE)), (2, t.outer(t.ONE, t.CENTRAL))))
on("divergence_forward", "heat", lambda x: diff.Divergence((2, *_S), scheme="forward").apply(_field(x)), _conv((1, t.outer({-1: -1.0, 0: 1.0}, t.ONE)), (2, t.outer(t.ONE, {-1: -1.0, 0: 1.0}))))
on("jacobian_field", "heat", lambda x: diff.Jacobian((2, *_S)).apply(_field(x)), t.with_("heat") + " union all ".join(f"select {c}::bigint as i0, {k}::bigint as i1, x.i0::bigint as i2, x.i1::bigint as i3, {t.rounded(f'{c + 1} * coalesce(c.v, 0.0)')} from heat x left join {t.correlate('heat', taps)} c using (i0, i1)" for c in (0, 1) for k, taps in enumerate((_D0, _D1))))
_DX, _DY = 0.6, 0.8
on("dir_derivative", "heat", lambda x: diff.DirectionalDerivative(_S, 1, [3.0, 4.0]).apply(x), _conv((_DX, _D0), (_DY, _D1)))
on("dir_derivative2", "heat", lambda x: diff.DirectionalDerivative(_S, 2, [3.0, 4.0]).apply(x), _conv((_DX**2, _H00), (2 * _DX * _DY, _H01), (_DY**2, _H11)))
on("dir_gradient", "heat", lambda x: diff.DirectionalGradient(_S, [[1.0, 0.0], [3.0, 4.0]]).apply(x), _stacked(_D0, t.mix((_DX, _D0), (_DY, _D1))), rename=_K0)
on("dir_laplacian", "heat", lambda x: diff.DirectionalLaplacian(_S, [[1.0, 0.0], [3.0, 4.0]], [1.0, 2.0]).apply(x), _conv((1, _H00), (2 * _DX**2, _H00), (4 * _DX * _DY, _H01), (2 * _DY**2, _H11)))
on("dir_hessian", "heat", lambda x: diff.DirectionalHessian(_S, [[1.0, 0.0], [3.0, 4.0]], method="fd").apply(x), _stacked(_H00, t.mix((_DX, _H00), (2 * 0.0 + _DY * 2, _H01)), t.mix((_DX**2, _H00), (2 * _DX * _DY, _H01), (_DY**2, _H11))), rename=_K0)


def _varying(x: Grid) -> Grid:
    return Grid(x.df.select("s", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "i0", "i1").select("s", F.col("k").cast("long").alias("i0"), F.col("i0").alias("i1"), F.col("i1").alias("i2"), F.when(F.col("k") == 0, 1.0 + F.col("i0")).otherwise(1.0 + F.col("i1")).alias("v")), (2, *x.shape))


on("dir_derivative_varying", "heat", lambda x: diff.DirectionalDerivative(_S, 1, _varying(x)).apply(x), t.with_("heat") + f"select x.i0::bigint as i0, x.i1::bigint as i1, {t.rounded('((1 + x.i0) * coalesce(a.v, 0.0) + (1 + x.i1) * coalesce(b.v, 0.0)) / sqrt((1.0 + x.i0) * (1 + x.i0) + (1 + x.i1) * (1 + x.i1))')} from heat x left join {t.correlate('heat', _D0)} a using (i0, i1) left join {t.correlate('heat', _D1)} b using (i0, i1)")

# -- functionals --------------------------------------------------------------------------------------------------------
_V = t.with_("vec")


def _value(name: str, f: Callable[[], Op], e: str, signal: str = "vec", of: str | None = None) -> None:
    on(name, signal, lambda x: f().apply(x), t.with_(signal) + f"select s::bigint as s, 0::bigint as i0, {t.rounded(e)} from {of or signal} group by s")


def _windowed(e: str, pre: str) -> str:
    """An expression of v and of columns that `pre` adds by item."""
    return _V + f"select s::bigint as s, i0::bigint as i0, {t.rounded(e)} from (select *, {pre} from vec)"


_RANK = "abs(v) u, row_number() over (partition by s order by abs(v) desc, i0) k, sum(abs(v)) over (partition by s order by abs(v) desc, i0 rows unbounded preceding) c, sum(abs(v)) over (partition by s) n1"


def _thresholded(theta: str, e: str, kept: str = "false") -> str:
    """Sorted by absolute value: theta of the largest k whose value is above it."""
    inner = f"(select *, {_RANK} from vec)"
    found = f"(select *, last_value(case when u > {theta} then {theta} end ignore nulls) over (partition by s order by k rows between unbounded preceding and unbounded following) t from {inner})"
    return _V + f"select s::bigint as s, i0::bigint as i0, {t.rounded(f'case when {kept} then v else {e} end')} from {found}"


_SOFT = t.soft("v", "coalesce(t, 0.0)")
_L1PROJ = lambda r: _thresholded(f"((c - {r}) / k)", _SOFT, f"n1 <= {r}")
_value("l1", lambda: norm.L1Norm(64), "sum(abs(v))")
_value("l2", lambda: norm.L2Norm(64), "sqrt(sum(v * v))")
_value("sql2", lambda: norm.SquaredL2Norm(64), "sum(v * v)")
_value("sql1", lambda: norm.SquaredL1Norm(64), "pow(sum(abs(v)), 2)")
_value("linf", lambda: norm.LInfinityNorm(64), "max(abs(v))")
_value("l21", lambda: norm.L21Norm((8, 8)), "sum(n)", "tile", "(select s, i1, sqrt(sum(v * v)) n from tile group by s, i1)")
_value("pos_l1", lambda: norm.PositiveL1Norm(64), "case when min(v) >= -1000 then (case when bool_and(v >= 0) then sum(v) else 'inf'::double end) end")
for _n, _f, _e in (("ind_l1ball", lambda: norm.L1Ball(64, 6), "sum(abs(v)) <= 6"), ("ind_l2ball", lambda: norm.L2Ball(64, 1), "sqrt(sum(v * v)) <= 1"), ("ind_linfball", lambda: norm.LInfinityBall(64, 0.3), "max(abs(v)) <= 0.3"), ("ind_orthant", lambda: norm.PositiveOrthant(64), "bool_and(v >= 0)")):
    _value(_n, _f, f"case when {_e} then 0.0 else 'inf'::double end")
on("ind_hyperslab", "vec", lambda x: norm.HyperSlab(_ramp(x), -2, 2).apply(x), _V + f"select s::bigint as s, 0::bigint as i0, {t.rounded('''case when abs(sum(v * (i0 - 20))) <= 2 then 0.0 else 'inf'::double end''')} from vec group by s")
_PROX = {
    "l1": (lambda: norm.L1Norm(64), lambda tau: _windowed(t.soft("v", tau), "0 z")), "pos_l1": (lambda: norm.PositiveL1Norm(64), lambda tau: _windowed(f"greatest(v - {tau}, 0.0)", "0 z")),
    "l2": (lambda: norm.L2Norm(64), lambda tau: _windowed(f"v * (1 - {tau} / greatest(n, {tau}))", "sqrt(sum(v * v) over (partition by s)) n")), "sql2": (lambda: norm.SquaredL2Norm(64), lambda tau: _windowed(f"v / (1 + 2 * {tau})", "0 z")),
    "sql1": (lambda: norm.SquaredL1Norm(64), lambda tau: _thresholded(f"(2 * {tau} * c / (1 + 2 * {tau} * k))", _SOFT)), "linf": (lambda: norm.LInfinityNorm(64), lambda tau: _thresholded(f"((c - {tau}) / k)", f"v - {_SOFT}", f"n1 <= {tau}").replace("then v else", "then 0.0 else")),
    "l1ball": (lambda: norm.L1Ball(64, 2), lambda tau: _L1PROJ(2)), "l2ball": (lambda: norm.L2Ball(64, 0.5), lambda tau: _windowed("v * 0.5 / greatest(n, 0.5)", "sqrt(sum(v * v) over (partition by s)) n")), "linfball": (lambda: norm.LInfinityBall(64, 0.1), lambda tau: _windowed("greatest(-0.1, least(0.1, v))", "0 z")),
    "orthant": (lambda: norm.PositiveOrthant(64), lambda tau: _windowed("greatest(v, 0.0)", "0 z")),
}
for _n, (_f, _e) in _PROX.items():
    on(f"prox_{_n}", "vec", lambda x, f=_f: f().prox(x, 0.3), _e("0.3"))
on("prox_hyperslab", "vec", lambda x: norm.HyperSlab(_ramp(x), -2, 2).prox(x), _windowed("v + (i0 - 20) * (case when d < -2 then -2 - d when d > 2 then 2 - d else 0.0 end) / n", "sum(v * (i0 - 20)) over (partition by s) d, sum((i0 - 20) * (i0 - 20)) over (partition by s) n"))
on("prox_l21", "tile", lambda x: norm.L21Norm((8, 8)).prox(x, 0.3), _TI + f"select s::bigint as s, i0::bigint as i0, i1::bigint as i1, {t.rounded('v * (1 - 0.3 / greatest(n, 0.3))')} from (select *, sqrt(sum(v * v) over (partition by s, i1)) n from tile)")


def _data(x: Grid) -> Grid:
    return grid(x.spark.range(64).select(F.col("id").alias("i0"), (F.col("id") % 4).alias("v")), 64)


_KL = "case when i0 % 4 > 0 then (i0 % 4) * ln((i0 % 4) / (abs(v) + 0.1)) - (i0 % 4) + abs(v) + 0.1 else abs(v) + 0.1 end"
on("kl", "vec", lambda x: norm.KLDivergence(_data(x)).apply(x.map(lambda v: F.abs(v) + 0.1)), _V + f"select s::bigint as s, 0::bigint as i0, {t.rounded(f'sum({_KL})')} from vec group by s")
on("prox_kl", "vec", lambda x: norm.KLDivergence(_data(x)).prox(x, 0.3), _windowed("(v - 0.3 + sqrt((v - 0.3) * (v - 0.3) + 1.2 * (i0 % 4))) / 2", "0 z"))
on("fprox_l1", "vec", lambda x: norm.L1Norm(64).fenchel_prox(x, 2.0), _windowed("greatest(-1.0, least(1.0, v))", "0 z"))
# The same on one large item, by selection and partial sums.
_DRANK = "abs(v) u, row_number() over (order by abs(v) desc, i0) k, sum(abs(v)) over (order by abs(v) desc, i0 rows unbounded preceding) c"


def _selected(theta: str, e: str) -> str:
    found = f"(select *, (select {theta} from (select {_DRANK} from daily) where u > {theta} order by k desc limit 1) t from daily)"
    return t.with_("daily") + f"select i0::bigint as i0, {t.rounded(e)} from {found}"


on("prox_l1ball_large", "daily", lambda x: norm.L1Ball(2499, 1e5).prox(x, 1.0), _selected("((c - 100000) / k)", _SOFT))
on("prox_sql1_large", "daily", lambda x: norm.SquaredL1Norm(2499).prox(x, 0.001), _selected("(0.002 * c / (1 + 0.002 * k))", _SOFT))
on("prox_linf_large", "daily", lambda x: norm.LInfinityNorm(2499).prox(x, 2000.0), _selected("((c - 2000) / k)", f"v - {_SOFT}"))
on("prox_l2_large", "daily", lambda x: norm.L2Norm(2499).prox(x, 50.0), t.each("daily", "v * (1 - 50 / (select sqrt(sum(v * v)) from daily))"))
on("prox_l2ball_large", "daily", lambda x: norm.L2Ball(2499, 10.0).prox(x), t.each("daily", "v * 10 / (select sqrt(sum(v * v)) from daily)"))
on("fprox_l2", "vec", lambda x: norm.L2Norm(64).fenchel_prox(x, 2.0), _windowed("v / greatest(n, 1.0)", "sqrt(sum(v * v) over (partition by s)) n"))
on("fprox_sql2", "vec", lambda x: norm.SquaredL2Norm(64).fenchel_prox(x, 2.0), _windowed("v - 2 * (v / 2) / (1 + 2 * 0.5)", "0 z"))
_HUBER = "sum(case when abs(v) <= 0.1 then v * v / 0.2 else abs(v) - 0.05 end)"
_value("moreau_l1", lambda: norm.L1Norm(64).moreau_envelope(0.1), _HUBER)
on("moreau_l1_grad", "vec", lambda x: norm.L1Norm(64).moreau_envelope(0.1).grad(x), _windowed("greatest(-1.0, least(1.0, v / 0.1))", "0 z"))
on("grad_sql2", "vec", lambda x: norm.SquaredL2Norm(64).grad(x), t.each("vec", "2 * v"))
_SM1 = t.correlate("vec", t.outer(_SMOOTH))


def _quadratic() -> norm.QuadraticFunc:
    q = stencil.Stencil(64, [0.25, 0.5, 0.25], 1).asop(POS_DEF)
    return norm.QuadraticFunc(64, q, None, 1.5)


on("quadratic_apply", "vec", lambda x: _quadratic().apply(x), _V + f"select s::bigint as s, 0::bigint as i0, {t.rounded('sum(x.v * c.v) / 2 + 1.5')} from vec x join {_SM1} c using (s, i0) group by s")
on("quadratic_grad", "vec", lambda x: _quadratic().grad(x), t.filled("vec", _SM1))
on("rangeset", "vec", lambda x: norm.RangeSet(axes.BroadcastAxes((1,), (64,))).prox(x), _windowed("avg(v) over (partition by s)", "0 z"))

# -- algebra and blocks -------------------------------------------------------------------------------------------------
_ST = lambda: stencil.Stencil(64, [0.25, 0.5, 0.25], 1)
_FD1 = t.correlate("vec", t.outer(_FW))
on("add", "vec", lambda x: (_ST() + linop.Homothety(64, 2.0)).apply(x), t.filled("vec", _SM1, "coalesce(c.v, 0.0) + 2 * x.v"))
on("scale", "vec", lambda x: (-3 * _ST()).apply(x), t.filled("vec", _SM1, "-3 * coalesce(c.v, 0.0)"))
on("compose", "vec", lambda x: (maps.Abs(64) * _ST()).apply(x), t.filled("vec", _SM1, "abs(coalesce(c.v, 0.0))"))
on("chain_jacobian", "vec", lambda x: (maps.Sin(64) * linop.Homothety(64, 2.0)).jacobian(x).apply(x), t.each("vec", "2 * v * cos(2 * v)"))
on("chain_grad", "vec", lambda x: (norm.SquaredL2Norm(64) * linop.Homothety(64, 3.0)).grad(x), t.each("vec", "18 * v"))
on("argscale", "vec", lambda x: norm.L1Norm(64).argscale(2.0).prox(x, 0.3), _windowed(t.soft("2 * v", "1.2") + " / 2", "0 z"))
on("argscale_zero", "vec", lambda x: maps.Cos(64).argscale(0.0).apply(x), t.each("vec", "1.0"))
on("argshift_loss", "vec", lambda x: norm.SquaredL2Norm(64).argshift(_data(x).scale(-1)).apply(x), _V + f"select s::bigint as s, 0::bigint as i0, {t.rounded('sum((v - i0 % 4) * (v - i0 % 4))')} from vec group by s")
on("argshift_prox", "vec", lambda x: norm.L1Norm(64).argshift(0.5).prox(x, 0.3), _windowed(t.soft("(v + 0.5)", "0.3") + " - 0.5", "0 z"))
on("prox_plus_linear", "vec", lambda x: (norm.L1Norm(64) + linop.LinFunc(_data(x), shared=True)).prox(x, 0.3), _windowed(t.soft("(v - 0.3 * (i0 % 4))", "0.3"), "0 z"))
on("prox_unitary", "tile", lambda x: (norm.L1Norm((8, 8)) * axes.TransposeAxes((8, 8))).prox(x, 0.3), t.each("tile", t.soft("v", "0.3")))
on("stack", "vec", lambda x: blocks.stack([_ST(), stencil.Stencil(64, [-1.0, 1.0], 0)]).apply(x), t.stacked("vec", [_SM1, _FD1]), rename={"i0": "k0", "i1": "i0"})
on("stack_adj", "vec", lambda x: (lambda o: o.adjoint(o.apply(x)).dense())(blocks.stack([linop.Homothety(64, 2.0), linop.Homothety(64, 3.0)])), t.each("vec", "13 * v"))
on("block_diag", "heat", lambda x: blocks.block_diag([linop.Homothety(_S, 2.0), linop.Homothety(_S, 3.0)]).apply(_field(x)), _H + f"select k::bigint as i0, i0::bigint as i1, i1::bigint as i2, {t.rounded('v * case k when 0 then 2 else 6 end')} from heat cross join (select unnest([0, 1]) k)")
on("asop", "vec", lambda x: _ST().asop(POS_DEF).adjoint(x), t.filled("vec", _SM1))
on("short_hands", "tile", lambda x: linop.Identity((8, 8)).transpose().reshape((64,)).subsample(slice(0, 8)).apply(x), _TI + f"select s::bigint as s, i0::bigint as i0, {t.rounded('v')} from tile where i1 = 0")

# -- transforms ---------------------------------------------------------------------------------------------------------
_TW = "(select k, sum(v * {}(2 * pi() * ((k * i0) % 64) / 64)) v, s from vec cross join (select unnest(generate_series(0, 63)) k) group by s, k)"
_DFT = _V + "select s::bigint as s, k::bigint as i0, 0::bigint as i1, " + t.rounded("v") + " from " + _TW.format("cos") + " union all select s, k, 1, " + t.rounded("-v") + " from " + _TW.format("sin")


def _pairs(x: Grid) -> Grid:
    return Grid(x.df.withColumn(f"i{x.rank}", F.lit(0).cast("long")).select("s", *(f"i{k}" for k in range(x.rank + 1)), "v"), (*x.shape, 2))


on("dft_small", "vec", lambda x: fft.dft_by_join(x), _DFT)
on("fft", "vec", lambda x: fft.FFT((64,)).apply(_pairs(x)), _DFT)
on("fft_roundtrip", "tile", lambda x: (lambda f: f.pinv(f.apply(_pairs(x))))(fft.FFT((8, 8))), _TI + f"select s::bigint as s, i0::bigint as i0, i1::bigint as i1, c::bigint as i2, {t.rounded('case c when 0 then v else 0.0 end')} from tile cross join (select unnest([0, 1]) c)")
on("czt", "vec", lambda x: fft.CZT((64,), 0, 64, 1.0, complex(math.cos(2 * math.pi / 64), -math.sin(2 * math.pi / 64))).apply(_pairs(x)), _DFT)
# Values of up to 10^7 are rounded to cents, so that the order of a sum doesn't show.
_CENTS = lambda g: g.df.select(*(F.col(k) for k in g.keys[1:]), (F.round("v", 2) + F.lit(0.0)).alias("v"))
_PART = "select k::bigint as i0, {c}::bigint as i1, round({f}, 2) + 0.0 as v from (select k, sum(v * cos({a})) as re, -sum(v * sin({a})) as im from daily cross join (select unnest(generate_series(0, {m} - 1)) k) group by k)"
_WAVES = lambda m, a: t.with_("daily") + " union all ".join(_PART.format(c=c, f=f, a=a, m=m) for c, f in ((0, "re"), (1, "im")))
add("fft_long", lambda spark, d: _CENTS(fft.FFT((4096,)).apply(_pairs(Grid(signals.daily(spark, d).df, (4096,))))), _WAVES(4096, "2 * pi() * ((i0 * k) % 4096) / 4096"))
add("fft_uneven", lambda spark, d: _CENTS(fft.FFT((2503,)).apply(_pairs(Grid(signals.daily(spark, d).df, (2503,))))), _WAVES(2503, "2 * pi() * ((i0 * k) % 2503) / 2503"))
# 200 points between the periods of 40 and 20 days.
add("czt_zoom", lambda spark, d: _CENTS(fft.CZT((2499,), 0, 200, complex(math.cos(math.pi / 20), math.sin(math.pi / 20)), complex(math.cos(math.pi / 4000), -math.sin(math.pi / 4000))).apply(_pairs(signals.daily(spark, d)))), _WAVES(200, "i0 * (pi() / 20 + k * pi() / 4000)"))
_WIDE = {k: 1 / (1 + abs(k)) + (0.25 if k > 0 else 0.0) for k in range(-150, 151)}
on("fft_correlate_long", "daily", lambda x: fft.FFTCorrelate(2499, [_WIDE[k] for k in range(-150, 151)], 150, "reflect").apply(x), t.filled("daily", t.correlate("daily", t.outer(_WIDE), "reflect")))
on("fft_convolve_long", "daily", lambda x: fft.FFTConvolve(2499, [_WIDE[k] for k in range(-150, 151)], 150).apply(x), t.filled("daily", t.correlate("daily", t.outer({-k: w for k, w in _WIDE.items()}))))
on("complex_views", "vec", lambda x: view_as_real(view_as_complex(_pairs(x)), (64,)), _V + f"select s::bigint as s, i0::bigint as i0, c::bigint as i1, {t.rounded('case c when 0 then v else 0.0 end')} from vec cross join (select unnest([0, 1]) c)")
add("as_real_op", lambda spark, d: as_real_matrix(signals.mat(spark, d)[0].select("row", "col", F.col("w").alias("re"), (F.col("row") + F.col("col")).cast("double").alias("im"))).select("row", "col", "w"), t.with_("mat") + "select (2 * r + i)::bigint as row, (2 * c + j)::bigint as col, (case when i = j then w when i = 0 then -(r + c) else r + c end)::double as w from mat cross join (select unnest([0, 0, 1, 1]) i, unnest([0, 1, 0, 1]) j)")

# -- solvers ------------------------------------------------------------------------------------------------------------
_LAM = 0.2


def _fit(x: Grid) -> Op:
    """|x - y|^2 / 2, y an item of data for each item."""
    f = norm.SquaredL2Norm(64)

    def minus(a: Grid) -> Grid:
        return a.plus(x, 1, -1)

    return from_source(DIFF_FUNC | {*norm.PROX_FUNC}, 64, 1, embed={"diff_lipschitz": 1.0}, apply=lambda a: f.apply(minus(a)).scale(0.5), grad=minus, prox=lambda a, tau: a.plus(x, 1 / (1 + tau), tau / (1 + tau)))


def _zero(x: Grid) -> Grid:
    return linop.Null(64, 64).apply(x)


_L1 = lambda: norm.L1Norm(64) * _LAM
_CLAMP = f"greatest(-{_LAM}, least({_LAM}, {{}}))"


def _cv(k: int, tau: float, sigma: float, f: bool, g: str) -> list[dict[str, str]]:
    down = f"x - {tau} * ({'x - y' if f else '0.0'}) - {tau} * z"
    return [{"xn": g.format(down)}, {"z": _CLAMP.format(f"(z + {sigma} * (2 * xn - x))")}, {"x": "xn"}]


on("pgd_lasso", "vec", lambda x: gradient.PGD(_fit(x), _L1()).fit(x0=_zero(x), tau=0.5, max_iter=3, d=2).solution(), t.recursion("vec", {"x": "0.0", "p": "0.0", "a": "0.0"}, 1, [s for k in range(3) for s in ({"w": f"x + {k / (k + 1 + 2)} * (x - p)"}, {"p": "x", "x": t.soft("(w - 0.5 * (w - y))", "0.1")})], "x"))
on("adam", "vec", lambda x: gradient.Adam(_fit(x)).fit(x0=_zero(x), a=0.1, max_iter=3).solution(), t.recursion("vec", {"x": "0.0", "m": "0.0", "w": "0.0"}, 1, [s for k in (1, 2, 3) for s in ({"m": "0.9 * m + 0.1 * (x - y)", "w": "greatest(0.999 * w + 0.001 * (x - y) * (x - y), 1e-6)"}, {"x": f"x - 0.1 * (m / {1 - 0.9**k}) / sqrt(w / {1 - 0.999**k})"})], "x"))
on("adam_amsgrad", "vec", lambda x: gradient.Adam(_fit(x)).fit(x0=_zero(x), a=0.1, variant="amsgrad", max_iter=2).solution(), t.recursion("vec", {"x": "0.0", "m": "0.0", "w": "0.0", "h": "0.0"}, 2, [{"m": "0.9 * m + 0.1 * (x - y)", "w": "greatest(0.999 * w + 0.001 * (x - y) * (x - y), 1e-6)"}, {"h": "greatest(h, w)"}, {"x": "x - 0.1 * m / sqrt(h)"}], "x"))
on("nlcg", "vec", lambda x: cg.NLCG(_fit(x)).fit(x0=_zero(x), a0=1.0, max_iter=1).solution(), t.each("vec", "v"))
on("condat_vu", "vec", lambda x: splitting.CondatVu(_fit(x), h=_L1(), K=linop.Identity(64)).fit(x0=_zero(x), tau=0.6, sigma=0.8, max_iter=3).solution(), t.recursion("vec", {"x": "0.0", "z": "0.0"}, 3, _cv(3, 0.6, 0.8, True, "{}"), "x"))
on("condat_vu_positive", "vec", lambda x: splitting.CondatVu(_fit(x), norm.PositiveOrthant(64), _L1()).fit(x0=_zero(x), tau=0.6, sigma=0.8, max_iter=2).solution(), t.recursion("vec", {"x": "0.0", "z": "0.0"}, 2, _cv(2, 0.6, 0.8, True, "greatest({}, 0.0)"), "x"))
on("cp", "vec", lambda x: splitting.ChambollePock(_fit(x), _L1()).fit(x0=_zero(x), tau=0.6, sigma=0.8, max_iter=3).solution(), t.recursion("vec", {"x": "0.0", "z": "0.0"}, 3, _cv(3, 0.6, 0.8, False, "(({}) + 0.6 * y) / 1.6"), "x"))
on("dr", "vec", lambda x: splitting.DouglasRachford(_fit(x), _L1()).fit(x0=_zero(x), max_iter=3).solution(), t.recursion("vec", {"x": "0.0", "z": "0.0"}, 3, _cv(3, 1.0, 1.0, False, "(({}) + y) / 2"), "x"))
on("fb", "vec", lambda x: splitting.ForwardBackward(_fit(x), _L1()).fit(x0=_zero(x), tau=0.5, sigma=1.0, max_iter=3).solution(), t.recursion("vec", {"x": "0.0"}, 3, [{"x": t.soft("(x - 0.5 * (x - y))", "0.1")}], "x"))
on("pp", "vec", lambda x: splitting.ProximalPoint(_fit(x)).fit(x0=_zero(x), tau=0.5, sigma=1.0, max_iter=3).solution(), t.recursion("vec", {"x": "0.0"}, 3, [{"x": "(x + 0.5 * y) / 1.5"}], "x"))


def _pd3o(tau: float, sigma: float, g: str) -> list[dict[str, str]]:
    return [{"x": g.format("u")}, {"dn": f"x - {tau} * (x - y)"}, {"z": _CLAMP.format(f"(z + {sigma} * (x + dn - u - {tau} * z))") if False else _CLAMP.format(f"(z + {sigma} * (x + dn - u + -{tau} * z))")}, {"u": f"dn - {tau} * z"}]


on("pd3o", "vec", lambda x: splitting.PD3O(_fit(x), norm.PositiveOrthant(64), _L1(), linop.Identity(64)).fit(x0=_zero(x), tau=0.6, sigma=0.8, max_iter=3).solution(), t.recursion("vec", {"x": "0.0", "z": "0.0", "u": "0.0"}, 3, _pd3o(0.6, 0.8, "greatest({}, 0.0)"), "x"))
on("lv", "vec", lambda x: splitting.LorisVerhoeven(_fit(x), _L1()).fit(x0=_zero(x), tau=0.6, sigma=0.8, max_iter=3).solution(), t.recursion("vec", {"x": "0.0", "z": "0.0", "u": "0.0"}, 3, _pd3o(0.6, 0.8, "{}"), "x"))
on("dy", "vec", lambda x: splitting.DavisYin(_fit(x), norm.PositiveOrthant(64), _L1()).fit(x0=_zero(x), max_iter=3).solution(), t.recursion("vec", {"x": "0.0", "z": "0.0", "u": "0.0"}, 3, _pd3o(1.0, 0.99, "greatest({}, 0.0)"), "x"))
on("admm", "vec", lambda x: splitting.ADMM(_fit(x), _L1()).fit(x0=_zero(x), max_iter=3).solution(), t.recursion("vec", {"x": "0.0", "z": "0.0", "u": "0.0"}, 3, [{"x": "(z - u + y) / 2"}, {"w": "x + u"}, {"z": t.soft("w", str(_LAM))}, {"u": "w - z"}], "x"))


def _blur() -> Op:
    return stencil.Stencil(64, [0.25, 0.5, 0.25], 1).asop(POS_DEF)


on("cg_1step", "vec", lambda x: cg.CG(_blur()).fit(b=x, max_iter=1).solution(), _V + f"select x.s::bigint as s, x.i0::bigint as i0, {t.rounded('x.v * a.a')} from vec x join (select s, sum(x.v * x.v) / sum(x.v * c.v) a from vec x join {_SM1} c using (s, i0) group by s) a using (s)")
on("cg", "vec", lambda x: cg.CG(_blur() + linop.Homothety(64, 0.5)).fit(b=x, stop=AbsError(1e-3, "residual") | MaxIter(6)).solution())
on("pinv_broadcast", "daily", lambda x: axes.BroadcastAxes((1,), (2499,)).pinv(x, damp=1.0), t.with_("daily") + f"select 0::bigint as i0, {t.rounded('sum(v) / 2500')} from daily")
add("pinv", lambda spark, d: out((lambda a: a.pinv(grid(spark.range(a.codim[0]).select(F.col("id").alias("i0"), (F.col("id") % 5).alias("v")), a.codim), damp=100.0))(_matrix(spark, d))))
on("dagger", "daily", lambda x: (lambda o: o.dagger(1.0).apply(o.apply(x)).dense())(select.SubSample(2499, slice(0, None, 2))), t.each("daily", "case when i0 % 2 = 0 then v / 2 else 0.0 end"))
add("linesearch", lambda spark, d: (lambda x: linalg.backtracking_linesearch(norm.SquaredL2Norm(64), x, x.scale(-2.0), a0=2.0))(signals.vec(spark, d)), "select vec_id::bigint as s, 0.5::double as a from embeddings")
add("solver_history", lambda spark, d: gradient.PGD(_fit(signals.vec(spark, d)), _L1()).fit(x0=_zero(signals.vec(spark, d)), tau=1.0, acceleration=False, stop=RelError(1e-9, "x") | MaxIter(4)).stats(spark)[0].select("iteration"), "select unnest([0, 1, 2])::bigint as iteration")

# -- samplers, statistics, streams, interop -----------------------------------------------------------------------------
on("ula", "vec", lambda x: next(ULA(_fit(x), 0.1).samples(x, seed=3)))
on("myula", "vec", lambda x: next(MYULA(_fit(x), _L1()).samples(x, seed=3)))


def _stat(stat: Callable[[], moments.Stat]) -> Query:
    return lambda spark, d: stat().of(signals.vec(spark, d)).select("i0", (F.round("v", 6) + F.lit(0.0)).alias("v"))


_MOM = "(select *, avg(v) over (partition by i0) m from vec)"
for _n, _q, _e in (("mean", lambda: moments.Moment(1), "avg(v)"), ("moment3", lambda: moments.Moment(3), "avg(v * v * v)"), ("var", moments.Variance, "var_pop(v)"), ("std", moments.Std, "stddev_pop(v)"), ("skew", moments.Skewness, "avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5)"), ("kurt", moments.Kurtosis, "avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2)"), ("ratio", lambda: moments.Moment(1) / moments.Std() + 1, "avg(v) / stddev_pop(v) + 1")):
    add(f"online_{_n}", _stat(_q), _V + f"select i0::bigint as i0, {t.rounded(_e)} from {_MOM} group by i0")
add("online_centered4", lambda spark, d: moments.centered_moment(signals.vec(spark, d), 4).select("i0", (F.round("v", 6) + F.lit(0.0)).alias("v")), _V + f"select i0::bigint as i0, {t.rounded('avg(pow(v - m, 4))')} from {_MOM} group by i0")
add("windowed_moments", lambda spark, d: windowed_moments(signals.read(spark, d, "events"), window="1 day").select(F.datediff(F.col("start").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("day"), "n", F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var")), "select date_diff('day', date '2024-01-01', cast(ts as date))::bigint as day, count(value) as n, round(avg(value), 6) as mean, round(var_pop(value), 4) as var from events group by 1")
on("vectorize", "vec", lambda x: vectorize(lambda a: a[::-1].cumsum(), (64,))(x), _V + f"select s::bigint as s, (63 - i0)::bigint as i0, {t.rounded('sum(v) over (partition by s order by i0 desc rows unbounded preceding)')} from vec")
on("from_matvec", "vec", lambda x: from_matvec(LINEAR, 64, 64, lambda a: 2 * a, lambda a: 2 * a).apply(x), t.each("vec", "2 * v"))
on("from_source", "vec", lambda x: from_source(LINEAR, 64, 64, apply=lambda a: a.scale(4.0), adjoint=lambda a: a.scale(4.0)).adjoint(x), t.each("vec", "4 * v"))
add("peaks", lambda spark, d: out(signals.plane(spark, 7, 7, signals.peaks)), "select i0::bigint as i0, i1::bigint as i1, round(3 * (1 - x) * (1 - x) * exp(-x * x - (y + 1) * (y + 1)) - 10 * (x / 5 - x * x * x - pow(y, 5)) * exp(-x * x - y * y) - exp(-(x + 1) * (x + 1) - y * y) / 3, 6) + 0.0 as v from (select i0, i1, (i0 - 3)::double x, (i1 - 3)::double y from (select unnest(generate_series(0, 6)) i0) cross join (select unnest(generate_series(0, 6)) i1))")
add("star_sample", lambda spark, d: out(signals.star(spark, 16, 2)), "select i0::bigint as i0, i1::bigint as i1, round(v / max(v) over (), 6) + 0.0 as v from (select i0, i1, pow(greatest((1 + cos(8 * atan2(y, x))) / (1 + exp(20 * (sqrt(x * x + y * y) - 0.7))), 0.0) / 2, 3) v from (select i0, i1, -1 + 2.0::double * i0 / 15 y, -1 + 2.0::double * i1 / 15 x from (select unnest(generate_series(0, 15)) i0) cross join (select unnest(generate_series(0, 15)) i1)))")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total-variation-like smoothing of the daily signal: Gaussian filter, gradient, soft threshold."""
    x = signals.daily(spark, sf_dir)
    smooth = filters.GaussianFilter(2499, 2.0, mode="edge").apply(x)
    return out(norm.L1Norm((1, 2499)).prox(diff.Gradient(2499).apply(smooth), 0.5))


add("flagship", flagship, t.with_("daily", f"sm as (select i0, v from {t.correlate('daily', t.outer(t.bell(2.0)), 'edge')})") + f"select 0::bigint as i0, x.i0::bigint as i1, {t.rounded(t.soft('coalesce(c.v, 0.0)', '0.5'))} from daily x left join {t.correlate('daily', t.outer(_FW), of='sm')} c using (i0)")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
