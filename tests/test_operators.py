"""Operators against NumPy: values, <A x, y> = <x, A* y>, and |A x| <= L |x|."""

import math

import numpy as np
import pytest
from conftest import SF
from numeric import correlate, get, put, rng

from fluxgrid import queries
from fluxgrid.functions import linalg
from fluxgrid.operators.axes import BroadcastAxes, ReshapeAxes, SqueezeAxes, Sum, TransposeAxes
from fluxgrid.operators.blocks import block_diag, stack
from fluxgrid.operators.diff import DirectionalDerivative, DirectionalHessian, Divergence, Gradient, Hessian, Jacobian, Laplacian
from fluxgrid.operators.fft import CZT, FFT, FFTCorrelate
from fluxgrid.operators.filters import DoG, GaussianFilter, MovingAverage
from fluxgrid.operators.linop import Explicit, Homothety, Identity, kron
from fluxgrid.operators.maps import UFUNCS
from fluxgrid.operators.select import MODES, Pad, SubSample, Trim
from fluxgrid.operators.stencil import Convolve, Stencil
from fluxgrid.plans.op import KINDS, Property
from fluxgrid.sources import signals

D = (5, 6)
K = np.arange(1.0, 9).reshape(2, 4)


def _complex(f):
    def run(v):
        z = f(v[..., 0] + 1j * v[..., 1])
        return np.stack([z.real, z.imag], -1)

    return run


def _czt(z):
    n, k = np.arange(5)[:, None], np.arange(6)[None]
    return z @ (np.exp(0.3j) ** -n * np.exp(-0.7j) ** (n * k))


CASES = {
    "transpose": (lambda: TransposeAxes((2, 3, 4)), lambda v: v.T), "squeeze": (lambda: SqueezeAxes((2, 1, 4)), lambda v: v.squeeze()), "reshape": (lambda: ReshapeAxes(D, (2, -1)), lambda v: v.reshape(2, 15)),
    "broadcast": (lambda: BroadcastAxes((1, 3), (2, 4, 3)), lambda v: np.broadcast_to(v, (2, 4, 3))), "sum": (lambda: Sum((3, 4), 1), lambda v: v.sum(1, keepdims=True)),
    "slice": (lambda: SubSample((10,), slice(9, 2, -2)), lambda v: v[9:2:-2]), "recurring": (lambda: SubSample((10,), [1, 1, 4]), lambda v: v[[1, 1, 4]]), "bools": (lambda: SubSample((10,), [True, False] * 5), lambda v: v[::2]),
    "trim": (lambda: Trim((10, 6), ((2, 3), (1, 2))), lambda v: v[2:7, 1:4]), "separable": (lambda: Stencil((7, 8), [[1.0, 2, 3], [1.0, -1]], (1, 1), "reflect"), lambda v: correlate(v, np.outer([1, 2, 3], [1, -1]), (1, 1), "reflect")),
    "convolve": (lambda: Convolve((7, 8), K, (1, 0)), lambda v: correlate(v, K[::-1, ::-1], (0, 3), "constant")), "average": (lambda: MovingAverage(D, 3), lambda v: correlate(v, np.ones((3, 3)) / 9, (1, 1), "constant")),
    "gradient": (lambda: Gradient(D), None), "hessian": (lambda: Hessian(D), None), "jacobian": (lambda: Jacobian((2, *D)), None), "divergence": (lambda: Divergence((2, *D)), None), "laplacian": (lambda: Laplacian(D), None),
    "directional": (lambda: DirectionalDerivative(D, 2, [1.0, 2.0]), None), "directional hessian": (lambda: DirectionalHessian(D, [[1.0, 0.0], [1.0, 1.0]]), None), "gaussian": (lambda: GaussianFilter(D, 1.0), None), "dog": (lambda: DoG(D), None),
    "fft": (lambda: FFT((7, 4)), _complex(np.fft.fftn)), "czt": (lambda: CZT((5,), 0, 6, np.exp(0.3j), np.exp(-0.7j)), _complex(_czt)), "stack": (lambda: stack([Laplacian(D), Laplacian(D) * 2.0]), None), "block": (lambda: block_diag([Laplacian(D), Laplacian(D) * 2.0]), None),
    "sum of operators": (lambda: Laplacian(D) + Homothety(D, 3.0), None), "chain": (lambda: Laplacian(D) * Laplacian(D).T, None),
}
for _m in MODES:
    CASES[f"pad {_m}"] = (lambda m=_m: Pad((5, 3), ((2, 3), (1, 2)), m), lambda v, m=_m: np.pad(v, ((2, 3), (1, 2)), mode=m))
    CASES[f"stencil {_m}"] = (lambda m=_m: Stencil((7, 8), K, (1, 0), m), lambda v, m=_m: correlate(v, K, (1, 0), m))
    CASES[f"fft correlate {_m}"] = (lambda m=_m: FFTCorrelate((7, 8), K, (1, 0), m), lambda v, m=_m: correlate(v, K, (1, 0), m))


@pytest.mark.parametrize("name", CASES)
def test_linear(spark, name):
    make, want = CASES[name]
    op = make()
    x, y = rng.standard_normal((2, *op.dim)), rng.standard_normal((2, *op.codim))
    ax, aty = get(op.apply(put(spark, x))), get(op.adjoint(put(spark, y)))
    if want:
        assert np.allclose(ax, [want(v) for v in x], atol=1e-9)
    assert math.isclose((ax * y).sum(), (x * aty).sum(), abs_tol=1e-8)
    if math.isfinite(op.lipschitz):
        assert np.linalg.norm(ax[0]) <= op.lipschitz * np.linalg.norm(x[0]) * (1 + 1e-9)


@pytest.mark.parametrize("name", [n for n, c in UFUNCS.items() if math.isfinite(c.lipschitz)])
def test_lipschitz_of_maps(spark, name):
    op = UFUNCS[name]((6,))
    x = rng.uniform(-0.9, 0.9, (2, 6))
    fx = get(op.apply(put(spark, x)))
    assert np.linalg.norm(fx[0] - fx[1]) <= op.lipschitz * np.linalg.norm(x[0] - x[1]) + 1e-9


def test_kinds():
    assert Gradient(D).kind == "LinOp"
    assert Homothety(3, 2.0).kind == "PosDefOp" and (Homothety(3, 2.0) * -1.0).kind == "SelfAdjointOp"
    assert Identity(3).kind in KINDS.values()
    assert TransposeAxes(D).gram().has(Property.LINEAR_IDEMPOTENT)
    assert "Chain" in (Laplacian(D) * Laplacian(D)).expr()
    with pytest.raises(NotImplementedError):
        Identity(3) ** 2
    with pytest.raises(ValueError):
        Identity(3) + Identity(4)


def test_empty_and_missing_rows(spark):
    empty = put(spark, np.zeros((1, 5)))
    empty = type(empty)(empty.df.where("false"), empty.shape)
    assert Stencil(5, [1.0, 2.0], 0).apply(empty).df.count() == 0
    sparse = type(empty)(put(spark, np.ones((1, 5))).df.where("i0 = 2"), (5,))
    assert get(UFUNCS["cos"]((5,)).apply(sparse), 1)[0].tolist() == [1, 1, math.cos(1), 1, 1]


def test_singular_values_of_large_matrices(spark, monkeypatch):
    # Close values, as those of the quantities by supplier are: eight rounds are not enough.
    q = np.linalg.qr(rng.standard_normal((30, 7)))[0]
    m = q @ np.diag([100.0, 9.0, 8.7, 8.5, 8.3, 8.1, 8.0]) @ np.linalg.qr(rng.standard_normal((7, 7)))[0]
    op = Explicit(spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "row long, col long, w double"), 7, 30)
    monkeypatch.setattr(linalg, "DENSE", 10)
    assert np.allclose(op.svdvals(spark, 3), [8.7, 9.0, 100.0])
    assert np.allclose(op.T.svdvals(spark, 3), [8.7, 9.0, 100.0])
    d = np.r_[10.0, 9.0, np.linspace(5, 1, 10)]
    both = Explicit(spark.createDataFrame([(i, i, float(v)) for i, v in enumerate(d)], "row long, col long, w double"), 12, 12)
    assert np.allclose(both.svdvals(spark, 2), [9.0, 10.0], rtol=1e-4)


def test_products_of_whole_tables(spark):
    rows, n = signals.mat(spark, SF)
    m = np.zeros((n, 7))
    for r in rows.collect():
        m[r["row"], r["col"]] = r["w"]
    assert n > 3
    want = {"kron": np.kron(m, m) @ (np.arange(49) % 4), "khatri_rao": (m[:, None, :] * m[None, :, :]).reshape(n * n, 7) @ np.arange(1, 8)}
    for name, values in want.items():
        got = queries.queries()[name](spark, SF).toPandas().set_index("i0")["v"].reindex(range(n * n), fill_value=0.0)
        assert np.allclose(got, values)


def test_kron_matrix(spark):
    a, b = rng.standard_normal((3, 2)), rng.standard_normal((2, 4))
    tables = [spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "row long, col long, w double") for m in (a, b)]
    x = rng.standard_normal((2, 8))
    assert np.allclose(get(kron(*tables, a.shape, b.shape).apply(put(spark, x))), x @ np.kron(a, b).T)


def test_hutchpp_estimates(spark):
    # A full rank of 200 against sketches of 20: the trace is 200 (0.25^2 + 0.5^2 + 0.25^2).
    op = Stencil(200, [0.25, 0.5, 0.25], 1, "wrap").gram()
    assert math.isclose(op.trace(spark, method="hutchpp", m=60), 75, rel_tol=0.05)


def test_pinv_query_converges(spark):
    rows, n = signals.mat(spark, SF)
    m = np.zeros((n, 7))
    for r in rows.collect():
        m[r["row"], r["col"]] = r["w"]
    got = queries.queries()["pinv"](spark, SF).toPandas().set_index("i0")["v"].reindex(range(7))
    assert np.allclose(got, np.linalg.solve(m.T @ m + 100 * np.eye(7), m.T @ (np.arange(n) % 5)), rtol=0, atol=6e-7)


def test_matrix(spark):
    m = rng.standard_normal((3, 4))
    table = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "row long, col long, w double")
    op = Explicit(table, 4, 3)
    x = rng.standard_normal((2, 4))
    assert np.allclose(get(op.apply(put(spark, x))), x @ m.T)
    assert np.allclose(op.svdvals(spark, 2), np.sort(np.linalg.svd(m)[1])[-2:])
    assert math.isclose(op.gram().trace(spark), (m * m).sum(), rel_tol=1e-9)
