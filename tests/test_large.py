"""What large cores take: Lanczos, split transforms, tiles, selection, lazy products and block algebra, on small cores."""

import numpy as np
import pytest
from numeric import correlate, get, put, rng

from fluxgrid.functions.spectrum import largest
from fluxgrid.operators import fft, norm, tiles
from fluxgrid.operators.blocks import block_diag
from fluxgrid.operators.linop import Diagonal, Explicit, khatri_rao, kron
from fluxgrid.operators.stencil import Stencil
from fluxgrid.plans import op as ops


def explicit(spark, m):
    return Explicit(spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "row long, col long, w double"), m.shape[1], m.shape[0])


def matrix(op, spark):
    m = np.zeros((op.codim_size, op.dim_size))
    for r in op.asarray(spark).collect():
        m[r["row"], r["col"]] += r["w"]
    return m


def circulant(kernel, n):
    return np.sort(np.abs(np.fft.fft(np.r_[kernel, np.zeros(n - len(kernel))])))


def test_lanczos_with_restarts(spark):
    kernel = np.array([3.0, -1.0, 0.5, 2.0, -2.5, 0.25])
    found = largest(Stencil(60, kernel, 0, "wrap"), spark, 3, panel=10, widest=30, settled=1e-4)
    want = circulant(kernel, 60)
    assert found.settled and found.applications < 100 and len(found.residuals) == 3
    assert np.allclose(found.values, want[-3:], rtol=1e-6) and found.upper >= want[-1] * (1 - 1e-12)


def test_lanczos_without_a_gap(spark):
    """A low-pass filter: the largest values differ by 1e-4; the basis grows to the whole space."""
    found = largest(Stencil(40, [0.25, 0.5, 0.25], 1, "wrap"), spark, 1, panel=12, widest=80)
    assert found.settled and np.allclose(found.values, [1.0], rtol=1e-6)
    with pytest.warns(UserWarning):
        short = largest(Stencil(60, [0.25, 0.5, 0.25], 1, "wrap"), spark, 1, most=2, panel=2, settled=1e-12)
    assert not short.settled and short.values[0] <= 1 + 1e-9 <= short.upper + 1e-6


def test_lanczos_of_rank_one(spark):
    found = largest(explicit(spark, np.outer(np.arange(1.0, 8), np.ones(9))), spark, 2, panel=3)
    assert found.settled and np.allclose(found.values, [0.0, np.sqrt(9 * 140)], atol=1e-4)


@pytest.mark.parametrize("shape", [(12,), (7, 6)])
def test_split_transforms(spark, monkeypatch, shape):
    monkeypatch.setattr(fft, "LINE", 4)
    op = fft.FFT(shape)
    x, y = rng.standard_normal((2, *op.dim)), rng.standard_normal((2, *op.dim))
    ax, aty = get(op.apply(put(spark, x))), get(op.adjoint(put(spark, y)))
    z = np.fft.fftn(x[..., 0] + 1j * x[..., 1], axes=range(1, 1 + len(shape)))
    assert np.allclose(ax[..., 0] + 1j * ax[..., 1], z) and np.isclose((ax * y).sum(), (x * aty).sum())


def test_long_chirp_transforms(spark, monkeypatch):
    monkeypatch.setattr(fft, "LINE", 4)
    op = fft.CZT((9,), 0, 6, np.exp(0.3j), np.exp(-0.7j))
    x, y = rng.standard_normal((2, *op.dim)), rng.standard_normal((2, *op.codim))
    ax, aty = get(op.apply(put(spark, x))), get(op.adjoint(put(spark, y)))
    n, k = np.arange(9)[:, None], np.arange(6)[None]
    assert np.allclose(ax[..., 0] + 1j * ax[..., 1], (x[..., 0] + 1j * x[..., 1]) @ (np.exp(0.3j) ** -n * np.exp(-0.7j) ** (n * k)))
    assert np.isclose((ax * y).sum(), (x * aty).sum())


@pytest.mark.parametrize("mode", ["constant", "reflect"])
@pytest.mark.parametrize("kind", [Stencil, fft.FFTCorrelate])
def test_tiles(spark, monkeypatch, kind, mode):
    monkeypatch.setattr(tiles, "PLACES", 9)
    monkeypatch.setattr(tiles, "REACHES", 1)
    k = np.arange(1.0, 9).reshape(2, 4)
    op = kind((11, 13), k, (1, 2), mode)
    x, y = rng.standard_normal((2, *op.dim)), rng.standard_normal((2, *op.codim))
    ax, aty = get(op.apply(put(spark, x))), get(op.adjoint(put(spark, y)))
    assert np.allclose(ax, [correlate(v, k, (1, 2), mode) for v in x]) and np.isclose((ax * y).sum(), (x * aty).sum())
    plan = op.apply(put(spark, x)).df._jdf.queryExecution().optimizedPlan().toString()
    assert "__tap" not in plan


def sorted_threshold(v, rule):
    u = np.sort(np.abs(v))[::-1]
    theta = rule(np.arange(1, len(u) + 1), np.cumsum(u))
    return theta[np.flatnonzero(u > theta)[-1]] if (u > theta).any() else 0.0


def test_selection(spark, monkeypatch):
    for module in (ops, norm):
        monkeypatch.setattr(module, "SMALL", 2)
    r = np.random.default_rng(1)
    x = np.stack([r.standard_normal(50), np.round(r.standard_normal(50), 1), np.full(50, 0.75), r.lognormal(0, 6, 50), np.r_[np.zeros(49), -3.0], np.r_[np.ones(25), -np.ones(25) * (1 + 1e-13)]])
    g = put(spark, x)
    soft = lambda v, t: np.sign(v) * np.maximum(np.abs(v) - t, 0)
    for radius in (0.5, 20.0):
        ball = [v if np.abs(v).sum() <= radius else soft(v, sorted_threshold(v, lambda k, c: (c - radius) / k)) for v in x]
        assert np.allclose(get(norm.L1Ball(50, radius).prox(g), len(x)), ball, rtol=1e-9, atol=1e-9)
    squared = [soft(v, sorted_threshold(v, lambda k, c: 0.6 * c / (1 + 0.6 * k))) for v in x]
    assert np.allclose(get(norm.SquaredL1Norm(50).prox(g, 0.3), len(x)), squared, rtol=1e-9, atol=1e-9)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(get(norm.L2Norm(50).prox(g, 2.0), len(x)), x * (1 - 2 / np.maximum(n, 2)))
    assert np.allclose(get(norm.L2Ball(50, 2.0).prox(g), len(x)), x * 2 / np.maximum(n, 2))
    plan = norm.L2Ball(50, 2.0).prox(g).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_products_without_forming_them(spark):
    a, b, c = rng.standard_normal((3, 2)), rng.standard_normal((4, 5)), rng.standard_normal((4, 2))
    for op, want in ((kron(explicit(spark, a), explicit(spark, b)), np.kron(a, b)), (khatri_rao(explicit(spark, a), explicit(spark, c)), np.einsum("ik,jk->ijk", a, c).reshape(12, 2))):
        x, y = rng.standard_normal((2, want.shape[1])), rng.standard_normal((2, want.shape[0]))
        assert np.allclose(get(op.apply(put(spark, x))), x @ want.T) and np.allclose(get(op.adjoint(put(spark, y))), y @ want)
        assert np.allclose(op.svdvals(spark, 2), np.sort(np.linalg.svd(want, compute_uv=False))[-2:])
        assert np.allclose(matrix(op.gram(), spark), want.T @ want)
    square = kron(explicit(spark, a.T @ a), explicit(spark, b @ b.T))
    assert np.isclose(square.trace(spark), np.trace(np.kron(a.T @ a, b @ b.T)))


def test_block_algebra(spark):
    a, b = rng.standard_normal((3, 3)), rng.standard_normal((3, 3))
    op = block_diag([explicit(spark, a), explicit(spark, b) * 2.0])
    want = np.block([[a, np.zeros((3, 3))], [np.zeros((3, 3)), 2 * b]])
    assert np.allclose(matrix(op, spark), want) and np.allclose(matrix(op.gram(), spark), want.T @ want) and np.allclose(matrix(op.cogram(), spark), want @ want.T)
    assert np.isclose(op.trace(spark), np.trace(want)) and np.allclose(op.svdvals(spark, 4), np.sort(np.linalg.svd(want, compute_uv=False))[-4:])
    d = Diagonal(put(spark, np.array([[1.0, -5.0, 2.0]])))
    assert np.isclose(d.trace(spark), -2.0) and np.allclose((d * -2.0).svdvals(spark, 2), [4.0, 10.0])


def test_kronecker_products_are_not_shuffled(spark):
    a, b = rng.standard_normal((40, 3)), rng.standard_normal((50, 3))
    a[::4, 1], b[7] = 0.0, 0.0
    sparse = [Explicit(explicit(spark, m).table.where("w <> 0"), 3, len(m)) for m in (a, b)]
    for op, want in ((kron(*sparse), np.kron(a, b)), (khatri_rao(*sparse), np.einsum("ik,jk->ijk", a, b).reshape(2000, 3))):
        x, y = rng.standard_normal((2, want.shape[1])), rng.standard_normal((2, 2000))
        assert np.allclose(get(op.apply(put(spark, x))), x @ want.T) and np.allclose(get(op.adjoint(put(spark, y))), y @ want)
        plan = op.apply(put(spark, x)).df._jdf.queryExecution().executedPlan().toString()
        product = plan[: plan.index("BroadcastNestedLoopJoin")]
        assert "Exchange" not in product and "HashAggregate" not in product
        plan = op.adjoint(put(spark, y)).df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan[plan.index("BroadcastHashJoin") :]
