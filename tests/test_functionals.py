"""Values, and that a proximal point minimises 2 tau f(z) + |z - x|^2 among many points around it."""

import numpy as np
import pytest
from numeric import get, put, rng

from fluxgrid.operators.norm import HyperSlab, KLDivergence, L1Ball, L1Norm, L2Ball, L2Norm, LInfinityBall, LInfinityNorm, PositiveL1Norm, PositiveOrthant, SquaredL1Norm, SquaredL2Norm

INF = np.inf
X = rng.standard_normal((2, 6)) * 2
A = rng.standard_normal((1, 6))
Y = np.abs(rng.standard_normal((1, 6)))
CASES = {
    "l1": (lambda s: L1Norm(6), lambda z: np.abs(z).sum()), "l2": (lambda s: L2Norm(6), np.linalg.norm), "sql2": (lambda s: SquaredL2Norm(6), lambda z: (z * z).sum()), "sql1": (lambda s: SquaredL1Norm(6), lambda z: np.abs(z).sum() ** 2),
    "linf": (lambda s: LInfinityNorm(6), lambda z: np.abs(z).max()), "pos": (lambda s: PositiveL1Norm(6), lambda z: z.sum() if (z >= 0).all() else INF), "l1 ball": (lambda s: L1Ball(6, 1.5), lambda z: 0.0 if np.abs(z).sum() <= 1.5 + 1e-9 else INF),
    "l2 ball": (lambda s: L2Ball(6, 1.5), lambda z: 0.0 if np.linalg.norm(z) <= 1.5 + 1e-9 else INF), "linf ball": (lambda s: LInfinityBall(6, 0.5), lambda z: 0.0 if np.abs(z).max() <= 0.5 else INF), "orthant": (lambda s: PositiveOrthant(6), lambda z: 0.0 if (z >= 0).all() else INF),
    "slab": (lambda s: HyperSlab(put(s, A), -0.1, 0.2), lambda z: 0.0 if -0.1 - 1e-9 <= A[0] @ z <= 0.2 + 1e-9 else INF), "kl": (lambda s: KLDivergence(put(s, Y)), lambda z: (Y[0] * np.log(Y[0] / z) - Y[0] + z).sum() if (z > 0).all() else INF),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("tau", [0.3, 50.0])
def test_prox(spark, name, tau):
    make, value = CASES[name]
    f, r = make(spark), np.random.default_rng(1)
    p, v = get(f.prox(put(spark, X), tau)), get(f.apply(put(spark, X)))[:, 0]
    for i in range(2):
        want = value(X[i])
        assert v[i] == want or abs(v[i] - want) < 1e-9
        best = 2 * tau * value(p[i]) + ((p[i] - X[i]) ** 2).sum()
        assert np.isfinite(best)
        for _ in range(200):
            z = p[i] + r.standard_normal(6) * 10 ** r.uniform(-4, 0)
            assert 2 * tau * value(z) + ((z - X[i]) ** 2).sum() >= best - 1e-8


def test_moreau_identity(spark):
    f, x = L1Norm(6), put(spark, X)
    both = f.prox(x, 0.7).plus(f.fenchel_prox(x.scale(1 / 0.7), 1 / 0.7), 1, 0.7)
    assert np.allclose(get(both), X)
