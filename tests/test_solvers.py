import numpy as np
import pytest
from numeric import get, put

from fluxgrid.operators.linop import Explicit, Homothety, LinFunc
from fluxgrid.operators.norm import L1Norm, PositiveOrthant, QuadraticFunc, SquaredL2Norm
from fluxgrid.plans.op import POS_DEF
from fluxgrid.samplers.langevin import ULA
from fluxgrid.solvers.base import Mode
from fluxgrid.solvers.cg import CG, NLCG
from fluxgrid.solvers.gradient import PGD, Adam
from fluxgrid.solvers.splitting import ADMM, PD3O, CondatVu
from fluxgrid.solvers.stop import AbsError, ManualStop, MaxIter, RelError
from fluxgrid.sources.store import load

R = np.random.default_rng(3)
N = 4
M = R.standard_normal((N, N)) + 2 * np.eye(N)
S, B = M @ M.T + np.eye(N), R.standard_normal((2, N))


def matrix(spark, m, **kwargs):
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(m)]
    return Explicit(spark.createDataFrame(rows, "row long, col long, w double"), N, N, lipschitz=float(np.linalg.norm(m, 2)), **kwargs)


def test_cg(spark):
    x = CG(matrix(spark, S, props=POS_DEF)).fit(b=put(spark, B), stop=AbsError(1e-9, "residual") | MaxIter(6)).solution()
    assert np.allclose(get(x), np.linalg.solve(S, B.T).T, atol=1e-7)


def test_lasso(spark):
    a, b, lam = matrix(spark, M), B[:1], 0.3
    f = QuadraticFunc(N, a.gram(), LinFunc(put(spark, -(M.T @ b[0])[None])))
    h, x0 = L1Norm(N) * lam, put(spark, np.zeros((1, N)))
    z, step = np.zeros(N), 1 / np.linalg.norm(M, 2) ** 2
    for _ in range(20000):
        g = z - step * (M.T @ (M @ z - b[0]))
        z = np.sign(g) * np.maximum(np.abs(g) - lam * step, 0)
    cost = lambda v: 0.5 * ((M @ v - b[0]) ** 2).sum() + lam * np.abs(v).sum()
    for solver, n in ((PGD(f, h), 12), (PD3O(f, h=h), 12), (ADMM(f, h), 4)):
        x = get(solver.fit(x0=x0, max_iter=n).solution(), 1)[0]
        assert cost(x) - cost(z) < 0.2 * (cost(np.zeros(N)) - cost(z))


def test_modes_history_and_files(spark, tmp_path):
    f, x0 = SquaredL2Norm(N), put(spark, B)
    solver = PGD(f, folder=str(tmp_path), log_var=("x",))
    seen = [get(s["x"]) for s in solver.fit(x0=x0, mode=Mode.MANUAL, stop=ManualStop(), acceleration=False).steps(2)]
    assert len(seen) == 2 and np.allclose(seen[0], 0, atol=1e-9)
    solver.fit(x0=x0, stop=RelError(1e-9, "x") | MaxIter(3), track_objective=True)
    history, kept = solver.stats(spark)
    assert history.count() == len(solver.history) >= 2 and kept["x"] is not None
    assert {"history", "x"} <= set(load(spark, str(tmp_path)))


def test_errors_reach_the_caller(spark):
    with pytest.raises(ValueError):
        PGD(L1Norm(N)).fit(x0=put(spark, B), max_iter=1)


def test_nlcg_and_condat(spark):
    f, x0 = SquaredL2Norm(N), put(spark, B)
    assert np.allclose(get(NLCG(f).fit(x0=x0, max_iter=2).solution()), 0, atol=1e-6)
    x = CondatVu(f, h=L1Norm(N)).fit(x0=x0, max_iter=6).solution()
    assert np.abs(get(x)).sum() < np.abs(B).sum()


def test_samples_repeat(spark):
    chain = lambda: get(next(ULA(SquaredL2Norm(N)).samples(put(spark, B), seed=5)))
    assert np.array_equal(chain(), chain())
    assert Homothety(N, 2.0).pinv(put(spark, B)).df.count() == 2 * N


@pytest.mark.parametrize("g", [None, PositiveOrthant(N)])
def test_pd3o_without_h_moves_from_its_start(spark, g):
    """|x - t|^2 from a start that the prox of g leaves alone; with g, negative places of t end at 0."""
    t = np.array([[1.0, -2.0, 3.0, 0.5]])
    f = SquaredL2Norm(N).argshift(put(spark, -t))
    x = PD3O(f, g, beta=4.0).fit(x0=put(spark, np.full((1, N), 3.0)), stop=RelError(1e-4, "x") | MaxIter(25)).solution()
    assert np.allclose(get(x)[:1], t if g is None else np.maximum(t, 0), atol=1e-2)


@pytest.mark.parametrize("make", [lambda f, folder: PGD(f, L1Norm(N) * 0.5, folder=folder), lambda f, folder: PD3O(f, h=L1Norm(N), folder=folder)])
def test_resume(spark, tmp_path, make):
    """A fit that ends after two steps goes on as one that never ended; files hold two steps and their manifests."""
    f, x0 = SquaredL2Norm(N).argshift(put(spark, np.full((2, N), -2.0))), put(spark, B)
    pd3o = isinstance(make(f, None), PD3O)
    kwargs = {"x0": x0, "tau": 0.3} | ({"sigma": 0.5} if pd3o else {})
    stop = lambda: MaxIter(4) if pd3o else RelError(1e-12, "x") | MaxIter(4)
    whole = make(f, str(tmp_path / "a")).fit(stop=stop(), **kwargs)
    killed = make(f, str(tmp_path / "b"))
    list(killed.fit(mode=Mode.MANUAL, stop=stop(), **kwargs).steps(2))
    resumed = make(f, str(tmp_path / "b")).fit(stop=stop(), resume=True, **kwargs)
    assert [h["iteration"] for h in resumed.history] == list(range(5)) == [h["iteration"] for h in whole.history]
    assert np.allclose(get(resumed.solution()), get(whole.solution()), rtol=1e-12)
    assert pd3o or np.isclose(resumed.history[2]["RelError[x]"], whole.history[2]["RelError[x]"])
    names = [p.name for p in (tmp_path / "b" / "_state").iterdir() if not p.name.startswith(".")]
    assert sum(n.startswith("manifest") for n in names) == 2 and {n.split("-")[1].split(".")[0] for n in names} <= {"0", "2", "3", "4"}  # what the last two manifests name


def test_criteria(spark):
    """Values of the criteria on given states."""
    a, b = ({"x": put(spark, np.array([[3.0, 4.0, 0.0, 0.0], [0.0, 0.0, 0.0, v]]))} for v in (1.0, 2.0))
    for norm, want in ((2, 5.0), (1, 7.0), (np.inf, 4.0), (0, 2.0)):
        c = AbsError(5.0, "x", norm=norm)
        assert c.stop(a) == (want <= 5) and np.isclose(c.info()["AbsError[x]"], want)
    assert AbsError(1.0, "x", satisfy_all=False).stop(a)
    c = RelError(0.5, "x")
    assert not c.stop(a) and not c.stop(b) and np.isclose(c.info()["RelError[x]"], 1.0) and c.stop(b)
    c = MaxIter(2) & ManualStop()
    assert [c.stop(a) for _ in range(4)] == [False] * 4 and c.info()["N_iter"] == 4.0
    c = MaxIter(2) | ManualStop()
    c.clear()
    assert [c.stop(a) for _ in range(3)] == [False, False, True]


def test_adam_broadcasts_no_state(spark, monkeypatch):
    from fluxgrid.solvers.state import StateFolder

    plans, wide = [], StateFolder.wide

    def seen(self, df, *args):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return wide(self, df, *args)

    monkeypatch.setattr(StateFolder, "wide", seen)
    got = Adam(SquaredL2Norm(N)).fit(x0=put(spark, np.ones((2, N))), a=0.1, max_iter=2).solution()
    assert np.allclose(get(got), 0.8, atol=1e-2)
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert len(plans) == 2 and not joins
