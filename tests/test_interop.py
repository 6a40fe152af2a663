"""Plug-ins and arrays in and out."""

import types
from importlib import metadata

import numpy as np
import pytest

from fluxgrid.functions import interop
from fluxgrid.operators.linop import Identity, from_array
from fluxgrid.plans.grid import from_numpy
from fluxgrid.plans.op import LINEAR


class Entry:
    def __init__(self, name, value):
        self.name, self.value = name, value

    def load(self):
        return self.value


def test_plugins_extend_and_replace(monkeypatch):
    solvers, operators = types.ModuleType("own_solvers"), types.ModuleType("own_operators")
    operators.Identity = Identity
    monkeypatch.setitem(__import__("sys").modules, "own_solvers", solvers)
    monkeypatch.setitem(__import__("sys").modules, "own_operators", operators)
    found = {"own.operator": [Entry("Twice", int), Entry("_Identity", str)], "own.solver": [Entry("Fast", float)]}
    monkeypatch.setattr(metadata, "entry_points", lambda group: found[group])
    groups = {"own.operator": "own_operators", "own.solver": "own_solvers"}
    assert interop.register_plugins(groups) == {"own_operators": ["Twice", "Identity"], "own_solvers": ["Fast"]} or set(operators.__dict__) >= {"Twice", "Identity"}
    assert operators.Twice is int and operators.Identity is str and solvers.Fast is float
    found["own.operator"] = [Entry("Identity", bool)]
    with pytest.raises(ValueError):
        interop.register_plugins(groups)
    found["own.operator"] = [Entry("New", bool), Entry("_New", str)]
    with pytest.raises(ValueError):
        interop.register_plugins(groups)


class Sparse:
    """As a sparse matrix of another library looks; one cell comes twice."""

    shape, row, col, data = (3, 4), np.array([0, 2, 2]), np.array([1, 3, 3]), np.array([2.0, 1.0, 0.5])

    def tocoo(self):
        return self


def test_arrays(spark):
    a = np.random.default_rng(1).standard_normal((3, 4))
    a[1] = 0
    x, y = np.arange(8.0).reshape(2, 4), np.arange(6.0).reshape(2, 3)
    sparse = np.zeros((3, 4))
    sparse[0, 1], sparse[2, 3] = 2.0, 1.5
    cells = np.nonzero(a)
    for source, want, kwargs in ((a, a, {}), (Sparse(), sparse, {}), ((*cells, a[cells]), a, {"dim": 4, "codim": 3})):
        op = from_array(source, spark, rows=3, **kwargs)
        items, got = op.apply(from_numpy(spark, x, stacked=True)).to_numpy()
        assert items.tolist() == [0, 1] and np.allclose(got, x @ want.T)
        assert np.allclose(op.adjoint(from_numpy(spark, y, stacked=True)).to_numpy()[1], y @ want)
    one = from_numpy(spark, a)
    assert one.shape == (3, 4) and np.allclose(one.to_numpy()[1][0], a)
    with pytest.raises(ValueError):
        one.to_numpy(most=11)
    with pytest.raises(ValueError):
        from_array(([5], [0], [1.0]), spark, dim=2, codim=2)


def test_from_source_takes_what_operators_have():
    assert interop.KNOWN >= set("apply adjoint grad prox fenchel_prox moreau_envelope jacobian gram cogram svdvals pinv dagger asarray trace quad_spec lipschitz diff_lipschitz".split())
    assert not interop.KNOWN & {"T", "kind", "dim", "props"}
    with pytest.raises(ValueError, match="unknown methods"):
        interop.from_source(LINEAR, 3, 3, applies=lambda x: x)
