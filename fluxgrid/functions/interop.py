"""Operators from user functions, and a registry of plug-ins."""

from __future__ import annotations

from importlib import import_module, metadata

import numpy as np

from fluxgrid.operators.fft import per_block
from fluxgrid.plans.grid import Grid
from fluxgrid.plans.op import Op, implied

#: What a node may define for itself: the public methods and bounds of Op.
KNOWN = {m for m, value in vars(Op).items() if not m.startswith("_") and (callable(value) or isinstance(value, float))}


def from_source(props: frozenset, dim, codim, embed: dict | None = None, **methods) -> Op:
    """An operator with the given properties whose methods are functions of (Grid, ...). Unknown names raise."""
    unknown = {m for m in methods if m not in KNOWN}
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}")
    op = Op(dim, codim, implied(props), "FromSource")
    for name, value in ((embed or {}) | methods).items():
        setattr(op, name, value)
    return op


def vectorize(fn, codim):
    """fn of one NumPy array (the core of an item) as a function of Grids: each item is one call in a Python worker."""

    def run(x: Grid) -> Grid:
        if len(codim) != x.rank:
            raise ValueError("the axes of the result must be as many as those of the input")
        return per_block(x, list(range(x.rank)), dict(enumerate(codim)), fn)

    return run


def from_matvec(props: frozenset, dim: int, codim: int, matvec, rmatvec) -> Op:
    """A linear operator between vectors from NumPy functions."""
    return from_source(props, (dim,), (codim,), apply=vectorize(matvec, (codim,)), adjoint=vectorize(rmatvec, (dim,)))


def to_matvec(op: Op, spark):
    """(matvec, rmatvec) on NumPy vectors, from the operator's matrix; for small cores."""
    from fluxgrid.functions.linalg import _matrix

    if len(op.dim) != 1 or len(op.codim) != 1:
        raise ValueError("vectors only")
    m = _matrix(op, spark)
    return (lambda x: m @ np.asarray(x)), (lambda y: m.T @ np.asarray(y))


#: Entry-point groups of plug-ins, and the module whose names each group extends.
GROUPS = {"fluxgrid.operator": "fluxgrid.operators", "fluxgrid.solver": "fluxgrid.solvers", "fluxgrid.stop": "fluxgrid.solvers.stop"}


def plugins(group: str = "fluxgrid.operator", names=None) -> dict:
    """Third-party operators, solvers or criteria by entry point."""
    return {e.name: e.load() for e in metadata.entry_points(group=group) if names is None or e.name in names}


def register_plugins(groups: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Puts the objects of all entry points into the modules of their groups, and returns their names by module. An entry
    point may replace a name that is there only if its own begins with an underscore, which is then dropped; a name that
    two entry points claim is an error, and so is one that can't be loaded."""
    done: dict[str, list[str]] = {}
    for group, module_name in (GROUPS if groups is None else groups).items():
        module, claimed = import_module(module_name), set()
        for entry in sorted(metadata.entry_points(group=group), key=lambda e: e.name):
            override, name = entry.name.startswith("_"), entry.name.removeprefix("_")
            if name in claimed:
                raise ValueError(f"{name} is claimed by two entry points of {group}")
            if hasattr(module, name) and not override:
                raise ValueError(f"{module_name}.{name} exists; an entry point named _{name} replaces it")
            claimed.add(name)
            setattr(module, name, entry.load())
            done.setdefault(module_name, []).append(name)
    return done
