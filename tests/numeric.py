"""Grids from and to NumPy arrays."""

import numpy as np

from fluxgrid.plans.grid import grid

rng = np.random.default_rng(7)


def put(spark, a):
    """(items, *core) -> Grid"""
    a = np.asarray(a, float)
    names = ["s", *(f"i{k}" for k in range(a.ndim - 1))]
    rows = [(*map(int, at), float(v)) for at, v in np.ndenumerate(a)]
    return grid(spark.createDataFrame([(*r[:-1], r[-1]) for r in rows], ", ".join([*(f"{n} long" for n in names), "v double"])), a.shape[1:])


def get(g, items=2):
    out = np.zeros((items, *g.shape))
    rows = g.df.toPandas()
    out[tuple(rows[c] for c in g.keys)] = rows["v"]
    return out


def correlate(x, k, center, mode):
    k = np.asarray(k, float)
    p = np.pad(x, [(c, n - 1 - c) for c, n in zip(center, k.shape)], mode=mode)
    return sum(k[q] * p[tuple(slice(a, a + n) for a, n in zip(q, x.shape))] for q in np.ndindex(k.shape))
