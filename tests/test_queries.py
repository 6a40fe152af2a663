"""A sample of the queries on the smallest tables against DuckDB; the driver compares all of them."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from conftest import SF
from fluxgrid import queries as core

NAMES = "uf_log_edges jac_sigmoid ax_reshape sub_list pad_reflect_adj sum_multi_axes diagonal_pinv gram kron stencil_2d_wrap stencil_adj_edge gaussian_filter_order1 sobel structure_tensor_smooth hessian divergence dir_hessian dir_derivative_varying prox_sql1 prox_linf kl moreau_l1 argscale stack fft czt pgd_lasso pd3o admm cg_1step online_kurt windowed_moments flagship".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple("null" if pd.isna(v) else str(round(float(v), 5) + 0.0) for v in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, tables, name):
    got = core.queries()[name](spark, SF).toPandas()
    want = tables.execute(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert all(u == v or float(u) == pytest.approx(float(v), rel=1e-5, abs=1e-5) for u, v in zip(x, y, strict=True)), (x, y)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    # The corpus queries are there together or not at all.
    assert ("pipeline" in entry_module.queries()) == any(n.startswith("op1_") for n in entry_module.queries())
