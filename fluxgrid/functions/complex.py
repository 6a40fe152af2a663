"""Complex values as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.plans.grid import Grid


def view_as_complex(x: Grid) -> DataFrame:
    """(*dim, 2) -> rows with re and im."""
    if x.shape[-1] != 2:
        raise ValueError("the last axis has two places")
    last = f"i{x.rank - 1}"
    part = lambda k: F.sum(F.when(F.col(last) == k, F.col("v")).otherwise(0.0))
    return x.df.groupBy(*x.keys[:-1]).agg(part(0).alias("re"), part(1).alias("im"))


def view_as_real(df: DataFrame, shape) -> Grid:
    """Rows with re and im -> (*dim, 2)."""
    keys = [c for c in df.columns if c not in ("re", "im")]
    rows = df.select(*keys, F.posexplode(F.array("re", "im")).alias("c", "v"))
    return Grid(rows.select(*keys, F.col("c").cast("long").alias(f"i{len(keys) - 1}"), "v"), (*shape, 2))


def as_real_matrix(table: DataFrame) -> DataFrame:
    """(row, col, re, im) -> (row, col, w) of the real matrix on interleaved pairs: [[re, -im], [im, re]]."""
    cells = F.array(*(F.struct((F.col("row") * 2 + i).alias("row"), (F.col("col") * 2 + j).alias("col"), w.alias("w")) for i, j, w in ((0, 0, F.col("re")), (0, 1, -F.col("im")), (1, 0, F.col("im")), (1, 1, F.col("re")))))
    return table.select(F.explode(cells).alias("c")).select("c.*")
