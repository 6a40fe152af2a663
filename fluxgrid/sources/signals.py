"""Signals derived from tables, and synthetic ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.plans.grid import Grid, grid

DAYS, WIDTH = 2499, 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> Grid:
    """Quantity shipped on each day since 1995-01-02; days without any are 0."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-02").cast("date"))
    rows = read(spark, sf_dir, "lineitem").select(day.alias("i0"), "l_quantity").where(f"i0 between 0 and {DAYS - 1}").groupBy("i0").agg(F.sum("l_quantity").alias("v"))
    return grid(rows, DAYS).dense()


def heat(spark: SparkSession, sf_dir: str) -> Grid:
    """Cents of events by day (30) and hour (24)."""
    e = read(spark, sf_dir, "events").select(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("i0"), F.hour("ts").alias("i1"), F.round(F.col("value") * 100).cast("long").alias("c"))
    return grid(e.where("i0 between 0 and 29").groupBy("i0", "i1").agg(F.sum("c").alias("v")), (30, 24)).dense()


def vec(spark: SparkSession, sf_dir: str) -> Grid:
    """Embeddings: an item for each vector."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("s"), F.posexplode("embedding").alias("i0", "v"))
    return grid(e, WIDTH)


def tile(spark: SparkSession, sf_dir: str) -> Grid:
    """Embeddings as images of 8 x 8."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("s"), F.posexplode("embedding").alias("p", "v"))
    return grid(e.select("s", F.floor(F.col("p") / 8).alias("i0"), (F.col("p") % 8).alias("i1"), "v"), (8, 8))


def mat(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(row, col, w): quantity by supplier and line number, and the number of suppliers."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row"), (F.col("l_linenumber") - 1).cast("long").alias("col")).agg(F.sum("l_quantity").alias("w"))
    return rows, read(spark, sf_dir, "supplier").count()


def plane(spark: SparkSession, n: int, m: int, f, low: float = -3.0, high: float = 3.0) -> Grid:
    """f(x, y) on an n x m lattice of [low, high] squared."""
    k = F.col("id")
    at = spark.range(n * m).select(F.floor(k / m).alias("i0"), (k % m).alias("i1"))
    x, y = (F.lit(low) + F.col(c) * F.lit((high - low) / max(1, q - 1)) for c, q in (("i0", n), ("i1", m)))
    return grid(at.withColumn("v", f(x, y)), (n, m))


def peaks(x: Column, y: Column) -> Column:
    """A surface with hills and pits, for demonstrations."""
    hills = 3 * (1 - x) * (1 - x) * F.exp(-x * x - (y + 1) * (y + 1))
    pits = 10 * (x / 5 - x * x * x - F.pow(y, F.lit(5.0))) * F.exp(-x * x - y * y)
    return hills - pits - F.exp(-(x + 1) * (x + 1) - y * y) / 3


def star(spark: SparkSession, n: int, w: int = 8, s: float = 20.0, po: float = 3.0, x0: float = 0.7) -> Grid:
    """A star of 4 w rays on [-1, 1] squared (even n), fading over a sigmoid of slope s at radius x0, raised to a power,
    its largest value 1."""
    if n % 2:
        raise ValueError("the size must be even")

    def ray(y: Column, x: Column) -> Column:
        fade = 1 + F.exp(s * (F.sqrt(x * x + y * y) - x0))
        return F.pow(F.greatest((1 + F.cos(4 * w * F.atan2(y, x))) / fade, F.lit(0.0)) / 2, F.lit(float(po)))

    image = plane(spark, n, n, ray, -1.0, 1.0)
    top = image.df.agg(F.max("v").alias("top"))
    return Grid(image.df.crossJoin(F.broadcast(top)).select("s", "i0", "i1", (F.col("v") / F.col("top")).alias("v")), image.shape)
