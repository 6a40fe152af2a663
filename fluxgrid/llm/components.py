"""Connected components of a link table, by alternating star contractions over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.llm.common import Workspace


def components(links: DataFrame, work: Workspace, name: str = "stars") -> DataFrame:
    """(node, label) of every node of `links` (a, b): label is the smallest node reachable, itself included.

    Each round points the larger neighbours of every node to its smallest neighbour, then the smaller ones and itself to
    the same; the forest's depth falls geometrically. Only counts and a checksum of a round reach the driver.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    last, step = None, 0
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        w = Window.partitionBy("u")
        small = large.withColumn("m", F.min("v").over(w)).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = work.write(small, f"{name}-{step}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if step:
            work.drop(f"{name}-{step - 1}")
        if now == last or now[0] == 0:
            break
        last, step = now, step + 1
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
