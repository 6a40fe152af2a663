"""Parquet in the folder that driver and executors share, and named sets of variables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where unset, and only in local mode, a local one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or f"file://{os.path.join(tempfile.gettempdir(), 'fluxgrid-state')}").rstrip("/") + "/grids"


def stage(df: DataFrame) -> DataFrame:
    """df written and read again: its lineage ends here, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Named tables of a loop, in a folder of their own; a name is dropped once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        self.drop()


def save(folder: str, variables: dict[str, DataFrame | None]) -> None:
    """One Parquet folder for each variable; None is skipped."""
    for name, df in variables.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every variable of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    entries = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(e.getPath().getName() for e in entries if e.isDirectory() and not e.getPath().getName().startswith("_"))
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in names}
