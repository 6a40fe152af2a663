"""What several operators share: staged tables, size-checked filters, reserved column names."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifiers that a semi join may broadcast: 2 million longs are 16 MB.
BROADCAST_IDS = 2_000_000
#: The bytes [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"
#: What empties the caches that a Python worker holds from task to task.
CACHES: list[Callable[[], None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; only where unset, and only in local mode, a
    local one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or f"file://{os.path.join(tempfile.gettempdir(), 'fluxgrid-checkpoint')}").rstrip("/") + "/fluxgrid"


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """Tables written to the shared folder. They cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Only for tables that no DataFrame handed out still reads. Shuffle files of finished steps go as well."""
        for name in names:
            drop_path(self.spark, f"{self.root}/{name}")
        gc.collect()
        self.spark._jvm.System.gc()

    def settle(self, *names: str) -> None:
        """Drops tables and the shuffle files of all that has ended, which otherwise wait for a collection of the driver's old
        objects. The last query is held until another one ran, and what a collection finds goes with the next."""
        self.spark.range(1).count()
        self.drop(*names)
        time.sleep(0.3)
        self.drop()


def only_ids(rows: DataFrame, ids: DataFrame, key: str, count: int, bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows whose key is among the `count` distinct ids: by broadcast up to `bound` of them, else by a shuffled join."""
    ids = ids.select(key)
    return rows.join(F.broadcast(ids) if count <= bound else ids.hint("merge"), key, "left_semi")


def bits_of(ids: DataFrame, key: str) -> DataFrame:
    """(block, mask): the ids of 64 neighbours as the bits of one number."""
    mask = F.bit_or(F.expr(f"shiftleft(1L, cast({key} & 63 as int))"))
    return ids.groupBy(F.shiftright(key, 6).alias("block")).agg(mask.alias("mask"))


def where_bit(rows: DataFrame, masks: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows whose key has its bit in the broadcast `masks`, or (not keep) has not."""
    rows = rows.withColumn("block", F.shiftright(key, 6))
    bit = F.expr(f"shiftrightunsigned(mask, cast({key} & 63 as int)) & 1L")
    both = rows.join(F.broadcast(masks), "block", "inner" if keep else "left")
    return both.where(bit == 1 if keep else F.coalesce(bit, F.lit(0)) == 0).drop("block", "mask")


def only_rows(rows: DataFrame, ids: DataFrame, count: int, keep: bool = True) -> DataFrame:
    """Rows whose number `row` is among the `count` distinct ids, or (not keep) is not. Numbers of a scan lie close, so that
    beyond the bound of ids a broadcast takes 64 as one; `rows`, with its texts, is shuffled only where these are too many."""
    ids, how = ids.select("row"), "left_semi" if keep else "left_anti"
    if count <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), "row", how)
    masks = bits_of(ids, "row")
    return where_bit(rows, masks, "row", keep) if masks.count() <= BROADCAST_IDS else rows.join(ids.hint("merge"), "row", how)


def empty_caches() -> None:
    """Of this worker, which Spark also gives to tasks of other operators."""
    for empty in CACHES:
        empty()


def tidy(run, keep: bool = False):
    """run, a function of Arrow batches; when its task ends, memory that the worker no longer uses goes back to the system,
    so that idle workers stay small. keep: run uses the worker's caches, which else go before it starts."""

    def wrapped(batches):
        if not keep:
            empty_caches()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def small_batches(spark: SparkSession) -> None:
    """From now on Python workers get texts in batches of 8 MB; by itself Spark sends 10,000 rows, or 64 MB, at once, which a
    task holds in the JVM and in its worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))
