"""Moments of a stream in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(rows: DataFrame, time: str = "ts", value: str = "value", window: str = "1 day", slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, variance, skewness and kurtosis (population) of each window; rows later than `late` are left out of a
    stream. The state of a window is a handful of sums; on a batch the result is the same."""
    source = rows.withColumn("__t", F.col(time).cast("timestamp"))
    source = source.withWatermark("__t", late) if rows.isStreaming else source
    over = F.window("__t", window, slide) if slide else F.window("__t", window)
    out = source.groupBy(over.alias("w"), *by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt")
    )
    return out.select(F.col("w.start").alias("start"), *by, "n", "mean", "var", "skew", "kurt")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Runs a streaming aggregate over what is there now into an in-memory table."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
