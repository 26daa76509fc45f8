"""Moments of an event stream per tumbling window, with a watermark for late data.

A window's state is one row of sums per key, so it does not grow with the events; it leaves
the state when the watermark passes its end.  The batch form over the same events gives the
same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_moments(events: DataFrame, ts: str, value: str, width: str, late: str, by: list[str] = ()) -> DataFrame:
    """start, keys, n, mean and var per window; events later than ``late`` are dropped by a
    stream and kept by a batch."""
    e = events.withColumn("ts_", F.col(ts).cast("timestamp")).withWatermark("ts_", late)
    g = e.groupBy(F.window("ts_", width).alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    return g.select(F.col("w.start").alias("start"), *by, "n", "mean", "var")


def write_windows(windows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to a Parquet folder until the input there is now is used up.
    Offsets and state go to ``checkpoint``, a shared folder; a restart goes on from there."""
    return windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(folder)
