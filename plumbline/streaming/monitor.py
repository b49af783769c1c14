"""Streaming forms of the row-local views, drift and label monitors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_local_view(stream: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """fn on a stream: projections only, so each row's result is that of the batch form."""
    return fn(stream)


def windowed_bins(stream: DataFrame, ts: str, value: str, bin_: Column, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window start, bin, n over tumbling windows; rows later than the watermark are dropped, windows close behind it."""
    rows = stream.select(F.col(ts).cast("timestamp").alias("ts"), F.col(value).alias("value")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), bin_.alias("bin")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "bin", "n")


def label_monitor(stream: DataFrame, ts: str, label: Column, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window start, volume, rate of a label over tumbling windows."""
    rows = stream.select(F.col(ts).cast("timestamp").alias("ts"), label.cast("int").alias("label")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("volume"), F.avg("label").alias("rate")).select(F.col("w.start").alias("start"), "volume", "rate")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what is there now to a Parquet sink, exactly once for each input file, and stops."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
