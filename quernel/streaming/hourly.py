"""Figures of a query log as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_metrics(stream: DataFrame, time: str, group: str, value: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count, mean and maximum of ``value`` per tumbling window and group.

    In append mode a window comes out when the newest row is ``late`` past its
    end, and rows later than that are left out, so state stays bounded;
    timestamps without zone are taken as UTC.
    """
    rows = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    found = rows.groupBy(F.window("_at", size), group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    return found.select(F.col("window.start").alias("start"), group, "n", "mean", "most")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything the source holds now, in as many batches as it likes, as Parquet.

    A window is written once, when the watermark has passed its end, and its
    state is dropped; nothing is gathered on the driver. A run that is started
    again with the same checkpoint goes on where the last one ended.
    """
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
