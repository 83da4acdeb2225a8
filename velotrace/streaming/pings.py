"""Pings as a stream: the parts of the batch engine that need no look ahead.

A session ends after a gap, as a segment does in batch; its features come out when the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings


def sessions(pings: DataFrame, c: Settings = DEFAULT, late: str = "10 minutes") -> DataFrame:
    """(taxi_id, start_ts, end_ts, n, mean_speed_kmh) of runs of pings without a gap; works on batches too."""
    moment = F.timestamp_seconds("timestamp")
    d = pings.withColumn("_at", moment).withWatermark("_at", late)
    g = d.groupBy("taxi_id", F.session_window("_at", f"{c.max_gap_sec} seconds")).agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.count(F.lit(1)).alias("n"), F.avg("speed").alias("mean_speed_kmh"))
    return g.drop("session_window")


def cell_counts(pings: DataFrame, size_deg: float = 0.01, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Pings and mean speed of squares of degrees in windows of time."""
    d = pings.withColumn("_at", F.timestamp_seconds("timestamp")).withWatermark("_at", late)
    row, col = F.floor(F.col("latitude") / size_deg), F.floor(F.col("longitude") / size_deg)
    g = d.groupBy(F.window("_at", window).alias("_w"), row.alias("row"), col.alias("col")).agg(F.count(F.lit(1)).alias("n"), F.avg("speed").alias("mean_speed_kmh"))
    return g.select(F.unix_timestamp("_w.start").alias("start_ts"), "row", "col", "n", "mean_speed_kmh")


def read(spark, path: str, schema) -> DataFrame:
    """Files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def write(df: DataFrame, path: str, checkpoint: str):
    """Each finished session or window once, as Parquet."""
    return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", path).trigger(availableNow=True).start()
