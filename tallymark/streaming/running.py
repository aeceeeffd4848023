"""Structured Streaming form of the error metrics.  An extension: the batch operators need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_errors(stream: DataFrame, time: str, y: str, p: str, grp: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Errors by group and tumbling window; rows later than ``late`` are left out."""
    e = F.col(p) - F.col(y)
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, width), grp)
        .agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
        .select(F.col("window.start").alias("start"), grp, "n", "rmse", "mae")
    )
