"""Bins over a stream of points: tumbling windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned_stream(points: DataFrame, at: str = "ts", window: str = "7 days", late: str = "1 day", start: str = "0 seconds") -> DataFrame:
    """series_id, band, start and end of each window, weighted mean m, mean weight w and n of its points.

    points: series_id, band, m, w and a timestamp. Points later than the watermark are left out; state is one row for
    each open window of a series, so it is bounded by the series seen within the watermark. Works on tables too.
    """
    grouped = points.withWatermark(at, late).groupBy("series_id", "band", F.window(at, window, startTime=start).alias("window"))
    found = grouped.agg(F.sum(F.col("w") * F.col("m")).alias("wm"), F.sum("w").alias("sum_w"), F.count("*").alias("n"))
    return found.select("series_id", "band", F.col("window.start").alias("start"), F.col("window.end").alias("end"), F.try_divide("wm", "sum_w").alias("m"), (F.col("sum_w") / F.col("n")).alias("w"), "n")
