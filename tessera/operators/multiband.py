"""Features over several bands of a series, from the long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.series import in_bands
from .features import Feature
from .native import extract_long


def colors(long: DataFrame, bands: list[str]) -> DataFrame:
    """Differences of two bands' maxima, minima and medians; null if a band is missing. One exchange."""
    a, b = bands
    at = lambda f, band: f(F.when(F.col("band") == band, F.col("m")))
    made = {"max": F.max, "min": F.min, "median": F.median}
    return long.groupBy("series_id").agg(*(F.round(at(f, a) - at(f, b), 6).alias(f"color_{k}_{a}_{b}") for k, f in made.items()))


def color_spread(long: DataFrame, bands: list[str]) -> DataFrame:
    """Population standard deviation of the bands' weighted means; null unless all bands are there."""
    means = in_bands(long, bands).groupBy("series_id", "band").agg(F.try_divide(F.sum(F.col("w") * F.col("m")), F.sum("w")).alias("wm"))
    return means.groupBy("series_id").agg(F.when(F.count("wm") == len(bands), F.round(F.stddev_pop("wm"), 6)).alias("color_spread"))


def per_band(long: DataFrame, wanted: list[Feature], bands: list[str]) -> DataFrame:
    """Each feature of each band, in the order given; null where a band is missing."""
    found = extract_long(in_bands(long, bands), wanted, ("series_id", "band"))
    columns = [(c, b) for f in wanted for c in f.columns for b in bands]
    return found.groupBy("series_id").agg(*(F.max(F.when(F.col("band") == b, F.col(c))).alias(f"{c}_{b}") for c, b in columns))
