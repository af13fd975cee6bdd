"""Sources: long form (series_id, band, t, m, w, ord) from any DataFrame, CSV light curves, and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400e6


def long_form(df: DataFrame, series_id: str, t: Column, m: Column, w: Column | None = None, band: Column | None = None, order: Column | None = None) -> DataFrame:
    """Rows without t or m go; a missing weight is 1."""
    df = df.select(
        F.col(series_id).alias("series_id"),
        (band if band is not None else F.lit("")).cast("string").alias("band"),
        t.cast("double").alias("t"),
        m.cast("double").alias("m"),
        F.coalesce(w.cast("double"), F.lit(1.0)).alias("w") if w is not None else F.lit(1.0).alias("w"),
        (order if order is not None else F.lit(0)).cast("long").alias("ord"),
    )
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return df.filter(ok("t") & ok("m"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table: users are series, event types bands; weight 1 / (0.1 value + 1)^2."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    days = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / F.lit(DAY)
    return long_form(df, "user_id", days, F.col("value"), 1 / F.pow(0.1 * F.col("value") + 1, F.lit(2.0)), F.col("event_type"), F.col("event_id"))


def csv(spark: SparkSession, path: str, value: str = "mag", error: str = "magerr") -> DataFrame:
    """Light curves as time, value, error, band; a series is a file; weight error^-2."""
    df = spark.read.csv(path, header=True, schema=f"time double, {value} double, {error} double, band string").withColumn("file", F.input_file_name())
    return long_form(df, "file", F.col("time"), F.col(value), F.try_divide(F.lit(1.0), F.col(error) * F.col(error)), F.col("band"))


def magnitude_to_flux(df: DataFrame) -> DataFrame:
    """m from magnitudes to fluxes 10^(-0.4 m), weights with it."""
    flux = F.pow(F.lit(10.0), -0.4 * F.col("m"))
    scale = flux * 0.4 * F.log(F.lit(10.0))
    return df.withColumn("w", F.col("w") / (scale * scale)).withColumn("m", flux)


def in_bands(df: DataFrame, bands: list[str]) -> DataFrame:
    return df.filter(F.col("band").isin(bands))


def declare_bands(df: DataFrame, bands: list[str]) -> DataFrame:
    """df whose bands are all among these; a row of another one fails the query."""
    other = F.raise_error(F.concat(F.lit("unknown band "), F.coalesce("band", F.lit("null"))))
    return df.withColumn("band", F.when(F.col("band").isin(bands), F.col("band")).otherwise(other.cast("string")))


def from_bands(parts: dict[str, DataFrame]) -> DataFrame:
    """One long form of several, each a band's."""
    found = [df.withColumn("band", F.lit(b)) for b, df in parts.items()]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def upsert_band(df: DataFrame, other: DataFrame) -> DataFrame:
    """other's (series, band) groups in place of df's."""
    return df.join(other.select("series_id", "band").distinct(), ["series_id", "band"], "left_anti").unionByName(other)


def pack(df: DataFrame, *keys: str) -> DataFrame:
    """One row per group: arrays t, m, w in time order. One exchange."""
    keys = keys or ("series_id",)
    row = F.array_sort(F.collect_list(F.struct("t", "ord", "m", "w"))).alias("p")
    return df.groupBy(*keys).agg(row).select(*keys, *(F.col(f"p.{c}").alias(c) for c in "tmw"))
