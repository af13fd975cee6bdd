"""Features as Spark aggregates over the long form: no Python, and values combine before the shuffle.

plain ones are one aggregate. centred ones read the points a second time with the series' own statistics joined to
them, so a hot series is still split (skew join, or a broadcast where the statistics are small) and combined before the
shuffle. ordered ones use lags in time order: one exchange and sort, in which a series is one task's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.series import pack
from .features import Feature, extract, unique_columns

_over = F.try_divide


def _n() -> Column:
    return F.count(F.lit(1)).cast("double")


def _moment(kind: str) -> Column:
    """Sample skewness or kurtosis from the population's."""
    n = _n()
    if kind == "skew":
        return _over(F.sqrt(n * (n - 1)), n - 2) * F.skewness("m")
    return _over((n - 1) * ((n + 1) * F.kurtosis("m") + 6), (n - 2) * (n - 3))


def _percent_amplitude() -> Column:
    return F.greatest(F.max("m") - F.median("m"), F.median("m") - F.min("m"))


PLAIN: dict[str, Callable[[], list[Column]]] = {
    "Amplitude": lambda: [(F.max("m") - F.min("m")) / 2],
    "Duration": lambda: [F.max("t") - F.min("t")],
    "ExcessVariance": lambda: [F.when(F.min(F.abs("w")) > 0, _over(F.var_samp("m") - F.avg(_over(F.lit(1.0), F.col("w"))), F.avg("m") * F.avg("m")))],
    "Kurtosis": lambda: [_moment("kurtosis")],
    "Mean": lambda: [F.avg("m")],
    "MeanVariance": lambda: [_over(F.stddev_samp("m"), F.avg("m"))],
    "Median": lambda: [F.median("m")],
    "ObservationCount": lambda: [_n()],
    "PercentAmplitude": lambda: [_percent_amplitude()],
    "Skew": lambda: [_moment("skew")],
    "StandardDeviation": lambda: [F.stddev_samp("m")],
    "TimeMean": lambda: [F.avg("t")],
    "TimeStandardDeviation": lambda: [F.stddev_samp("t")],
    "WeightedMean": lambda: [_over(F.sum(F.col("w") * F.col("m")), F.sum("w"))],
}

#: What centred features need to know of a series beforehand.
STATISTICS: dict[str, Callable[[], Column]] = {
    "__mean": lambda: F.avg("m"),
    "__sd": lambda: F.stddev_samp("m"),
    "__median": lambda: F.median("m"),
    "__half": lambda: (F.max("m") - F.min("m")) / 2,
    "__weighted": lambda: _over(F.sum(F.col("w") * F.col("m")), F.sum("w")),
    "__centre": lambda: _over(F.sum(F.col("w") * F.col("t")), F.sum("w")),
    "__time": lambda: F.avg("t"),
}


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def _chi2() -> Column:
    d = F.col("m") - F.col("__weighted")
    return F.sum(F.col("w") * d * d)


def _line(known: bool) -> list[Column]:
    w = F.col("w") if known else F.lit(1.0)
    x, y = F.col("t") - F.col("__centre" if known else "__time"), F.col("m") - F.col("__weighted" if known else "__mean")
    sxx, sxy, syy = F.sum(w * x * x), F.sum(w * x * y), F.sum(w * y * y)
    slope = _over(sxy, sxx)
    chi2 = F.greatest(_over(syy - slope * sxy, _n() - 2), F.lit(0.0))
    if known:
        return [slope, F.sqrt(_over(F.lit(1.0), sxx)), chi2]
    return [slope, F.sqrt(_over(chi2, sxx)), F.sqrt(chi2)]


def _roms() -> Column:
    term = F.abs(F.col("m") - F.col("__median")) * F.sqrt("w")
    return _over(F.sum(F.when(~F.isnan(term) & (term < float("inf")), term).otherwise(0.0)), _n() - 1)


#: The statistics and the values, given the parameters.
CENTRED: dict[str, tuple[tuple[str, ...], Callable[..., list[Column]]]] = {
    "BeyondNStd": (("__mean", "__sd"), lambda nstd=1.0: [_share(F.abs(F.col("m") - F.col("__mean")) > nstd * F.col("__sd"))]),
    "LinearFit": (("__centre", "__weighted"), lambda: _line(True)),
    "LinearTrend": (("__time", "__mean"), lambda: _line(False)),
    "MedianAbsoluteDeviation": (("__median",), lambda: [F.median(F.abs(F.col("m") - F.col("__median")))]),
    "MedianBufferRangePercentage": (("__median", "__half"), lambda q=0.1: [_share(F.abs(F.col("m") - F.col("__median")) < q * F.col("__half"))]),
    "ReducedChi2": (("__weighted",), lambda: [_over(_chi2(), _n() - 1)]),
    "Roms": (("__median",), lambda: [_roms()]),
    "StetsonK": (("__weighted",), lambda: [_over(F.sum(F.abs(F.col("m") - F.col("__weighted")) * F.sqrt("w")), F.sqrt(_n() * _chi2()))]),
}


def _eta_e() -> Column:
    span, n = F.max("t") - F.min("t"), _n() - 1
    return _over(span * span * F.sum(F.col("__slope") * F.col("__slope")), F.var_samp("m") * n * n * n)


def _lafler() -> Column:
    at = F.struct("t", "ord", "m", "w")
    back = F.max_by("m", at) - F.min_by("m", at)
    return _over(F.sum(F.col("__dm") * F.col("__dm")) + back * back, 2 * (_n() - 1) * F.var_samp("m"))


ORDERED: dict[str, Callable[[], list[Column]]] = {
    "Cusum": lambda: [_over(F.max("__sum") - F.min("__sum"), F.stddev_samp("m") * _n())],
    "Eta": lambda: [_over(F.sum(F.col("__dm") * F.col("__dm")), (_n() - 1) * F.var_samp("m"))],
    "EtaE": lambda: [_eta_e()],
    "LaflerKinmanStringLength": lambda: [_lafler()],
    "MaximumSlope": lambda: [F.max(F.abs("__slope"))],
    "MaximumTimeInterval": lambda: [F.max("__dt")],
    "MinimumTimeInterval": lambda: [F.min("__dt")],
}


def is_native(f: Feature) -> bool:
    return f.plain and f.name in PLAIN.keys() | CENTRED.keys() | ORDERED.keys()


def _lags(rows: DataFrame, keys: tuple[str, ...], cusum: bool) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy("t", "ord", "m", "w")
    rows = rows.withColumns({"__dm": F.col("m") - F.lag("m").over(ordered), "__dt": F.col("t") - F.lag("t").over(ordered)})
    rows = rows.withColumn("__slope", _over(F.col("__dm"), F.col("__dt")))
    if cusum:
        rows = rows.withColumn("__all", F.avg("m").over(Window.partitionBy(*keys)))
        rows = rows.withColumn("__sum", F.sum(F.col("m") - F.col("__all")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return rows


def _guarded(f: Feature, value: Column, fill: float | None) -> Column:
    """Null (or fill) for a series that is short, or flat where that matters, and for what is not finite."""
    ok = F.count(F.lit(1)) >= f.least
    if "v" in f.needs:
        ok &= F.min("m") < F.max("m")
    value = F.when(ok & ~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return value if fill is None else F.coalesce(value, F.lit(fill))


def aggregate(long: DataFrame, wanted: list[Feature], keys: tuple[str, ...] = ("series_id",), fill: float | None = None) -> DataFrame:
    """keys and the columns of all wanted features, each of which has a native form."""
    if lacking := [f.name for f in wanted if not is_native(f)]:
        raise ValueError(f"no native form: {', '.join(lacking)}")
    wanted = unique_columns(wanted)
    names = {f.name for f in wanted}
    rows = long.select(*keys, "t", "m", "w", "ord")
    if known := sorted({s for n in names if n in CENTRED for s in CENTRED[n][0]}):
        rows = rows.join(rows.groupBy(*keys).agg(*(STATISTICS[s]().alias(s) for s in known)), list(keys))
    if names & ORDERED.keys():
        rows = _lags(rows, keys, "Cusum" in names)
    out = []
    for f in wanted:
        if f.name in PLAIN:
            values = PLAIN[f.name]()
        elif f.name in ORDERED:
            values = ORDERED[f.name]()
        else:
            values = CENTRED[f.name][1](**dict(f.parameters))
        out += [_guarded(f, v, fill).alias(c) for c, v in zip(f.columns, values, strict=True)]
    return rows.groupBy(*keys).agg(*out)


def extract_long(long: DataFrame, wanted: list[Feature], keys: tuple[str, ...] = ("series_id",), strict: bool = False, fill: float | None = None) -> DataFrame:
    """Features of series in the long form: as aggregates if all have a native form, else in one Arrow pass over packed rows."""
    if wanted and not strict and all(map(is_native, wanted)):
        return aggregate(long, wanted, keys, fill)
    return extract(pack(long, *keys), wanted, keys, strict, fill)


def binned_long(long: DataFrame, window: float = 1.0, offset: float = 0.0, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """The long form after binning: a bin's centre without the offset, weighted mean and mean weight. One aggregate."""
    at = F.floor((F.col("t") - offset) / window)
    found = long.groupBy(*keys, at.alias("at")).agg(_over(F.sum(F.col("w") * F.col("m")), F.sum("w")).alias("m"), F.avg("w").alias("w"))
    return found.select(*keys, ((F.col("at") + 0.5) * window).alias("t"), "m", "w", F.lit(0).cast("long").alias("ord"))


def extremes(long: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """keys; t_min, t_max: the first times of the least and the greatest m; signal_to_noise of the greatest; plateau: all m are one."""
    first = lambda m: F.min_by("t", F.struct(m, "t", "ord"))
    noise = _over(F.max("m") - F.avg("m"), F.stddev_samp("m"))
    return long.groupBy(*keys).agg(first("m").alias("t_min"), first((-F.col("m")).alias("m")).alias("t_max"), noise.alias("signal_to_noise"), (F.min("m") == F.max("m")).alias("plateau"))
