"""Features of a packed series. Each has columns, flags and a numpy kernel; all wanted ones run in one Arrow pass.

A feature is null for a series that is too short or, where it needs variability, flat.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import kernels
from ..functions.kernels import quantile


@dataclass(frozen=True)
class Feature:
    name: str
    columns: tuple[str, ...]
    least: int
    kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], list]  # of t, m, w
    needs: str = "m"  # of t, m, w, s (order), v (variability)
    parameters: tuple[tuple[str, object], ...] = ()  # as given
    plain: bool = False  # one of this module's: a native form may stand for the kernel

    @property
    def descriptions(self) -> tuple[str, ...]:
        """One for each column."""
        about = ABOUT.get(self.name, self.name)
        return tuple(about if len(self.columns) == 1 else f"{about}: {c}" for c in self.columns)


#: What features are, for descriptions.
ABOUT = {
    "Amplitude": "half the range of magnitudes",
    "AndersonDarlingNormal": "Anderson-Darling statistic against a normal distribution of magnitudes",
    "BeyondNStd": "share of points further from the mean than some standard deviations",
    "BiweightScale": "Tukey's biweight scale of magnitudes",
    "Chi2Pvar": "chance of so large a chi-square for a constant series",
    "Cusum": "range of cumulative sums of magnitudes",
    "Duration": "time from the first to the last point",
    "Eta": "von Neumann's ratio of successive differences to the variance",
    "EtaE": "ratio of squared slopes to the variance, for uneven times",
    "ExcessVariance": "variance beyond that of the errors, over the squared mean",
    "InterPercentileRange": "range between a quantile and its mirror",
    "Kurtosis": "excess kurtosis of magnitudes, without bias",
    "LaflerKinmanStringLength": "squared length of the closed string of points over the variance",
    "LinearFit": "weighted straight-line fit",
    "LinearTrend": "straight-line fit without weights",
    "MagnitudePercentageRatio": "ratio of two inter-percentile ranges",
    "MaximumSlope": "largest absolute slope between neighbours",
    "MaximumTimeInterval": "longest time between neighbours",
    "MinimumTimeInterval": "shortest time between neighbours",
    "Mean": "mean magnitude",
    "MeanVariance": "standard deviation over the mean",
    "Median": "median magnitude",
    "MedianAbsoluteDeviation": "median distance from the median",
    "MedianBufferRangePercentage": "share of points near the median",
    "ObservationCount": "number of points",
    "OtsuSplit": "split of magnitudes into two groups by Otsu's threshold",
    "ParabolaFit": "weighted fit of a parabola",
    "PercentAmplitude": "largest distance from the median",
    "PercentDifferenceMagnitudePercentile": "inter-percentile range over the median",
    "Periodogram": "peaks of the periodogram",
    "QnScale": "Qn scale of magnitudes",
    "ReducedChi2": "reduced chi-square of the weighted mean",
    "Roms": "robust median statistic",
    "Skew": "skewness of magnitudes, without bias",
    "StandardDeviation": "standard deviation of magnitudes",
    "StetsonK": "Stetson's K",
    "TimeMean": "mean time",
    "TimeStandardDeviation": "standard deviation of times",
    "WeightedMean": "weighted mean magnitude",
}


def renamed(f: Feature, *columns: str) -> Feature:
    """f with other columns."""
    if len(columns) != len(f.columns):
        raise ValueError(f"{f.name} has {len(f.columns)} columns")
    return replace(f, columns=tuple(columns))


def unique_columns(wanted: list) -> list:
    """Features with a column that an earlier one has get a number after it (names hold rounded parameters)."""
    met: dict[str, int] = {}
    out = []
    for f in wanted:
        columns = []
        for c in f.columns:
            met[c.lower()] = times = met.get(c.lower(), 0) + 1
            columns.append(c if times == 1 else f"{c}_{times}")
        out.append(replace(f, columns=tuple(columns)) if tuple(columns) != f.columns else f)
    return out


def _name(value: float, scale: float = 1) -> str:
    return f"{value * scale:.0f}"


def _ratio(a: float, b: float) -> float | None:
    return a / b if b else None


def _range(m: np.ndarray, q: float) -> float:
    return quantile(m, q, True) - quantile(m, q)


def _slopes(t: np.ndarray, m: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.diff(m) / np.diff(t)
    return s[np.isfinite(s)]


def _weighted(m: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted mean and chi-square."""
    mean = (w * m).sum() / w.sum()
    return mean, (w * (m - mean) ** 2).sum()


def _standardized(m: np.ndarray, p: int) -> float:
    return (((m - m.mean()) / m.std(ddof=1)) ** p).sum()


def _cusum(m: np.ndarray) -> float:
    c = np.cumsum(m - m.mean())
    return (c.max() - c.min()) / (m.std(ddof=1) * len(m))


def _kurtosis(m: np.ndarray) -> float:
    n = len(m)
    return n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * _standardized(m, 4) - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))


def _biweight(m: np.ndarray, c: float) -> float | None:
    d = m - np.median(m)
    mad = np.median(np.abs(d))
    if not mad:
        return 0.0
    u2 = (d / (c * mad)) ** 2
    d, u2 = d[u2 < 1], u2[u2 < 1]
    return _ratio(float(np.sqrt(len(m) * (d**2 * (1 - u2) ** 4).sum())), abs(float(((1 - u2) * (1 - 5 * u2)).sum())))


def _lafler(m: np.ndarray) -> float:
    return (np.diff(np.r_[m, m[0]]) ** 2).sum() / (2 * (len(m) - 1) * m.var(ddof=1))


def line(t: np.ndarray, m: np.ndarray, w: np.ndarray | None) -> list[float | None]:
    """Straight-line fit with weights w (slope, its error, reduced chi-square), or without (slope, error, noise)."""
    v = np.ones(len(t)) if w is None else w
    x, y = t - (v * t).sum() / v.sum(), m - (v * m).sum() / v.sum()
    sxx = (v * x * x).sum()
    if not sxx:
        return [None] * 3
    slope = (v * x * y).sum() / sxx
    chi2 = (v * (y - slope * x) ** 2).sum() / (len(t) - 2)
    return [slope, np.sqrt(1 / sxx), chi2] if w is not None else [slope, np.sqrt(chi2 / sxx), np.sqrt(chi2)]


def otsu(o: np.ndarray) -> tuple[int, list[float]]:
    """The number of lower values at the first best split of a sorted array, and the four features."""
    n = len(o)
    k = np.arange(1, n)
    sums = np.cumsum(o)
    low, high = sums[:-1] / k, (sums[-1] - sums[:-1]) / (n - k)
    best = int(np.argmax(k / n * (1 - k / n) * (low - high) ** 2)) + 1
    std = lambda x: float(np.std(x, ddof=1)) if len(x) > 1 else 0.0
    return best, [float(o[best:].mean() - o[:best].mean()), std(o[:best]), std(o[best:]), best / n]


def parabola(t: np.ndarray, m: np.ndarray, w: np.ndarray) -> list[float | None]:
    """Weighted quadratic fit: leading coefficient, extremum, reduced chi-square."""
    mean = (w * t).sum() / w.sum()
    x = t - mean
    a = np.stack([x * x, x, np.ones_like(x)], 1)
    g, b, c = np.linalg.solve((a * w[:, None]).T @ a, (a * w[:, None]).T @ m)
    if g == 0:
        return [None, None, None]
    return [float(g), float(c - b * b / (4 * g)), float((w * (m - a @ [g, b, c]) ** 2).sum() / (len(t) - 3))]


def periodogram(t, m, peaks_: int = 1, resolution: float = 10, factor: float = 1, nyquist="average", fft: bool = True, normalization: str = "psd", freq=None):
    """freq, power of a series; freq: a grid of one's own."""
    freq = kernels.grid(t, resolution, factor, nyquist, fft) if freq is None else np.asarray(freq, float)
    power = (kernels.power_fft if fft else kernels.power_direct)(t, m, freq)
    return freq, kernels.normalized(power, len(t), normalization)


def checked(options: dict) -> dict:
    """Options of a spectrum; a grid of one's own must ascend and, for the FFT, be zero-based with 2^k + 1 even points."""
    if options.get("freq") is not None:
        freq = kernels.arbitrary_grid(options["freq"])
        if options.get("fft", True) and not kernels.suits_fft(freq):
            raise ValueError("the FFT needs a zero-based even grid of 2^k + 1 points")
        options = options | {"freq": freq}
    return options


def top_peaks(freq: np.ndarray, power: np.ndarray, k: int) -> list[float]:
    """Period and signal-to-noise of the k highest peaks; 0 where there are fewer."""
    out, sd = [], np.std(power, ddof=1) if len(power) > 1 else 0
    for i in kernels.peaks(power)[:k]:
        out += [2 * np.pi / freq[i] if freq[i] else 0.0, (power[i] - power.mean()) / sd if sd else 0.0]
    return [float(x) for x in out] + [0.0] * (2 * k - len(out))


def bins(t, m, w, window: float = 1.0, offset: float = 0.0):
    """Weighted means of runs of points in one bin; a bin's time is its centre, without the offset."""
    at = np.floor((t - offset) / window)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(t) else np.zeros(0, int)
    size = np.diff(np.r_[first, len(t)])
    s = np.add.reduceat(w, first) if len(t) else w
    return (at[first] + 0.5) * window, np.add.reduceat(w * m, first) / s if len(t) else m, s / size


#: What parameters must be.
_LIMITS: dict[tuple[str, str], Callable[[float], bool]] = {
    ("BeyondNStd", "nstd"): lambda v: v > 0,
    ("BiweightScale", "c"): lambda v: v > 0,
    ("InterPercentileRange", "q"): lambda v: 0 < v < 0.5,
    ("MagnitudePercentageRatio", "n"): lambda v: 0 < v < 0.5,
    ("MagnitudePercentageRatio", "d"): lambda v: 0 < v < 0.5,
    ("MedianBufferRangePercentage", "q"): lambda v: v > 0,
    ("PercentDifferenceMagnitudePercentile", "q"): lambda v: 0 < v < 0.5,
}


def _roms(m: np.ndarray, w: np.ndarray) -> float:
    with np.errstate(invalid="ignore"):
        terms = np.abs((m - np.median(m)) * np.sqrt(w))
    return terms[np.isfinite(terms)].sum() / (len(m) - 1)


def _steepest(t: np.ndarray, m: np.ndarray) -> float | None:
    s = np.abs(_slopes(t, m))
    return s.max() if len(s) else None


def _spectrum(peaks: int = 1, **options) -> Feature:
    options = checked(options)
    columns = tuple(f"periodogram_{kind}_{i}" for i in range(peaks) for kind in ("period", "period_s_to_n"))
    return Feature("Periodogram", columns, 2, lambda t, m, w: top_peaks(*periodogram(t, m, **options), peaks), "tms")


def _make() -> dict[str, Callable[..., Feature]]:
    def simple(name, columns, least, value, needs="m"):
        return lambda: Feature(name, columns, least, value, needs, plain=True)

    def named(name, column, least, value, needs="m", **defaults):
        """column and value take the parameters."""

        def make(**given):
            p = defaults | given
            for k, v in p.items():
                if not _LIMITS[name, k](v):
                    raise ValueError(f"{name} can't have {k} = {v}")
            return Feature(name, (column(**p),), least, lambda t, m, w: [value(m, **p)], needs, plain=True)

        return make

    percent = lambda stem: lambda q: f"{stem}_{_name(q, 100)}"
    return {
        "Amplitude": simple("Amplitude", ("amplitude",), 1, lambda t, m, w: [(m.max() - m.min()) / 2], "m"),
        "AndersonDarlingNormal": simple("AndersonDarlingNormal", ("anderson_darling_normal",), 4, lambda t, m, w: [kernels.anderson_darling_normal(m)], "mv"),
        "Chi2Pvar": simple("Chi2Pvar", ("chi2_pvar",), 2, lambda t, m, w: [kernels.chi2_pvar(m, w)], "mw"),
        "Cusum": simple("Cusum", ("cusum",), 2, lambda t, m, w: [_cusum(m)], "msv"),
        "Duration": simple("Duration", ("duration",), 1, lambda t, m, w: [t[-1] - t[0]], "ts"),
        "Eta": simple("Eta", ("eta",), 2, lambda t, m, w: [(np.diff(m) ** 2).sum() / ((len(m) - 1) * m.var(ddof=1))], "msv"),
        "EtaE": simple("EtaE", ("eta_e",), 2, lambda t, m, w: [(t[-1] - t[0]) ** 2 * (_slopes(t, m) ** 2).sum() / (m.var(ddof=1) * (len(m) - 1) ** 3)], "tmsv"),
        "ExcessVariance": simple("ExcessVariance", ("excess_variance",), 2, lambda t, m, w: [_ratio(m.var(ddof=1) - (1 / w).mean(), m.mean() ** 2)], "mw"),
        "Kurtosis": simple("Kurtosis", ("kurtosis",), 4, lambda t, m, w: [_kurtosis(m)], "mv"),
        "LaflerKinmanStringLength": simple("LaflerKinmanStringLength", ("lafler_kinman_string_length",), 2, lambda t, m, w: [_lafler(m)], "msv"),
        "MaximumSlope": simple("MaximumSlope", ("maximum_slope",), 2, lambda t, m, w: [_steepest(t, m)], "tms"),
        "MaximumTimeInterval": simple("MaximumTimeInterval", ("maximum_time_interval",), 2, lambda t, m, w: [np.diff(t).max()], "ts"),
        "MinimumTimeInterval": simple("MinimumTimeInterval", ("minimum_time_interval",), 2, lambda t, m, w: [np.diff(t).min()], "ts"),
        "Mean": simple("Mean", ("mean",), 1, lambda t, m, w: [m.mean()], "m"),
        "MeanVariance": simple("MeanVariance", ("mean_variance",), 2, lambda t, m, w: [_ratio(m.std(ddof=1), m.mean())], "m"),
        "Median": simple("Median", ("median",), 1, lambda t, m, w: [np.median(m)], "m"),
        "MedianAbsoluteDeviation": simple("MedianAbsoluteDeviation", ("median_absolute_deviation",), 1, lambda t, m, w: [np.median(np.abs(m - np.median(m)))], "m"),
        "ObservationCount": simple("ObservationCount", ("observation_count",), 0, lambda t, m, w: [float(len(m))], ""),
        "PercentAmplitude": simple("PercentAmplitude", ("percent_amplitude",), 1, lambda t, m, w: [max(m.max() - np.median(m), np.median(m) - m.min())], "m"),
        "QnScale": simple("QnScale", ("qn",), 2, lambda t, m, w: [kernels.qn(m)], "m"),
        "ReducedChi2": simple("ReducedChi2", ("chi2",), 2, lambda t, m, w: [_weighted(m, w)[1] / (len(m) - 1)], "mw"),
        "Roms": simple("Roms", ("roms",), 2, lambda t, m, w: [_roms(m, w)], "mw"),
        "Skew": simple("Skew", ("skew",), 3, lambda t, m, w: [len(m) / ((len(m) - 1) * (len(m) - 2)) * _standardized(m, 3)], "mv"),
        "StandardDeviation": simple("StandardDeviation", ("standard_deviation",), 2, lambda t, m, w: [m.std(ddof=1)], "m"),
        "StetsonK": simple("StetsonK", ("stetson_K",), 2, lambda t, m, w: [np.abs((m - _weighted(m, w)[0]) * np.sqrt(w)).sum() / np.sqrt(len(m) * _weighted(m, w)[1])], "mwv"),
        "TimeMean": simple("TimeMean", ("time_mean",), 1, lambda t, m, w: [t.mean()], "t"),
        "TimeStandardDeviation": simple("TimeStandardDeviation", ("time_standard_deviation",), 2, lambda t, m, w: [t.std(ddof=1)], "t"),
        "WeightedMean": simple("WeightedMean", ("weighted_mean",), 1, lambda t, m, w: [_weighted(m, w)[0]], "mw"),
        "LinearFit": simple("LinearFit", ("linear_fit_slope", "linear_fit_slope_sigma", "linear_fit_reduced_chi2"), 3, line, "tmws"),
        "LinearTrend": simple("LinearTrend", ("linear_trend", "linear_trend_sigma", "linear_trend_noise"), 3, lambda t, m, w: line(t, m, None), "tms"),
        "OtsuSplit": simple("OtsuSplit", ("otsu_mean_diff", "otsu_std_lower", "otsu_std_upper", "otsu_lower_to_all_ratio"), 2, lambda t, m, w: otsu(np.sort(m))[1], "mv"),
        "ParabolaFit": simple("ParabolaFit", ("parabola_fit_g", "parabola_fit_m0", "parabola_fit_reduced_chi2"), 4, parabola, "tmwsv"),
        "BeyondNStd": named("BeyondNStd", lambda nstd: f"beyond_{_name(nstd)}_std", 2, lambda m, nstd: (np.abs(m - m.mean()) > nstd * m.std(ddof=1)).mean(), nstd=1.0),
        "BiweightScale": named("BiweightScale", lambda c: f"biweight_scale_{_name(c)}", 1, _biweight, c=9.0),
        "InterPercentileRange": named("InterPercentileRange", percent("inter_percentile_range"), 1, _range, q=0.25),
        "MagnitudePercentageRatio": named("MagnitudePercentageRatio", lambda n, d: f"magnitude_percentage_ratio_{_name(n, 100)}_{_name(d, 100)}", 2, lambda m, n, d: _ratio(_range(m, n), _range(m, d)), "mv", n=0.4, d=0.05),
        "MedianBufferRangePercentage": named("MedianBufferRangePercentage", percent("median_buffer_range_percentage"), 1, lambda m, q: (np.abs(m - np.median(m)) < q * (m.max() - m.min()) / 2).mean(), q=0.1),
        "PercentDifferenceMagnitudePercentile": named("PercentDifferenceMagnitudePercentile", percent("percent_difference_magnitude_percentile"), 1, lambda m, q: _ratio(_range(m, q), np.median(m)), q=0.05),
        "Periodogram": _spectrum,
    }


FEATURES = _make()


def feature(name: str, **parameters) -> Feature:
    return replace(FEATURES[name](**parameters), parameters=tuple(parameters.items()))


def register_feature(name: str, make: Callable[..., Feature]) -> None:
    """Adds a feature of one's own."""
    FEATURES[name] = make


def lacks(f: Feature, m: np.ndarray) -> str | None:
    """Why a series can't have the feature: short or flat."""
    if len(m) < f.least:
        return "short"
    return "flat" if "v" in f.needs and not (m != m[0]).any() else None


def evaluate(f: Feature, t: np.ndarray, m: np.ndarray, w: np.ndarray) -> list:
    """The feature's values; null where the series can't have them."""
    gone: list = [None] * len(f.columns)
    if lacks(f, m):
        return gone
    try:
        found = list(f.kernel(t, m, w))
    except (ArithmeticError, np.linalg.LinAlgError, ValueError):
        return gone
    return [v if v is not None and np.isfinite(v) else None for v in found]


def _strict(wanted: list[Feature], values: list, m: np.ndarray) -> tuple[list, str | None]:
    """All values or none, and what failed. Length and variability are checked for all features at once."""
    least, flat = max((f.least for f in wanted), default=0), any("v" in f.needs for f in wanted)
    error = "short" if len(m) < least else "flat" if flat and len(m) and not (m != m[0]).any() else None
    if error is None and any(v is None for v in values):
        error = "no value: " + [c for f in wanted for c in f.columns][[v is None for v in values].index(True)]
    return ([None] * len(values) if error else values), error


def series_of(batch: pa.RecordBatch, columns=("t", "m", "w")):
    """Views of the arrays of each row."""
    values, ends = [], []
    for c in columns:
        column = batch.column(c)
        values.append(column.values.to_numpy(zero_copy_only=False))
        ends.append(column.offsets.to_numpy())
    for i in range(batch.num_rows):
        yield tuple(v[e[i] : e[i + 1]] for v, e in zip(values, ends, strict=True))


def _kernels(df: DataFrame, wanted: list[Feature], keep: list[str], strict: bool, fill: float | None) -> DataFrame:
    wanted = unique_columns(wanted)
    columns = [c for f in wanted for c in f.columns]

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in columns]
            errors = []
            for a, b, c in series_of(batch):
                values = [v for f in wanted for v in evaluate(f, a, b, c)]
                if strict:
                    values, error = _strict(wanted, values, b)
                    errors.append(error)
                for column, v in zip(out, values, strict=True):
                    column.append(float(v) if v is not None else fill)
            more = [pa.array(errors, pa.string())] if strict else []
            yield pa.record_batch([*(batch.column(k) for k in keep), *(pa.array(c, pa.float64()) for c in out), *more], [*keep, *columns, *(["error"] if strict else [])])

    kept = df.select(*keep, *(c for c in "tmw" if c not in keep))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), *(f"`{c}` double" for c in columns), *(["error string"] if strict else [])])
    return kept.mapInArrow(run, schema)


def extract(packed: DataFrame, wanted: list[Feature], keys: tuple[str, ...] = ("series_id",), strict: bool = False, fill: float | None = None) -> DataFrame:
    """keys and the columns of all wanted features, in one Arrow pass over the packed rows; no exchange.

    A feature that a series can't have is fill (null). strict: then all features of that series are, and error says why.
    """
    return _kernels(packed, wanted, list(keys), strict, fill)


def binned(packed: DataFrame, window: float = 1.0, offset: float = 0.0) -> DataFrame:
    """The packed series after binning; features of it take the prefix of bins_prefix."""

    def run(batches):
        for batch in batches:
            rows = [bins(*s, window, offset) for s in series_of(batch)]
            ends = np.cumsum([0, *(len(r[0]) for r in rows)]).astype(np.int32)
            for i, c in enumerate("tmw"):
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0), *(r[i] for r in rows)])))
                batch = batch.set_column(batch.schema.get_field_index(c), c, made)
            yield batch

    return packed.mapInArrow(run, packed.schema)


def bins_prefix(window: float = 1.0, offset: float = 0.0) -> str:
    return f"bins_window{window:.1f}_offset{offset:.1f}_"
