"""Features over several bands in one extractor: one exchange by series, one Arrow pass.

A kernel takes a series as a dict of bands, each (t, m, w) in time order. A feature is null as a whole where a band it
needs is missing, too short or flat. The plainest ones also have native forms in multiband.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from .features import Feature, bins, bins_prefix, checked, evaluate, series_of, top_peaks, unique_columns
from .meta import columns_of, of_phases, of_spectrum, resampled_columns, resampled_values

Series = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class BandFeature:
    name: str
    columns: tuple[str, ...]
    bands: tuple[str, ...] | None  # None: any
    kernel: Callable[[Series], list]
    least: int = 1


def evaluate_bands(f: BandFeature, series: Series) -> list:
    gone = [None] * len(f.columns)
    if any(b not in series or len(series[b][0]) < f.least for b in f.bands or ()):
        return gone
    try:
        return list(f.kernel(series))
    except (ArithmeticError, np.linalg.LinAlgError, ValueError):
        return gone


def per_band(feature: Feature, bands) -> BandFeature:
    """The feature of each band, in the order given; null only for a band that can't have it."""
    empty = (np.zeros(0),) * 3
    return BandFeature("PerBandFeature", tuple(f"{c}_{b}" for b in bands for c in feature.columns), None, lambda s: [v for b in bands for v in (evaluate(feature, *s[b]) if b in s else evaluate(feature, *empty) if not feature.least else [None] * len(feature.columns))])


def color(kind: str, bands) -> BandFeature:
    """Difference of two bands' max, min or median."""
    a, b = bands
    of = {"max": np.max, "min": np.min, "median": np.median}[kind]
    return BandFeature(f"ColorOf{kind}", (f"color_{kind}_{a}_{b}",), (a, b), lambda s: [of(s[a][1]) - of(s[b][1])])


def color_spread(bands) -> BandFeature:
    bands = tuple(bands)
    mean = lambda m, w: (w * m).sum() / w.sum()
    return BandFeature("ColorSpread", ("color_spread",), bands, lambda s: [np.std([mean(*s[b][1:]) for b in bands])])


def multi_periodogram(bands, peaks: int = 1, weights: str = "count", spectrum=(), phase=(), phase_bands=None, **options) -> BandFeature:
    """Peaks of the weighted sum of the bands' powers on the grid of all their times, features of it, and of bands folded.

    weights: count (of points) or chi2. Bands of one point add nothing. Bands are folded each at its own minimum.
    """
    bands, spectrum, phase, options = tuple(bands), tuple(spectrum), tuple(phase), checked(options)
    phase_bands = tuple(phase_bands or (bands if phase else ()))
    columns = [f"multicolor_periodogram_{kind}_{i}" for i in range(peaks) for kind in ("period", "period_s_to_n")]
    columns += [f"multicolor_periodogram_{c}" for c in columns_of(spectrum)] + [f"period_folded_{b}_{c}" for b in phase_bands for c in columns_of(phase)]
    fft, normalization = options.get("fft", True), options.get("normalization", "psd")

    def weight(t, m, w):
        return len(t) if weights == "count" else (w * (m - (w * m).sum() / w.sum()) ** 2).sum()

    def run(s: Series):
        times = np.sort(np.concatenate([s[b][0] for b in bands]))
        freq = options.get("freq")
        if freq is None:
            freq = kernels.grid(times, options.get("resolution", 10), options.get("factor", 1), options.get("nyquist", "average"), fft)
        freq = np.asarray(freq, float)
        share = np.array([weight(*s[b]) for b in bands], float)
        used = [b for b in bands if len(s[b][0]) > 1]
        if not share.sum() or not used:
            return [None] * len(columns)
        share = dict(zip(bands, share / share.sum(), strict=True))
        way = kernels.power_fft if fft else kernels.power_direct
        power = sum(share[b] * kernels.normalized(way(s[b][0], s[b][1], freq), len(s[b][0]), normalization) for b in used)
        found = top_peaks(freq, power, max(1, peaks))
        folded = [v for b in phase_bands for v in (of_phases(phase, found[0], *s[b]) if b in s else [None] * len(columns_of(phase)))]
        return found[: 2 * peaks] + of_spectrum(spectrum, freq, power) + folded

    return BandFeature("MultiColorPeriodogram", tuple(columns), bands, run)


def multi_bins(features, window: float = 1.0, offset: float = 0.0, strict: bool = False) -> BandFeature:
    """Features over bands that are binned each; strict: all or none of them."""
    features = tuple(features)
    prefix = bins_prefix(window, offset)

    def run(s: Series):
        binned = {b: bins(*x, window, offset) for b, x in s.items()}
        values = [v for f in features for v in evaluate_bands(f, binned)]
        return [None] * len(values) if strict and any(v is None for v in values) else values

    return BandFeature("MultiColorBins", tuple(prefix + c for f in features for c in f.columns), None, run)


def multi_bootstrap(features, n: int = 100, seed: int = 0, quantiles=None, scheme: str = "stratified", attempts: int = 10) -> BandFeature:
    """Features over bands and their spread over n resamples.

    stratified: each band by itself. rejection: all points together; resamples without a value are drawn again, up to
    attempts * n draws, and two good ones are needed.
    """
    features = tuple(features)
    inner = tuple(c for f in features for c in f.columns)
    columns = resampled_columns(inner, quantiles)

    def values(s):
        return [v for f in features for v in evaluate_bands(f, s)]

    def good(v):
        return all(x is not None and np.isfinite(x) for x in v)

    def run(s: Series):
        rng, draws, value = np.random.default_rng(seed), [], values(s)
        names = sorted(s)
        label = np.repeat(np.arange(len(names)), [len(s[b][0]) for b in names])
        joint = tuple(np.concatenate([s[b][i] for b in names]) for i in range(3))
        for _ in range(n if scheme == "stratified" else n * attempts):
            if scheme == "stratified":
                at = {b: np.sort(rng.integers(0, len(x[0]), len(x[0]))) for b, x in s.items()}
                drawn = {b: tuple(c[at[b]] for c in x) for b, x in s.items()}
            else:
                at = np.sort(rng.integers(0, len(label), len(label)))
                drawn = {b: tuple(c[at[label[at] == i]] for c in joint) for i, b in enumerate(names) if (label[at] == i).any()}
            got = values(drawn)
            if good(got):
                draws.append(got)
            elif scheme == "stratified":
                return [None] * len(columns)
            if len(draws) == n:
                break
        if not good(value) or len(draws) < 2:
            return [None] * len(columns)
        return resampled_values(value, np.array(draws, float).reshape(len(draws), -1), quantiles)

    return BandFeature("MultiColorBootstrap", columns, None, run)


def pack_bands(long: DataFrame) -> DataFrame:
    """One row per series: arrays band, t, m, w in time order. One exchange."""
    row = F.array_sort(F.collect_list(F.struct("t", "ord", "band", "m", "w"))).alias("p")
    return long.groupBy("series_id").agg(row).select("series_id", *(F.col(f"p.{c}").alias(c) for c in ("band", "t", "m", "w")))


def failure(f: BandFeature, series: Series, values: list) -> str | None:
    """Why a series can't have the feature over bands."""
    for b in f.bands or ():
        if b not in series:
            return f"no band {b}"
        if len(series[b][0]) < f.least:
            return f"short in band {b}"
    missing = [c for c, v in zip(f.columns, values, strict=True) if v is None or not np.isfinite(v)]
    return f"no value: {missing[0]}" if missing else None


def extract_bands(long: DataFrame, wanted: list[BandFeature], strict: bool = False, fill: float | None = None) -> DataFrame:
    """series_id and the columns of all wanted features over bands; those that a series can't have are fill (null).

    strict: then all of that series are null, and error says what failed first.
    """
    wanted = unique_columns(wanted)
    columns = [c for f in wanted for c in f.columns]
    packed = pack_bands(long)

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in columns]
            errors: list[str | None] = []
            band = batch.column("band")
            label = band.values.dictionary_encode()
            names, label, ends = label.dictionary.to_pylist(), label.indices.to_numpy(zero_copy_only=False), band.offsets.to_numpy()
            for i, points in enumerate(series_of(batch)):
                at = label[ends[i] : ends[i + 1]]
                series = {names[k]: tuple(x[at == k] for x in points) for k in sorted(set(at.tolist()), key=names.__getitem__)}
                values = [evaluate_bands(f, series) for f in wanted]
                error = next(filter(None, (failure(f, series, v) for f, v in zip(wanted, values, strict=True))), None) if strict else None
                errors.append(error)
                for column, v in zip(out, [v for found in values for v in found], strict=True):
                    column.append(fill if error or v is None or not np.isfinite(v) else float(v))
            more = [pa.array(errors, pa.string())] if strict else []
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.float64()) for c in out), *more], ["series_id", *columns, *(["error"] if strict else [])])

    schema = ", ".join([f"series_id {packed.schema['series_id'].dataType.simpleString()}", *(f"`{c}` double" for c in columns), *(["error string"] if strict else [])])
    return packed.mapInArrow(run, schema)
