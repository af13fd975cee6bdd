"""Features made of features: bins, bootstrap, transformed, spectra and folded series, curve fits; and declarations.

Importing this module adds them to FEATURES.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

from ..functions import fits
from .features import FEATURES, Feature, bins, bins_prefix, checked, evaluate, feature, periodogram, quantile, register_feature, top_peaks


def needs_of(wanted: tuple[Feature, ...]) -> str:
    return "".join(sorted(set("".join(f.needs for f in wanted))))


def columns_of(wanted: tuple[Feature, ...]) -> tuple[str, ...]:
    return tuple(c for f in wanted for c in f.columns)


def evaluate_all(wanted: tuple[Feature, ...], t, m, w) -> list:
    return [v for f in wanted for v in evaluate(f, t, m, w)]


def binned_features(features=(), window: float = 1.0, offset: float = 0.0) -> Feature:
    """features of the binned series."""
    features = tuple(features)
    prefix = bins_prefix(window, offset)
    return Feature("Bins", tuple(prefix + c for c in columns_of(features)), 1, lambda t, m, w: evaluate_all(features, *bins(t, m, w, window, offset)), "".join(sorted(set(needs_of(features).replace("v", "") + "tmws"))))


def resampled_columns(columns: tuple[str, ...], quantiles=None) -> tuple[str, ...]:
    kinds = ["sigma"] if quantiles is None else [f"quantile_{q * 100:.0f}" for q in quantiles]
    return tuple(f"bootstrap_{c}{k}" for c in columns for k in ("", *("_" + x for x in kinds)))


def resampled_values(value: list, draws: np.ndarray, quantiles=None) -> list:
    """Each value with its standard deviation or quantiles over the rows of draws."""
    out = []
    for v, d in zip(value, draws.T, strict=True):
        out += [v, d.std(ddof=1)] if quantiles is None else [v, *(quantile(d, q) for q in quantiles)]
    return out


#: Values of many resamples at once.
_ROWS: dict[str, Callable] = {
    "Amplitude": lambda m: (m.max(1) - m.min(1)) / 2,
    "Mean": lambda m: m.mean(1),
    "Median": lambda m: np.median(m, 1),
    "ObservationCount": lambda m: np.full(len(m), float(m.shape[1])),
    "StandardDeviation": lambda m: m.std(1, ddof=1),
}


def bootstrap(features=(), n: int = 100, seed: int = 0, quantiles=None) -> Feature:
    """features, and how they spread over n resamples with replacement; null as a whole if one of them can't be had.

    Features that need an order or variability are refused.
    """
    features = tuple(features)
    for f in features:
        if set("sv") & set(f.needs):
            raise ValueError(f"{f.name} can't be resampled")
    columns = resampled_columns(columns_of(features), quantiles)

    def run(t, m, w):
        where, value = np.random.default_rng(seed).integers(0, len(m), (n, len(m))), evaluate_all(features, t, m, w)
        if all(f.plain and f.name in _ROWS for f in features):
            if any(v is None for v in value):
                return [None] * len(columns)
            return resampled_values(value, np.stack([_ROWS[f.name](m[where]) for f in features], 1), quantiles)
        draws = [evaluate_all(features, t[at], m[at], w[at]) for at in where]
        if any(v is None for row in [value, *draws] for v in row):
            return [None] * len(columns)
        return resampled_values(value, np.array(draws, float).reshape(n, -1), quantiles)

    return Feature("Bootstrap", columns, max([1, *(f.least for f in features)]), run, needs_of(features))


_TRANSFORMS: dict[str, Callable] = {"arcsinh": np.arcsinh, "ln1p": np.log1p, "lg": np.log10, "sqrt": np.sqrt, "identity": lambda x: x, "clipped_lg": lambda x: np.log10(np.maximum(x, np.finfo(float).tiny))}


#: Curve fits: the columns of their transformer, and how many values it takes.
_FITS = {
    "bazin_fit": (("bazin_fit_mag_full_amplitude", "bazin_fit_baseline_amplitude_ratio", "bazin_fit_rise_time", "bazin_fit_fall_time", "ln1p_bazin_fit_reduced_chi2"), 6),
    "linexp_fit": (("linexp_fit_amplitude", "linexp_fit_fall_time", "linexp_fit_baseline", "ln1p_linexp_fit_reduced_chi2"), 5),
    "villar_fit": (("villar_fit_mag_full_amplitude", "villar_fit_baseline_amplitude_ratio", "villar_fit_rise_time", "villar_fit_fall_time", "villar_fit_plateau_rel_amplitude", "villar_fit_plateau_duration", "ln1p_villar_fit_reduced_chi2"), 8),
}


def _fit_values(kind: str, v: list[float], zero_point: float) -> list[float]:
    """Magnitude of the full amplitude, baseline over amplitude, times, ln(1 + reduced chi-square)."""
    magnitude, chi2 = zero_point - 2.5 * np.log10(2 * v[0]), np.log1p(v[-1])
    if kind == "linexp_fit":
        return [magnitude, v[2], v[3] / v[0], chi2]
    return [magnitude, v[1] / v[0], *v[3:-1], chi2]


def _part(kind: str, columns: tuple[str, ...], zero_point: float) -> tuple[tuple[str, ...], Callable[[list], list]]:
    """Names and values of a transformer over these columns; refuses a number of them that it can't take."""
    if kind in _FITS:
        names, size = _FITS[kind]
        if len(columns) != size:
            raise ValueError(f"{kind} takes {size} values, not {len(columns)}")
        return names, lambda v: [None] * len(names) if None in v else _fit_values(kind, v, zero_point)
    change = _TRANSFORMS[kind]
    return tuple(c if kind == "identity" else f"{kind}_{c}" for c in columns), lambda v: [None if x is None else change(x) for x in v]


def transformed(of: Feature | None = None, kind="arcsinh", zero_point: float = 8.9) -> Feature:
    """of with its values transformed; nulls stay nulls.

    kind: a name, or for several side by side a list of (name, how many values it takes) that takes all.
    """
    of = of or feature("Mean")
    sizes = [(kind, len(of.columns))] if isinstance(kind, str) else [(k, n) for k, n in kind]
    if sum(n for _, n in sizes) != len(of.columns) or any(n < 1 for _, n in sizes):
        raise ValueError(f"{of.name} has {len(of.columns)} values")
    ends = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    parts = [_part(k, of.columns[a:b], zero_point) for (k, _), a, b in zip(sizes, ends, ends[1:], strict=False)]

    def run(t, m, w):
        values = list(of.kernel(t, m, w))
        with np.errstate(all="ignore"):
            return [x for (_, change), a, b in zip(parts, ends, ends[1:], strict=False) for x in change(values[a:b])]

    return Feature("Transformed", tuple(c for names, _ in parts for c in names), of.least, run, of.needs)


def fold(wanted: tuple[Feature, ...], period: float, t, m, w):
    """The series over phases, 0 at its first minimum; in order of phase or time, as the features need."""
    needs = needs_of(wanted)
    if not set("ts") & set(needs):
        return t, m, w
    phase = np.mod(t / period, 1.0)
    phase = np.mod(phase - phase[np.argmin(m)], 1.0)
    if "s" in needs:
        order = np.argsort(phase, kind="stable")
        phase, m, w = phase[order], m[order], w[order]
    if "t" in needs and len(phase) > 1 and np.diff(phase).min() < 1e-6:
        return bins(phase, m, w, 1e-6, 0.0)
    return phase, m, w


def of_spectrum(spectrum: tuple[Feature, ...], freq, power) -> list:
    return evaluate_all(spectrum, freq, power, np.ones(len(freq)))


def of_phases(phase: tuple[Feature, ...], period: float, t, m, w) -> list:
    if not period > 0:
        return [None] * len(columns_of(phase))
    return evaluate_all(phase, *fold(phase, period, t, m, w))


def full_periodogram(peaks: int = 1, spectrum=(), phase=(), **options) -> Feature:
    """Peaks, features of the spectrum and features of the series folded at the best period."""
    spectrum, phase, options = tuple(spectrum), tuple(phase), checked(options)
    columns = [f"periodogram_{kind}_{i}" for i in range(peaks) for kind in ("period", "period_s_to_n")]
    columns += [f"periodogram_{c}" for c in columns_of(spectrum)] + [f"period_folded_{c}" for c in columns_of(phase)]

    def run(t, m, w):
        freq, power = periodogram(t, m, **options)
        found = top_peaks(freq, power, max(1, peaks))
        return found[: 2 * peaks] + of_spectrum(spectrum, freq, power) + of_phases(phase, found[0], t, m, w)

    return Feature("Periodogram", tuple(columns), 2, run, "".join(sorted(set("tms" + needs_of(phase)))))


def periodogram_peaks(peaks: int = 1) -> Feature:
    """Peaks of a series that is a spectrum itself."""
    return Feature("PeriodogramPeaks", tuple(f"{kind}_{i}" for i in range(peaks) for kind in ("period", "period_s_to_n")), 1, lambda t, m, w: top_peaks(t, m, peaks), "tms")


def _fit(name: str) -> Callable[..., Feature]:
    curve = fits.CURVES[name]

    def make(solver=None, prior=None, start=None) -> Feature:
        columns = tuple(f"{name}_fit_{c}" for c in (*curve.parameters, "reduced_chi2"))
        return Feature(f"{name.capitalize()}Fit", columns, len(curve.parameters) + 1, lambda t, m, w: fits.fit(name, t, m, w, solver, prior, start), "tmwsv")

    return make


for _name, _maker in (("Bins", binned_features), ("Bootstrap", bootstrap), ("Transformed", transformed), ("Periodogram", full_periodogram), ("PeriodogramPeaks", periodogram_peaks), ("BazinFit", _fit("bazin")), ("LinexpFit", _fit("linexp")), ("VillarFit", _fit("villar"))):
    register_feature(_name, _maker)


def declared(text: str) -> list[Feature]:
    """Features of a JSON list: names, or objects with feature, parameters and inner features under features, of, spectrum or phase."""

    def one(item) -> Feature:
        if isinstance(item, str):
            return feature(item)
        inner = {k: one(v) if k == "of" else [one(x) for x in v] if k in ("features", "spectrum", "phase") else v for k, v in item.items() if k != "feature"}
        if isinstance(inner.get("nyquist"), list):
            inner["nyquist"] = tuple(inner["nyquist"])
        if isinstance(inner.get("kind"), list):
            inner["kind"] = [tuple(x) for x in inner["kind"]]
        return feature(item["feature"], **inner)

    return [one(item) for item in json.loads(text)]


def declaration(wanted: list[Feature]) -> str:
    """JSON that declared() reads back."""

    def plain(v):
        if isinstance(v, Feature):
            return one(v)
        if isinstance(v, np.ndarray):
            return v.tolist()
        return [plain(x) for x in v] if isinstance(v, list | tuple) else v

    def one(f: Feature):
        return {"feature": f.name} | {k: plain(v) for k, v in f.parameters} if f.parameters else f.name

    return json.dumps([one(f) for f in wanted])
