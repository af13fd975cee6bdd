"""The registered queries of the feature engine and their SQL.

Both sides round to six digits after the point. Series are the users of events.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fits, kernels, transformers
from ..operators import bands, multiband
from ..operators import features as O
from ..operators.native import binned_long, extract_long, extremes, is_native
from ..sources import series

_E = """e as (select user_id series_id, event_type band, epoch_us(ts) / 86400000000.0 t, value::double m, 1 / power(0.1 * value::double + 1, 2) w, event_id ord from events where value is not null and ts is not null),
s as (select series_id, count(*) n, avg(m) mu, stddev_samp(m) sd, var_samp(m) var, median(m) med, mad(m) mad, min(m) lo, max(m) hi, sum(w*m)/sum(w) wm, list_sort(list(m)) o, avg(t) tm from e group by 1),
d as (select series_id, m, t, lag(m) over (partition by series_id order by t, ord) pm, lag(t) over (partition by series_id order by t, ord) pt from e)"""


def _sql(columns: dict[str, str], source: str = "s") -> str:
    return f"with {_E} select series_id, {', '.join(f'round({e}, 6) "{c}"' for c, e in columns.items())} from {source}"


def _q(q: str) -> str:
    h = f"(n::float * ({q})::float - 0.5::float)"
    i = f"floor({h})::int"
    return f"(case when {h} < 0 then o[1] when {i} >= n - 1 then o[n] else o[{i} + 1] + ({h}::double - {i}) * (o[{i} + 2] - o[{i} + 1]) end)"


def _range(q: float) -> str:
    return f"({_q(f'1::float - {q}::float')} - {_q(str(q))})"


_POINTS = "(select e.*, n, mu, sd, med, wm, lo, hi, tm, mad from e join s using (series_id)) group by series_id"
_W = "(select e.*, sum(m - mu) over (partition by e.series_id order by t, ord) c, n, sd from e join s using (series_id)) group by series_id"


def _line(known: bool) -> str:
    w = "w" if known else "1.0"
    names = ("linear_fit_slope", "linear_fit_slope_sigma", "linear_fit_reduced_chi2") if known else ("linear_trend", "linear_trend_sigma", "linear_trend_noise")
    values = ("sxy/sxx", "sqrt(1/sxx)", "chi2") if known else ("sxy/sxx", "sqrt(chi2/sxx)", "sqrt(chi2)")
    return f"""with {_E}, x as (select series_id, t, m, {w} w from e), c as (select series_id, sum(w*t)/sum(w) ct, sum(w*m)/sum(w) cm, count(*) n from x group by 1),
k as (select series_id, any_value(n) n, any_value(ct) ct, any_value(cm) cm, sum(w*(t-ct)^2) sxx, sum(w*(t-ct)*(m-cm)) sxy from x join c using (series_id) group by 1),
r as (select series_id, any_value(sxx) sxx, any_value(sxy) sxy, sum(w*(m-cm-sxy/sxx*(t-ct))^2)/(any_value(n)-2) chi2 from x join k using (series_id) group by 1)
select series_id, {', '.join(f'round({v}, 6) {n}' for n, v in zip(names, values, strict=True))} from r"""


#: Query: features with parameters, and SQL.
FEATURES: dict[str, tuple[list[O.Feature], str | None]] = {}


def _add(name: str, wanted: list[O.Feature], sql: str | None) -> None:
    FEATURES[name] = wanted, sql


def _one(name: str, expression: str, source: str = "s", **parameters) -> None:
    f = O.feature(name, **parameters)
    snake = "".join("_" + c.lower() if c.isupper() else c for c in name).lstrip("_")
    _add(f"feature_{snake}", [f], _sql({f.columns[0]: expression}, source))


_one("Amplitude", "(hi - lo) / 2")
_one("BeyondNStd", "avg((abs(m - mu) > sd)::int)", _POINTS)
_one("Cusum", "(max(c) - min(c)) / (any_value(sd) * any_value(n))", _W)
_one("Duration", "max(t) - min(t)", _POINTS)
_one("Eta", "sum((m - pm)^2) / (count(*) - 1) / var_samp(m)", "d group by series_id")
_one("ExcessVariance", "(var_samp(m) - avg(1 / w)) / avg(m)^2", _POINTS)
_one("InterPercentileRange", _range(0.25))
_one("Kurtosis", "kurtosis(m)", _POINTS)
_one("LaflerKinmanStringLength", "(sum((m - pm)^2) + (arg_min(m, t) - arg_max(m, t))^2) / (2 * (count(*) - 1) * var_samp(m))", "d group by series_id")
_one("MagnitudePercentageRatio", f"{_range(0.4)} / {_range(0.05)}")
_one("MaximumTimeInterval", "max(t - pt)", "d group by series_id")
_one("MinimumTimeInterval", "min(t - pt)", "d group by series_id")
_one("Mean", "mu")
_one("MeanVariance", "sd / mu")
_one("Median", "med")
_one("MedianAbsoluteDeviation", "mad")
_one("MedianBufferRangePercentage", "avg((abs(m - med) < 0.1 * (hi - lo) / 2)::int)", _POINTS)
_one("ObservationCount", "n::double")
_one("PercentAmplitude", "greatest(hi - med, med - lo)")
_one("PercentDifferenceMagnitudePercentile", f"{_range(0.05)} / med")
_one("ReducedChi2", "sum(w * (m - wm)^2) / (count(*) - 1)", _POINTS)
_one("Roms", "sum(abs(m - med) * sqrt(w)) / (count(*) - 1)", _POINTS)
_one("Skew", "skewness(m)", _POINTS)
_one("StandardDeviation", "sd")
_one("StetsonK", "sum(abs(m - wm) * sqrt(w)) / sqrt(count(*) * sum(w * (m - wm)^2))", _POINTS)
_one("TimeMean", "tm")
_one("TimeStandardDeviation", "stddev_samp(t)", _POINTS)
_one("WeightedMean", "wm")
_add("feature_eta_e", [O.feature("EtaE")], f"with {_E} select series_id, round(ln(1 + (max(t) - min(t))^2 * sum(((m - pm) / nullif(t - pt, 0))^2) / var_samp(m) / (count(*) - 1)^3), 6) eta_e from d group by 1")
_add("feature_maximum_slope", [O.feature("MaximumSlope")], f"with {_E} select series_id, round(ln(1 + max(abs((m - pm) / nullif(t - pt, 0)))), 6) maximum_slope from d group by 1")
_add("feature_biweight_scale", [O.feature("BiweightScale")], f"with {_E}, u as (select series_id, n, (m - med)^2 d2, ((m - med) / (9 * mad))^2 u2 from e join s using (series_id)) select series_id, round(sqrt(any_value(n) * sum(d2 * (1 - u2)^4)) / abs(sum((1 - u2) * (1 - 5 * u2))), 6) biweight_scale_9 from u where u2 < 1 group by 1")
_add("feature_linear_fit", [O.feature("LinearFit")], _line(True))
_add("feature_linear_trend", [O.feature("LinearTrend")], _line(False))
_add("feature_qn_scale", [O.feature("QnScale")], f"with {_E}, p as (select a.series_id, abs(a.m - b.m) x, row_number() over (partition by a.series_id order by abs(a.m - b.m)) r from e a join e b on a.series_id = b.series_id and a.ord < b.ord) select series_id, round(2.219144465985076 * x, 6) qn from p join s using (series_id) where r = (n // 2 + 1) * (n // 2) // 2")
_add(
    "feature_otsu_split",
    [O.feature("OtsuSplit")],
    f"""with {_E}, k as (select series_id, m, row_number() over v k, sum(m) over v c, count(*) over (partition by series_id) n, sum(m) over (partition by series_id) z from e window v as (partition by series_id order by m rows unbounded preceding)),
b as (select series_id, arg_max(k, (k / n * (1 - k / n) * (c / k - (z - c) / (n - k))^2, -k)) b from k where k < n group by 1)
select series_id, round(avg(m) filter (where k > b) - avg(m) filter (where k <= b), 6) otsu_mean_diff, round(coalesce(stddev_samp(m) filter (where k <= b), 0), 6) otsu_std_lower, round(coalesce(stddev_samp(m) filter (where k > b), 0), 6) otsu_std_upper, round(any_value(b) / any_value(n), 6) otsu_lower_to_all_ratio from k join b using (series_id) group by 1""",
)
_add(
    "feature_chi2_pvar",
    [O.feature("Chi2Pvar")],
    f"""with {_E}, x as (select series_id, any_value(n)::int - 1 k, sum(w * (m - wm)^2) / 2 x from {_POINTS}),
p as (select series_id, case when k % 2 = 0 then list_sum(list_transform(range(0, k // 2), lambda i: exp(i * ln(x) - lgamma(i + 1) - x)))
else list_sum(list_transform(range(0, (k - 1) // 2), lambda i: exp((i + 0.5) * ln(x) - lgamma(i + 1.5) - x))) end p from x)
select series_id, case when p > 0 then round(ln(p), 6) end chi2_pvar from p""",
)
_add(
    "feature_parabola_fit",
    [O.feature("ParabolaFit")],
    f"""with {_E}, c as (select series_id, sum(w*t)/sum(w) ct, sum(w*m)/sum(w) cm, count(*) n from e group by 1),
x as (select series_id, t - ct x, m - cm y, w, cm, n from e join c using (series_id)),
k as (select series_id, any_value(cm) cm, any_value(n) n, sum(w) s0, sum(w*x^2) s2, sum(w*x^3) s3, sum(w*x^4) s4, sum(w*x*y) b1, sum(w*x^2*y) b2 from x group by 1),
g as (select *, (b2*s2*s0 - s3*b1*s0) / (s4*s2*s0 - s3*s3*s0 - s2*s2*s2) g from k),
a as (select *, (b1 - s3*g) / s2 b, -s2*g / s0 c from g),
r as (select a.series_id, any_value(g) g, any_value(c + a.cm - b*b/(4*g)) m0, sum(x.w*(y - g*x^2 - b*x - c)^2) / (any_value(a.n) - 3) chi2 from x join a using (series_id) group by 1)
select series_id, round(g, 6) parabola_fit_g, round(m0, 6) parabola_fit_m0, round(chi2, 6) parabola_fit_reduced_chi2 from r""",
)
for _name, _parameters in (("AndersonDarlingNormal", {}), ("Periodogram", {"peaks": 2})):
    _add("feature_" + "".join("_" + c.lower() if c.isupper() else c for c in _name).lstrip("_"), [O.feature(_name, **_parameters)], None)
_AVERAGE = "pi() * (n - 1) / (t1 - t0)"
_GAPS = "y as (select series_id, count(*) n, list_sort(list(t - pt)) o, median(t - pt) gap from d where pt is not null group by 1)"
_POWERS = {"psd": "power", "standard": "power * 2 / (n - 1)", "model": "(power * 2 / (n - 1)) / (1 - power * 2 / (n - 1))", "log": "-ln(1 - power * 2 / (n - 1))"}


def _spectrum(top: str = _AVERAGE, kind: str = "psd", grid: str | None = None) -> str:
    """Common table expressions: peaks r (ok: a peak, rank r; pm, psd: mean and deviation of all powers) of the classical power."""
    dynamic = f"g as (select b.*, gap, 2*pi()*(n-1)/(n*10.0*(t1-t0)) step, 4*pi()/(t1-t0) start, {top} top from b join (select series_id, gap, {_q('0.3')} low from y) y using (series_id)), h as (select *, unnest(range(greatest(1, round((top - start) / step)::bigint))) i from g), f as (select *, start + step * i freq from h)"
    return f"""{_E}, {_GAPS}, b as (select series_id, count(*) n, min(t) t0, max(t) t1, avg(m) mu, var_samp(m) var from e group by 1),
{grid or dynamic},
a as (select series_id, i, any_value(freq) freq, any_value(n) n, any_value(mu) mu, any_value(var) var, atan2(sum(sin(2 * freq * t)), sum(cos(2 * freq * t))) / 2 tau from f join e using (series_id) group by 1, 2),
c as (select series_id, i, any_value(freq) freq, any_value(n) n, any_value(var) var, sum((m - mu) * sin(freq * t - tau)) ms, sum((m - mu) * cos(freq * t - tau)) mc, sum(sin(freq * t - tau)^2) ss from a join e using (series_id) group by 1, 2),
p as (select series_id, i, freq, n, (ms^2 / ss + mc^2 / (n - ss)) / (2 * var) power from c),
u as (select series_id, i, freq, {_POWERS[kind]} power from p),
k as (select *, avg(power) over z pm, stddev_samp(power) over z psd, coalesce(power > lag(power) over v and power >= lead(power) over v, false) ok from u window v as (partition by series_id order by i), z as (partition by series_id)),
r as (select *, row_number() over (partition by series_id, ok order by power desc, i) r from k)"""


def _peaks(peaks: int, more: str = "") -> str:
    columns = [f"round(coalesce(max({v}) filter (ok and r = {i + 1}), 0), 6) periodogram_{n}_{i}" for i in range(peaks) for n, v in (("period", "2 * pi() / freq"), ("period_s_to_n", "(power - pm) / psd"))]
    return f"select series_id, {', '.join(columns)}{more} from r group by 1"


_add("feature_periodogram_direct", [O.feature("Periodogram", peaks=2, fft=False)], f"with {_spectrum()} {_peaks(2)}")
for _name, _kind, _top in (("median", "median", "pi() / gap"), ("quantile", ("quantile", 0.3), "pi() / low"), ("fixed", ("fixed", 3.0), "3.0"), ("dt", ("dt", 1.5), "pi() / 1.5")):
    _add(f"periodogram_nyquist_{_name}", [O.feature("Periodogram", fft=False, nyquist=_kind)], f"with {_spectrum(_top)} {_peaks(1)}")
for _kind in ("standard", "model", "log"):
    _of = [O.feature("Mean"), O.feature("StandardDeviation")]
    _more = ", round(any_value(pm), 6) periodogram_mean, round(any_value(psd), 6) periodogram_standard_deviation"
    _add(f"periodogram_normalized_{_kind}", [O.feature("Periodogram", fft=False, normalization=_kind, spectrum=_of)], f"with {_spectrum(kind=_kind)} {_peaks(1, _more)}")
_add("periodogram_factor", [O.feature("Periodogram", fft=False, factor=0.5)], f"with {_spectrum(_AVERAGE + ' * 0.5')} {_peaks(1)}")
_add(
    "periodogram_linear_grid",
    [O.feature("Periodogram", peaks=2, fft=False, freq=kernels.linear_grid(0.05, 0.01, 200))],
    f"with {_spectrum(grid='f as (select *, 0.05::double + 0.01::double * i freq from (select *, unnest(range(200)) i from b))')} {_peaks(2)}",
)
_add(
    "periodogram_own_grid",
    [O.feature("Periodogram", fft=False, freq=kernels.arbitrary_grid([0.3 * i * i + 0.1 for i in range(30, -1, -1)], sort=True))],
    f"with {_spectrum(grid='f as (select *, 0.3::double * i * i + 0.1::double freq from (select *, unnest(range(31)) i from b))')} {_peaks(1)}",
)
_add(
    "periodogram_folded",
    [O.feature("Periodogram", fft=False, phase=[O.feature("Eta"), O.feature("Amplitude")])],
    f"""with {_spectrum()}, w0 as ({_peaks(1)}), x0 as (select series_id, max(2 * pi() / freq) filter (ok and r = 1) period from r group by 1),
x1 as (select e.series_id, m, t, ord, t / period - floor(t / period) phase from e join x0 using (series_id)),
x2 as (select series_id, first(phase order by m, t, ord) zero from x1 group by 1),
x3 as (select series_id, m, t, ord, phase - zero - floor(phase - zero) phase from x1 join x2 using (series_id)),
x4 as (select series_id, m, lag(m) over (partition by series_id order by phase, t, ord) pm from x3),
x5 as (select series_id, round(sum((m - pm)^2) / ((count(*) - 1) * var_samp(m)), 6) period_folded_eta, round((max(m) - min(m)) / 2, 6) period_folded_amplitude from x4 group by 1)
select * from w0 join x5 using (series_id)""",
)
for _name in ("BazinFit", "LinexpFit", "VillarFit"):
    _add("feature_" + _name.removesuffix("Fit").lower() + "_fit", [O.feature(_name, solver=fits.LevenbergMarquardt(20, bounded=True))], None)
_add("feature_bootstrap", [O.feature("Bootstrap", features=[O.feature("Mean"), O.feature("Median")])], None)
_add("feature_periodogram_meta", [O.feature("Periodogram", spectrum=[O.feature("Skew"), O.feature("StandardDeviation")], phase=[O.feature("Eta"), O.feature("Amplitude")])], None)
_add("feature_transformed", [O.feature("Transformed", of=O.feature("StandardDeviation"), kind="lg")], _sql({"lg_standard_deviation": "log10(sd)"}))
_add(
    "feature_transformed_composed",
    [O.feature("Transformed", of=O.feature("LinearFit"), kind=[("arcsinh", 1), ("lg", 1), ("sqrt", 1)])],
    f"select series_id, round(asinh(linear_fit_slope), 6) arcsinh_linear_fit_slope, round(log10(linear_fit_slope_sigma), 6) lg_linear_fit_slope_sigma, round(sqrt(linear_fit_reduced_chi2), 6) sqrt_linear_fit_reduced_chi2 from ({_line(True).replace(', 6) linear', ', 15) linear')})",
)
#: Values that range widely are compared as ln(1 + x).
_LOG = ("eta_e", "maximum_slope")


def _compared(c: str):
    if c == "chi2_pvar":
        return F.when(F.col(c) > 0, F.round(F.log(c), 6)).alias(c)
    return F.round(F.log1p(c) if c in _LOG else F.col(c), 6).alias(c)


def _features(wanted: list[O.Feature]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = extract_long(series.events(spark, sf_dir), wanted)
        return df.select("series_id", *(_compared(c) for f in wanted for c in f.columns))

    return run


#: The flagship's features: all of the reproduced ones, whose names may clash.
ALL = [f for name, (wanted, _) in FEATURES.items() if name.startswith("feature_") for f in wanted]
NATIVE = {name: wanted[0] for name, (wanted, sql) in FEATURES.items() if sql and is_native(wanted[0])}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features in one extractor: one exchange, one projection, one Arrow pass."""
    return O.extract(series.pack(series.events(spark, sf_dir)), ALL)


def extractor_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features that have a native form in one aggregate."""
    return _features(list(NATIVE.values()))(spark, sf_dir)


_EXTRACTOR_NATIVE = "select * from " + " join ".join(f"({FEATURES[n][1]})" + (" using (series_id)" if i else "") for i, n in enumerate(NATIVE))


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [O.feature(n) for n in ("Mean", "StandardDeviation", "Amplitude", "ObservationCount")]
    df = extract_long(binned_long(series.events(spark, sf_dir), 7.0, 0.0), wanted)
    return df.select("series_id", *(F.round(c, 6).alias(O.bins_prefix(7.0) + c) for f in wanted for c in f.columns))


def bins_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [O.feature(n) for n in ("Mean", "StandardDeviation", "Amplitude", "ObservationCount")]
    df = O.extract(O.binned(series.pack(series.events(spark, sf_dir)), 7.0, 0.0), wanted)
    return df.select("series_id", *(F.round(c, 6).alias(O.bins_prefix(7.0) + c) for f in wanted for c in f.columns))


_BINS = f"""with {_E}, b as (select series_id, floor(t / 7) k, sum(w*m)/sum(w) m from e group by 1, 2)
select series_id, {', '.join(f'round({e}, 6) "{O.bins_prefix(7.0)}{c}"' for c, e in (("mean", "avg(m)"), ("standard_deviation", "stddev_samp(m)"), ("amplitude", "(max(m) - min(m)) / 2"), ("observation_count", "count(*)::double")))} from b group by 1"""


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiband.colors(series.events(spark, sf_dir), ["click", "view"])


def color_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiband.color_spread(series.events(spark, sf_dir), ["click", "view", "purchase"])


def per_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = multiband.per_band(series.events(spark, sf_dir), [O.feature("Mean"), O.feature("StandardDeviation")], ["view", "click"])
    return df.select("series_id", *(F.round(c, 6).alias(c) for c in df.columns[1:]))


def transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = extract_long(series.events(spark, sf_dir), [O.feature("Mean"), O.feature("Skew")])
    df = df.select("series_id", "mean", *transformers.apply("arcsinh", ["skew"]), *(c for k in ("ln1p", "lg", "sqrt", "clipped_lg", "identity") for c in transformers.apply(k, ["mean"]) if k != "identity"))
    return df.select("series_id", *(F.round(c, 6).alias(c) for c in df.columns[1:]))


_BANDS = ("click", "view")


def strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of each series; those of fewer than eight points have no features."""
    packed = series.pack(series.events(spark, sf_dir), "series_id", "band")
    wanted = [O.feature("Mean"), O.Feature("Long", (), 8, lambda t, m, w: [])]
    df = O.extract(packed, wanted, ("series_id", "band"), strict=True)
    return df.select("series_id", "band", F.round("mean", 6).alias("mean"), "error")


_STRICT = f"""with {_E} select series_id, band, case when count(*) >= 8 then round(avg(m), 6) end mean, case when count(*) < 8 then 'short' end error from e group by 1, 2"""


def _banded(*wanted: bands.BandFeature):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = bands.extract_bands(series.events(spark, sf_dir), list(wanted))
        return df.select("series_id", *(F.round(F.col(f"`{c}`"), 6).alias(c) for c in df.columns[1:]))

    return run


multi_extractor = _banded(*(bands.color(k, _BANDS) for k in ("max", "min", "median")), bands.color_spread(_BANDS), bands.per_band(O.feature("Mean"), _BANDS))
multi_bins = _banded(bands.multi_bins([bands.color(k, _BANDS) for k in ("max", "min", "median")], 7.0, 0.0))
multi_periodogram = _banded(bands.multi_periodogram(_BANDS, 2, "count"), bands.BandFeature("Chi2", ("chi2_period", "chi2_period_s_to_n"), _BANDS, bands.multi_periodogram(_BANDS, 1, "chi2", fft=False).kernel))
multi_bootstrap = _banded(bands.multi_bootstrap([bands.color("median", _BANDS)], scheme="rejection"))
_MULTI = f"""with {_E}, b as (select series_id, band, max(m) hi, min(m) lo, median(m) med, avg(m) mu, sum(w*m)/sum(w) wm from e where band in ('click', 'view') group by 1, 2),
j as (select series_id, c, v from (select distinct series_id from e) left join (select series_id, b c from b where band = 'click') using (series_id) left join (select series_id, b v from b where band = 'view') using (series_id))
select series_id, round(c.hi - v.hi, 6) color_max_click_view, round(c.lo - v.lo, 6) color_min_click_view, round(c.med - v.med, 6) color_median_click_view,
case when c.wm is not null and v.wm is not null then round(abs(c.wm - v.wm) / 2, 6) end color_spread, round(c.mu, 6) mean_click, round(v.mu, 6) mean_view from j"""
_MULTI_BINS = f"""with {_E}, k as (select series_id, band, floor(t / 7) k, sum(w*m)/sum(w) m from e group by 1, 2, 3),
b as (select series_id, max(m) filter (band = 'click') a, max(m) filter (band = 'view') b, min(m) filter (band = 'click') c, min(m) filter (band = 'view') d, median(m) filter (band = 'click') x, median(m) filter (band = 'view') y from k group by 1)
select series_id, round(a - b, 6) "{O.bins_prefix(7.0)}color_max_click_view", round(c - d, 6) "{O.bins_prefix(7.0)}color_min_click_view", round(x - y, 6) "{O.bins_prefix(7.0)}color_median_click_view" from b"""
_COLORS = f"""with {_E}, b as (select series_id, max(m) filter (band = 'click') a, max(m) filter (band = 'view') b, min(m) filter (band = 'click') c, min(m) filter (band = 'view') d, median(m) filter (band = 'click') x, median(m) filter (band = 'view') y from e group by 1)
select series_id, round(a - b, 6) color_max_click_view, round(c - d, 6) color_min_click_view, round(x - y, 6) color_median_click_view from b"""
_SPREAD = f"""with {_E}, b as (select series_id, band, sum(w*m)/sum(w) wm from e where band in ('click', 'view', 'purchase') group by 1, 2)
select series_id, case when count(*) = 3 then round(stddev_pop(wm), 6) end color_spread from b group by 1"""
_PER_BAND = f"""with {_E} select series_id, round(avg(m) filter (band = 'view'), 6) mean_view, round(avg(m) filter (band = 'click'), 6) mean_click,
round(stddev_samp(m) filter (band = 'view'), 6) standard_deviation_view, round(stddev_samp(m) filter (band = 'click'), 6) standard_deviation_click from e group by 1 having count(*) filter (band in ('view', 'click')) > 0"""
_TRANSFORMED = f"""with {_E} select series_id, round(avg(m), 6) mean, round(asinh(skewness(m)), 6) arcsinh_skew, round(ln(1 + avg(m)), 6) ln1p_mean, round(log10(avg(m)), 6) lg_mean, round(sqrt(avg(m)), 6) sqrt_mean, round(log10(avg(m)), 6) clipped_lg_mean from e group by 1"""




def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = extract_long(series.events(spark, sf_dir), [O.feature(n) for n in ("Mean", "StandardDeviation", "Skew")])
    df = df.select("series_id", *transformers.composed([("identity", ["mean"]), ("lg", ["standard_deviation"]), ("arcsinh", ["skew"])]))
    return df.select("series_id", *(F.round(c, 6).alias(c) for c in df.columns[1:]))


_COMPOSED = _sql({"mean": "avg(m)", "lg_standard_deviation": "log10(stddev_samp(m))", "arcsinh_skew": "asinh(skewness(m))"}, "e group by 1")


def fit_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transformers of curve fits, over columns made of other features."""
    made = {"amplitude": F.max("m"), "baseline": F.min("m"), "reference_time": F.avg("t"), "rise_time": F.stddev_samp("m"), "fall_time": F.median("m"), "plateau_rel_amplitude": F.avg("w"), "plateau_duration": F.max("w"), "reduced_chi2": F.avg("m")}
    df = series.events(spark, sf_dir).groupBy("series_id").agg(*(v.alias(f"{model}_fit_{c}") for model in fits.CURVES for c, v in made.items()))
    columns = [c for model in fits.CURVES for c in transformers.fit_magnitudes(model)]
    df = df.select("series_id", *columns)
    return df.select("series_id", *(F.round(c, 6).alias(c) for c in df.columns[1:]))


def _magnitude_columns() -> dict[str, str]:
    out = {}
    for model in ("bazin", "linexp", "villar"):
        head = ("linexp_fit_amplitude", "linexp_fit_baseline") if model == "linexp" else (f"{model}_fit_mag_full_amplitude", f"{model}_fit_baseline_amplitude_ratio")
        out |= {head[0]: "8.9 - 2.5 * log10(2 * max(m))", head[1]: "min(m) / max(m)", f"{model}_fit_fall_time": "median(m)", f"ln1p_{model}_fit_reduced_chi2": "ln(1 + avg(m))"}
        if model != "linexp":
            out[f"{model}_fit_rise_time"] = "stddev_samp(m)"
    return out | {"villar_fit_plateau_rel_amplitude": "avg(w)", "villar_fit_plateau_duration": "max(w)"}


_FIT_MAGNITUDES = _sql(_magnitude_columns(), "e group by 1")


def flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series.magnitude_to_flux(series.events(spark, sf_dir).withColumn("m", F.col("m") / 100))
    df = extract_long(df, [O.feature("Mean"), O.feature("WeightedMean"), O.feature("ReducedChi2")])
    return df.select("series_id", *(F.round(c, 6).alias(c) for c in df.columns[1:]))


_FLUX = f"""with {_E}, x as (select series_id, pow(10.0, -0.004 * m) m, w / pow(pow(10.0, -0.004 * m) * 0.4 * ln(10.0), 2) w from e), c as (select series_id, sum(w * m) / sum(w) wm from x group by 1)
select series_id, round(avg(m), 6) mean, round(any_value(wm), 6) weighted_mean, round(sum(w * (m - wm)^2) / (count(*) - 1), 6) chi2 from x join c using (series_id) group by 1"""


def unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series without weights: all are 1."""
    long = series.events(spark, sf_dir).select("series_id", "t", "m")
    df = extract_long(series.long_form(long, "series_id", F.col("t"), F.col("m")), [O.feature("WeightedMean"), O.feature("ReducedChi2")])
    return df.select("series_id", F.round("weighted_mean", 6).alias("weighted_mean"), F.round(F.log1p("chi2"), 6).alias("chi2"))


_UNWEIGHTED = _sql({"weighted_mean": "avg(m)", "chi2": "ln(1 + var_samp(m))"}, "e group by 1")


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands put together, and one of them put in place of another's points."""
    long = series.declare_bands(series.events(spark, sf_dir), ["click", "view", "purchase", "signup", "error"])
    two = series.from_bands({b: series.in_bands(long, [b]) for b in _BANDS})
    twice = series.in_bands(long, ["view"]).withColumn("m", 2 * F.col("m")).withColumn("band", F.lit("click"))
    df = multiband.per_band(series.upsert_band(two, twice), [O.feature("Mean")], list(_BANDS))
    return df.select("series_id", *(F.round(c, 6).alias(c) for c in df.columns[1:]))


_BANDED = f"""with {_E}, b as (select series_id, avg(m) filter (band = 'click') c, avg(m) filter (band = 'view') v from e where band in ('click', 'view') group by 1)
select series_id, round(coalesce(2 * v, c), 6) mean_click, round(v, 6) mean_view from b"""


def extreme_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = extremes(series.events(spark, sf_dir))
    return df.select("series_id", *(F.round(c, 6).alias(c) for c in ("t_min", "t_max", "signal_to_noise")), "plateau")


_EXTREMES = f"""with {_E} select series_id, round(first(t order by m, t, ord), 6) t_min, round(first(t order by m desc, t, ord), 6) t_max,
round((max(m) - avg(m)) / stddev_samp(m), 6) signal_to_noise, min(m) = max(m) plateau from e group by 1"""


def strict_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features over bands or none, and why: here a band needs twelve points."""
    wanted = [replace(bands.color("max", _BANDS), least=12), bands.color("median", _BANDS)]
    df = bands.extract_bands(series.events(spark, sf_dir), wanted, strict=True)
    return df.select("series_id", *(F.round(c, 6).alias(c) for c in ("color_max_click_view", "color_median_click_view")), "error")


_STRICT_BANDS = f"""with {_E}, b as (select series_id, count(*) filter (band = 'click') c, count(*) filter (band = 'view') v, max(m) filter (band = 'click') - max(m) filter (band = 'view') x, median(m) filter (band = 'click') - median(m) filter (band = 'view') y from e group by 1),
f as (select *, case when c = 0 then 'no band click' when c < 12 then 'short in band click' when v = 0 then 'no band view' when v < 12 then 'short in band view' end error from b)
select series_id, case when error is null then round(x, 6) end color_max_click_view, case when error is null then round(y, 6) end color_median_click_view, error from f"""


def multi_periodogram_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    chi2 = bands.multi_periodogram(_BANDS, 1, "chi2", fft=False)
    df = bands.extract_bands(series.events(spark, sf_dir), [bands.multi_periodogram(_BANDS, 1, "count", fft=False), replace(chi2, columns=("chi2_period", "chi2_period_s_to_n"))])
    return df.select("series_id", *(F.round(c, 6).alias(c) for c in df.columns[1:]))


def _multi_spectrum(weight: str, period: str, noise: str) -> str:
    return f"""with {_E}, e2 as (select * from e where band in ('click', 'view')),
b as (select series_id, count(*) n, min(t) t0, max(t) t1 from e2 group by 1 having count(distinct band) = 2),
o as (select series_id, band, sum(w * m) / sum(w) wm from e2 group by 1, 2),
q as (select series_id, band, count(*) n, avg(m) mu, var_samp(m) var, {weight} share from e2 join o using (series_id, band) group by 1, 2),
z as (select series_id, sum(share) total from q group by 1),
f as (select series_id, i, 4*pi()/(t1-t0) + 2*pi()*(n-1)/(n*10.0*(t1-t0)) * i freq from (select *, unnest(range(greatest(1, round((pi()*(n-1)/(t1-t0) - 4*pi()/(t1-t0)) / (2*pi()*(n-1)/(n*10.0*(t1-t0))))::bigint))) i from b)),
a as (select series_id, band, i, any_value(freq) freq, atan2(sum(sin(2 * freq * t)), sum(cos(2 * freq * t))) / 2 tau from f join e2 using (series_id) group by 1, 2, 3),
c as (select series_id, band, i, any_value(freq) freq, any_value(n) n, any_value(var) var, any_value(share) share, sum((m - mu) * sin(freq * t - tau)) ms, sum((m - mu) * cos(freq * t - tau)) mc, sum(sin(freq * t - tau)^2) ss from a join e2 using (series_id, band) join q using (series_id, band) where n > 1 and var > 0 group by 1, 2, 3),
p as (select series_id, i, any_value(freq) freq, sum(share / total * (ms^2 / ss + mc^2 / (n - ss)) / (2 * var)) power from c join z using (series_id) group by 1, 2),
k as (select *, avg(power) over z pm, stddev_samp(power) over z psd, coalesce(power > lag(power) over v and power >= lead(power) over v, false) ok from p window v as (partition by series_id order by i), z as (partition by series_id)),
r as (select *, row_number() over (partition by series_id, ok order by power desc, i) r from k)
select series_id, round(coalesce(max(2 * pi() / freq) filter (ok and r = 1), 0), 6) {period}, round(coalesce(max((power - pm) / psd) filter (ok and r = 1), 0), 6) {noise} from r group by 1"""


_MULTI_DIRECT = f"""select i.series_id, multicolor_periodogram_period_0, multicolor_periodogram_period_s_to_n_0, chi2_period, chi2_period_s_to_n from (select distinct user_id series_id from events where value is not null and ts is not null) i
left join ({_multi_spectrum('count(*)', 'multicolor_periodogram_period_0', 'multicolor_periodogram_period_s_to_n_0')}) using (series_id) left join ({_multi_spectrum('sum(w * (m - wm)^2)', 'chi2_period', 'chi2_period_s_to_n')}) using (series_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _features(wanted) for name, (wanted, _) in FEATURES.items()}
    return found | {"feature_extractor": flagship, "bins": bins, "colors": colors, "color_spread": color_spread, "per_band": per_band, "transformed": transformed, "strict": strict, "multi_extractor": multi_extractor, "multi_bins": multi_bins, "multi_periodogram": multi_periodogram, "multi_bootstrap": multi_bootstrap, "extractor_native": extractor_native, "bins_packed": bins_packed, "composed": composed, "fit_magnitudes": fit_magnitudes, "flux": flux, "unweighted": unweighted, "banded": banded, "extremes": extreme_times, "strict_bands": strict_bands, "multi_periodogram_direct": multi_periodogram_direct}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for name, (_, sql) in FEATURES.items() if sql}
    return found | {"bins": _BINS, "colors": _COLORS, "color_spread": _SPREAD, "per_band": _PER_BAND, "transformed": _TRANSFORMED, "strict": _STRICT, "multi_extractor": _MULTI, "multi_bins": _MULTI_BINS, "extractor_native": _EXTRACTOR_NATIVE, "bins_packed": _BINS, "composed": _COMPOSED, "fit_magnitudes": _FIT_MAGNITUDES, "flux": _FLUX, "unweighted": _UNWEIGHTED, "banded": _BANDED, "extremes": _EXTREMES, "strict_bands": _STRICT_BANDS, "multi_periodogram_direct": _MULTI_DIRECT}
