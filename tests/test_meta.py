import json
import math

import numpy as np
import pytest

from tessera.functions import fits, priors
from tessera.operators import bands, meta
from tessera.operators import features as O

TRUE = {"bazin": [20.0, 3.0, 30.0, 4.0, 15.0], "linexp": [20.0, 10.0, 12.0, 3.0], "villar": [20.0, 3.0, 25.0, 3.0, 20.0, 0.3, 15.0]}
#: Where fits begin: value, low, high.
START = {n: {p: (v * 1.1, 0, 1 if p == "plateau_rel_amplitude" else 1000) for p, v in zip(fits.CURVES[n].parameters, TRUE[n])} for n in TRUE}


def made(name, seed=0):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 100, 120))
    m = fits.CURVES[name].value(t, np.array(TRUE[name])) + rng.normal(0, 0.05, len(t))
    return t, m, np.full(len(t), 400.0)


@pytest.mark.parametrize("name", fits.CURVES)
def test_gradients_are_differences(name):
    curve, t, p = fits.CURVES[name], np.linspace(0.3, 100, 41), np.array(TRUE[name])
    got = curve.gradient(t, p)
    for i in range(len(p)):
        d = np.zeros(len(p))
        d[i] = 1e-6
        assert got[:, i] == pytest.approx((curve.value(t, p + d) - curve.value(t, p - d)) / 2e-6, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("name", fits.CURVES)
@pytest.mark.parametrize("solver", [fits.LevenbergMarquardt(200), fits.LevenbergMarquardt(200, bounded=True, loss=3.0), fits.Ensemble(400, fits.LevenbergMarquardt(100)), fits.NoUTurn(60, 60, fits.LevenbergMarquardt(100))], ids=["lm", "bounded", "ensemble", "nuts"])
def test_curves_are_recovered(name, solver):
    t, m, w = made(name)
    *p, chi2 = fits.fit(name, t, m, w, solver, start=START[name])
    assert chi2 < 1.6
    assert fits.CURVES[name].value(t, np.array(p)) == pytest.approx(fits.CURVES[name].value(t, np.array(TRUE[name])), abs=0.25)


def test_ensemble_alone_reports_half_of_chi2():
    t, m, w = made("bazin")
    *p, value = fits.fit("bazin", t, m, w, fits.Ensemble(50))
    r = (fits.bazin(t, np.array(p)) - m) * np.sqrt(w)
    assert value == pytest.approx((r @ r) / 2 / (len(t) - 5), rel=1e-6)


def test_priors_hold_the_fit_back():
    t, m, w = made("villar")
    p = fits.fit("villar", t, m, w, fits.Ensemble(100), start={"rise_time": (1.0, 0.5, 2.0)})
    assert 0.5 <= p[3] <= 2.0
    held = fits.fit("bazin", *made("bazin"), fits.NoUTurn(40, 40), priors.Independent((priors.Normal(20, 1), priors.Free(), priors.Free(), priors.LogNormal(1, 1), priors.Free())))
    assert np.isfinite(held).all()
    assert np.isfinite(fits.fit("villar", t, m, w, fits.Ensemble(20), fits.supernova_prior(), start={"rise_time": (5.0, 0, 100), "fall_time": (20.0, 0, 100)})[:-1]).all()


@pytest.mark.parametrize("prior", [priors.Normal(2, 0.5), priors.LogNormal(0.3, 0.8), priors.Uniform(0.5, 4), priors.LogUniform(0.5, 4), priors.Mix(((1, priors.Normal(1, 1)), (3, priors.LogNormal(0, 1))))])
def test_priors_are_densities_with_gradients(prior):
    x = np.linspace(1e-3, 12, 400_001) if not isinstance(prior, priors.Mix) else np.linspace(-8, 60, 400_001)
    assert np.trapezoid(np.exp(prior.value(x)), x) == pytest.approx(1, abs=0.01)
    at = np.array([0.7, 1.5, 3.2])
    assert prior.gradient(at) == pytest.approx((prior.value(at + 1e-6) - prior.value(at - 1e-6)) / 2e-6, abs=1e-5)
    assert priors.Uniform(0, 1).value(np.array([2.0]))[0] == -np.inf


def test_bootstrap_spreads_as_theory_says():
    rng = np.random.default_rng(2)
    m = rng.normal(5, 2, 400)
    f = O.feature("Bootstrap", features=[O.feature("Mean")], n=400)
    value, sigma = O.evaluate(f, np.arange(400.0), m, np.ones(400))
    assert f.columns == ("bootstrap_mean", "bootstrap_mean_sigma")
    assert value == m.mean() and sigma == pytest.approx(2 / 20, rel=0.15)
    f = O.feature("Bootstrap", features=[O.feature("Mean")], quantiles=[0.16, 0.84])
    assert f.columns == ("bootstrap_mean", "bootstrap_mean_quantile_16", "bootstrap_mean_quantile_84")
    _, low, high = O.evaluate(f, np.arange(400.0), m, np.ones(400))
    assert low < m.mean() < high
    with pytest.raises(ValueError):
        O.feature("Bootstrap", features=[O.feature("Eta")])


def test_periodogram_folds_at_its_period():
    rng = np.random.default_rng(0)
    t = np.sort(rng.random(300))
    m = 3 * np.sin(2 * math.pi * t / 0.17 + 0.5) + 4
    f = O.feature("Periodogram", spectrum=[O.feature("Mean")], phase=[O.feature("Eta"), O.feature("Mean")], fft=False)
    assert f.columns == ("periodogram_period_0", "periodogram_period_s_to_n_0", "periodogram_mean", "period_folded_eta", "period_folded_mean")
    got = O.evaluate(f, t, m, np.ones(300))
    assert got[0] == pytest.approx(0.17, rel=0.05) and got[4] == pytest.approx(m.mean())
    assert got[3] < O.evaluate(O.feature("Eta"), t, m, np.ones(300))[0]
    assert O.evaluate(O.feature("PeriodogramPeaks"), np.arange(5.0), np.array([0, 1, 3, 1, 0.0]), np.ones(5))[0] == pytest.approx(math.pi)


def test_declared_features():
    got = meta.declared(json.dumps(["Mean", {"feature": "BeyondNStd", "nstd": 2}, {"feature": "Bins", "window": 2, "features": ["Median"]}, {"feature": "Transformed", "of": "Mean", "kind": "sqrt"}, {"feature": "Periodogram", "peaks": 2, "nyquist": ["quantile", 0.1]}]))
    assert [f.columns[0] for f in got] == ["mean", "beyond_2_std", "bins_window2.0_offset0.0_median", "sqrt_mean", "periodogram_period_0"]


def test_strict_is_all_or_nothing(spark):
    packed = spark.createDataFrame([(0, [0.0, 1.0], [1.0, 2.0], [1.0, 1.0]), (1, [0.0, 1.0, 2.0], [5.0] * 3, [1.0] * 3), (2, [0.0, 1.0, 2.0], [1.0, 2.0, 4.0], [1.0] * 3)], "series_id long, t array<double>, m array<double>, w array<double>")
    rows = {r.series_id: r for r in O.extract(packed, [O.feature("Mean"), O.feature("Skew")], strict=True).collect()}
    assert [rows[i].error for i in range(3)] == ["short", "flat", None] and rows[0]["mean"] is None and rows[2].skew is not None
    filled = O.extract(packed, [O.feature("Mean"), O.feature("Skew")], fill=-1.0).collect()
    assert {r.series_id: r.skew for r in filled}[0] == -1.0


def band_series(n=150, period=0.3):
    rng = np.random.default_rng(5)
    out = {}
    for i, b in enumerate("gr"):
        t = np.sort(rng.random(n) * 3)
        out[b] = t, np.sin(2 * math.pi * t / period) * (2 + i) + i, np.ones(n)
    return out


@pytest.mark.parametrize("weights", ["count", "chi2"])
@pytest.mark.parametrize("fft", [True, False])
def test_bands_share_a_period(weights, fft):
    f = bands.multi_periodogram(["g", "r"], weights=weights, fft=fft, phase=[O.feature("Eta")], spectrum=[O.feature("Mean")])
    assert f.columns == ("multicolor_periodogram_period_0", "multicolor_periodogram_period_s_to_n_0", "multicolor_periodogram_mean", "period_folded_g_eta", "period_folded_r_eta")
    got = bands.evaluate_bands(f, band_series())
    assert got[0] == pytest.approx(0.3, rel=0.05) and all(v is not None for v in got)
    assert bands.evaluate_bands(f, {"g": band_series()["g"]}) == [None] * 5


@pytest.mark.parametrize("scheme", ["stratified", "rejection"])
def test_bands_bootstrap(scheme):
    f = bands.multi_bootstrap([bands.color("median", ["g", "r"])], scheme=scheme)
    value, sigma = bands.evaluate_bands(f, band_series())
    assert value == bands.evaluate_bands(bands.color("median", ["g", "r"]), band_series())[0] and sigma > 0
    assert bands.evaluate_bands(f, {}) == [None, None]
