import math

import numpy as np
import pytest

from tessera.functions import kernels
from tessera.operators import features as O

NAN = float("nan")
#: Series and what is expected of them (feature, parameters, m, t, w, values).
GOLDEN = [
    ("Mean", {}, [1, 1, 1, 1, 5, 6, 6, 6, 99], None, None, [14]),
    ("MeanVariance", {}, [1, 1, 1, 1, 5, 6, 6, 6, 99], None, None, [2.2832017440606585]),
    ("MedianAbsoluteDeviation", {}, [1, 1, 1, 1, 5, 6, 6, 6, 100], None, None, [4]),
    ("PercentAmplitude", {}, [1, 1, 1, 2, 4, 5, 5, 98, 100], None, None, [96]),
    ("Median", {}, [-99, 0, 4, 3, 2, 1], None, None, [1.5]),
    ("Skew", {}, [2, 3, 5, 7, 11, 13], None, None, [0.4626804756753222]),
    ("Kurtosis", {}, [0, 1, 2, 3, 4], None, None, [-1.2]),
    ("StandardDeviation", {}, [0, 1, 2, 3, 4], None, None, [1.5811388300841898]),
    ("Eta", {}, [1, 0, 0, 0, 0, 0, 0, 0, 0, 109], None, None, [1.11338]),
    ("EtaE", {}, [1, 1, 6, 8], [1, 2, 5, 10], None, [0.6957894]),
    ("Cusum", {}, [1, 1, 1, 5, 8, 20], None, None, [0.3589213]),
    ("WeightedMean", {}, [0, 1, 2, 3, 4], None, [10, 5, 3, 2.5, 2], [1.1777777777777778]),
    ("ReducedChi2", {}, [1, 2, 1, 0, -1, 0, 1, 2, -2, 0], None, [1, 2] * 5, [2.192592592592593]),
    ("Chi2Pvar", {}, [1, 2, 1, 0, -1, 0, 1, 2, -2, 0], None, [1, 2] * 5, [0.019631336718999857]),
    ("ExcessVariance", {}, [1, 1, 1, 1, 5, 6, 6, 6, 7], None, [1, 0.5, 1, 2, 0.5, 2, 1, 1, 0.5], [0.41846885813148793]),
    ("Roms", {}, [1, 1, 2, 3, 5], None, [1, 4, 1, 2, 4], [2.6035533]),
    ("LinearTrend", {}, [1, 2, 3, 8, 10, 19], [1, 3, 5, 7, 11, 13], None, [1.38198758, 0.24532195657979344, 2.54157969]),
    ("LinearFit", {}, [(i / 10) ** 2 for i in range(11)], [i / 10 for i in range(11)], [1 + i / 10 for i in range(11)], [1.0544186045473263, 0.7963978113902943, 0.013781209302325587]),
    ("ParabolaFit", {}, [-1, 3, 2, 6, 10, 25], [0.5, 1.5, 2.5, 5, 7, 16], [2, 1, 3, 10, 1, 0.4], [0.016123168785128206, -31.173339538115183, 1.9657090723904733]),
    ("OtsuSplit", {}, [0.51, 0.52, 0.53, 0.54, 1.2, 1.3], None, None, [0.725, 0.012909944487358068, 0.07071067811865482, 0.6666666666666666]),
    ("BiweightScale", {}, [1, 2, 4, 7, 11, 16, 22, 100], None, None, [7.922078257662727]),
    ("QnScale", {}, [1, 2, 4, 7, 11, 16, 22, 100], None, None, [15.53401126189553]),
    ("BeyondNStd", {}, [1, 2, 3, 4, 100], None, None, [0.2]),
    ("InterPercentileRange", {}, list(range(100)), None, None, [50]),
    ("AndersonDarlingNormal", {}, [i / 100 for i in range(101)], None, None, [1.1354353876265415]),
    ("LaflerKinmanStringLength", {}, [0, 1, 0], None, None, [1.5]),
    ("MaximumSlope", {}, [0, 1, 2, 3, 4, 5], [0, 2, 4, 5, 7, 9], None, [1.0]),
    ("MaximumTimeInterval", {}, [0] * 5, [0, 0.5, 0.6, 1.6, 10.6], None, [9.0]),
    ("MinimumTimeInterval", {}, [0] * 5, [0, 0.5, 0.6, 1.6, 10.6], None, [0.1]),
    ("MedianBufferRangePercentage", {}, [1, 41, 49, 49, 50, 51, 52, 58, 100], None, None, [0.5555555555]),
]


def test_golden_values(spark):
    rows = [(i, [float(x) for x in (t or range(len(m)))], [float(x) for x in m], [float(x) for x in (w or [1] * len(m))]) for i, (_, _, m, t, w, _) in enumerate(GOLDEN)]
    packed = spark.createDataFrame(rows, "series_id long, t array<double>, m array<double>, w array<double>")
    wanted = [O.feature(n, **p) for n, p, *_ in GOLDEN]
    got = {r.series_id: r for r in O.extract(packed, wanted).collect()}
    for i, (f, row) in enumerate(zip(wanted, GOLDEN)):
        assert [got[i][c] for c in f.columns] == pytest.approx(row[-1], rel=1e-6), f.name


def test_short_and_flat_series_are_null(spark):
    packed = spark.createDataFrame([(0, [], [], []), (1, [1.0], [2.0], [1.0]), (2, [1.0, 2.0, 3.0, 4.0, 5.0], [7.0] * 5, [1.0] * 5)], "series_id long, t array<double>, m array<double>, w array<double>")
    wanted = [O.feature(n) for n in O.FEATURES]
    got = {r.series_id: r for r in O.extract(packed, wanted).collect()}
    for f in wanted:
        for i, n in ((0, 0), (1, 1), (2, 5)):
            if n < f.least or ("v" in f.needs and n):
                assert all(got[i][c] is None for c in f.columns), f.name


def test_direct_power():
    t = np.arange(100.0)
    got = kernels.power_direct(t, np.sin(0.07 * t), np.array([0.01, 0.02, 0.03, 0.04]))
    assert got == pytest.approx([16.9901802, 18.5772252, 21.9604974, 28.1505681], rel=1e-6)


@pytest.mark.parametrize("fft", [True, False])
def test_period_is_recovered(fft):
    rng = np.random.default_rng(0)
    t = np.sort(rng.random(200))
    m = 3 * np.sin(2 * math.pi * t / 0.17 + 0.5) + 4
    freq, power = O.periodogram(t, m, fft=fft)
    assert O.top_peaks(freq, power, 1)[0] == pytest.approx(0.17, rel=0.05)


def test_qn_matches_all_pairs():
    rng = np.random.default_rng(1)
    for n in (2, 3, 10, 61):
        m = rng.normal(size=n).round(1)
        d = np.sort(np.abs(m[:, None] - m)[np.triu_indices(n, 1)])
        h = n // 2 + 1
        assert kernels.qn(m) == pytest.approx(kernels.QN * d[h * (h - 1) // 2 - 1])


def test_bins():
    t, m, w = O.bins(np.array([0.0, 0.5, 1.2, 2.7]), np.array([1.0, 3.0, 5.0, 7.0]), np.array([1.0, 3.0, 2.0, 4.0]))
    assert t.tolist() == [0.5, 1.5, 2.5] and m.tolist() == [2.5, 5.0, 7.0] and w.tolist() == [2.0, 2.0, 4.0]
