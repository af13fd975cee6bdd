"""Numpy kernels for what Spark has no function for: special functions, order statistics, spectra."""

from __future__ import annotations

import math

import numpy as np


def ln_erfc(x: float) -> float:
    """Logarithm of erfc: asymptotic series where erfc underflows."""
    if x < 25:
        return math.log(math.erfc(x))
    y = 1 / (2 * x * x)
    return -x * x - math.log(x * math.sqrt(math.pi)) + math.log1p(-y + 3 * y * y - 15 * y**3 + 105 * y**4)


def anderson_darling_normal(m: np.ndarray) -> float | None:
    n = len(m)
    s = np.std(m, ddof=1) if n > 1 else 0
    if n < 4 or not s:
        return None
    z = (np.sort(m) - m.mean()) / s
    low = np.array([ln_erfc(-v / math.sqrt(2)) for v in z])
    high = np.array([ln_erfc(v / math.sqrt(2)) for v in z])
    i = np.arange(n)
    a = -n - (((2 * i + 1) * (low - math.log(2)) + (2 * (n - i) - 1) * (high - math.log(2))).sum()) / n
    return float((1 + 4 / n - 25 / n**2) * a)


def upper_gamma(dof: int, chi2: float) -> float:
    """Upper tail of the chi-square distribution by its finite sums."""
    x = chi2 / 2
    if x <= 0:
        return 1.0
    if dof % 2 == 0:
        terms = [k * math.log(x) - math.lgamma(k + 1) - x for k in range(dof // 2)]
        return min(1.0, math.fsum(map(math.exp, terms)))
    terms = [(k + 0.5) * math.log(x) - math.lgamma(k + 1.5) - x for k in range((dof - 1) // 2)]
    return min(1.0, math.erfc(math.sqrt(x)) + math.fsum(map(math.exp, terms)))


def chi2_pvar(m: np.ndarray, w: np.ndarray) -> float | None:
    if len(m) < 2 or not w.sum():
        return None
    mean = (w * m).sum() / w.sum()
    return upper_gamma(len(m) - 1, float((w * (m - mean) ** 2).sum()))


#: Fixed value: consistency constant of the Qn estimator.
QN = 2.219144465985076


def qn(m: np.ndarray) -> float | None:
    """k-th smallest pairwise distance by bisection on counts: O(n log n) a step, O(n) memory."""
    n = len(m)
    if n < 2:
        return None
    x = np.sort(m)
    h = n // 2 + 1
    k = h * (h - 1) // 2
    at = np.arange(n)
    low, high = -1.0, float(x[-1] - x[0])
    below = lambda d: int((np.searchsorted(x, x + d, side="right") - at - 1).sum())
    while True:
        between = (low + high) / 2
        if between in (low, high):
            break
        low, high = (low, between) if below(between) >= k else (between, high)
    # The answer is a distance that occurs: the largest not above high.
    j = np.searchsorted(x, x + high, side="right") - 1
    found = x[j] - x
    found = found[j > at]
    return QN * float(found.max()) if len(found) else 0.0


def peaks(power: np.ndarray) -> np.ndarray:
    """Indices of strict rises that don't rise on, the highest first."""
    if len(power) < 3:
        return np.zeros(0, int)
    at = np.flatnonzero((power[1:-1] > power[:-2]) & (power[1:-1] >= power[2:])) + 1
    return at[np.argsort(-power[at], kind="stable")]


def quantile(m: np.ndarray, q: float, upper: bool = False) -> float:
    """Hazen quantile (of 1 - q if upper); its position is found in single precision."""
    o, n = np.sort(m), len(m)
    q = np.float32(1) - np.float32(q) if upper else np.float32(q)
    h = np.float32(n) * q - np.float32(0.5)
    i = int(np.floor(h))
    if h < 0:
        return float(o[0])
    return float(o[-1]) if i >= n - 1 else float(o[i] + (float(h) - i) * (o[i + 1] - o[i]))


def ordinal(n: int) -> str:
    """1st, 2nd, 3rd, 4th, 11th, 21st and so on."""
    return f"{n}{'th' if n % 100 in (11, 12, 13) else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def linear_grid(start: float, step: float, size: int) -> np.ndarray:
    if not (start >= 0 and step > 0 and size >= 1):
        raise ValueError("a grid needs start >= 0, step > 0 and a point")
    return start + step * np.arange(size)


def arbitrary_grid(freq, sort: bool = False) -> np.ndarray:
    """A grid of one's own, ascending; sorted if asked for, else refused if it is not."""
    freq = np.asarray(freq, float)
    freq = np.sort(freq) if sort else freq
    if freq.ndim != 1 or not len(freq) or not np.isfinite(freq).all() or freq[0] < 0 or (np.diff(freq) < 0).any():
        raise ValueError("a grid's frequencies must be finite, not negative and ascending")
    return freq


def suits_fft(freq: np.ndarray) -> bool:
    """Zero-based and even, with one point more than a power of two."""
    n = len(freq) - 1
    return n >= 1 and n & (n - 1) == 0 and freq[0] == 0 and bool(np.allclose(np.diff(freq), freq[-1] / n, rtol=1e-9, atol=0))


def nyquist(t: np.ndarray, kind: str | tuple) -> float:
    """average, median, (quantile, q), (fixed, frequency) or (dt, interval)."""
    if kind == "average":
        return math.pi * (len(t) - 1) / (t[-1] - t[0])
    if kind == "median":
        return math.pi / float(np.median(np.diff(t)))
    name, value = kind
    if name == "quantile":
        return math.pi / quantile(np.diff(t), value)
    return math.pi / value if name == "dt" else float(value)


def nearest(x: float) -> int:
    """The nearest whole number, halves up as in SQL (round takes them to even numbers)."""
    return math.floor(x) + int(x % 1 >= 0.5)


def grid(t: np.ndarray, resolution: float, factor: float, kind, fft: bool) -> np.ndarray:
    n, duration = len(t), t[-1] - t[0]
    step = 2 * math.pi * (n - 1) / (n * resolution * duration)
    top = nyquist(t, kind) * factor
    if fft:
        return np.arange(2 ** max(0, nearest(math.log2(top / step))) + 1) * step
    start = 4 * math.pi / duration
    return start + step * np.arange(max(1, nearest((top - start) / step)))


def power_direct(t: np.ndarray, m: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Classical Lomb-Scargle power, by blocks of frequencies."""
    var = np.var(m, ddof=1)
    if not var:
        return np.zeros(len(freq))
    d, out = m - m.mean(), np.empty(len(freq))
    for a in range(0, len(freq), 256):
        f = freq[a : a + 256, None]
        tau = np.arctan2(np.sin(2 * f * t).sum(1), np.cos(2 * f * t).sum(1))[:, None] / 2
        s, c = np.sin(f * t - tau), np.cos(f * t - tau)
        ms, mc, ss = (d * s).sum(1), (d * c).sum(1), (s * s).sum(1)
        cc = len(t) - ss
        bad = ((ms == 0) & (ss == 0)) | ((mc == 0) & (cc == 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            out[a : a + 256] = np.where(bad, 0, (ms**2 / ss + mc**2 / cc) / (2 * var))
    return out


def _spread(x: np.ndarray, y: np.ndarray | float, n: int) -> np.ndarray:
    low = np.floor(x).astype(np.int64)
    part = x - low
    return np.bincount(low % n, y * (1 - part), n) + np.bincount((low + 1) % n, y * part, n)


def power_fft(t: np.ndarray, m: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Lomb-Scargle power on a zero-based grid by spreading on a circle and two real FFTs.

    The doubled-angle sums are combined with cos and sin of the single angle, as the reproduced results are.
    """
    var = np.var(m, ddof=1)
    if not var or len(freq) < 2:
        return np.zeros(len(freq))
    n = 2 * (len(freq) - 1)
    x = (t - t[0]) / (math.pi / freq[-1])
    h, g = np.fft.rfft(_spread(x, m - m.mean(), n)), np.fft.rfft(_spread(2 * x, np.ones(len(t)), n))
    sum_c, sum_s, c2, s2 = h.real, -h.imag, g.real, -g.imag
    size = np.hypot(c2, s2)
    with np.errstate(divide="ignore", invalid="ignore"):
        cos2 = np.where(size > 0, c2 / size, 1.0)
        cos = np.sqrt((1 + cos2) / 2)
        sin = np.where(s2 < 0, -1, 1) * np.sqrt((1 - cos2) / 2)
        spread = (c2 * cos + s2 * sin) / 2
        den_c, den_s = len(t) / 2 + spread, len(t) / 2 - spread
        a = np.where(den_c != 0, (sum_c * cos + sum_s * sin) ** 2 / den_c, 0)
        b = np.where(den_s != 0, (sum_s * cos - sum_c * sin) ** 2 / den_s, 0)
    both = np.where(a == 0, 2 * b, np.where(b == 0, 2 * a, a + b))
    return both / (2 * var)


def normalized(power: np.ndarray, n: int, kind: str) -> np.ndarray:
    """psd (as it is), standard, model or log."""
    if kind == "psd":
        return power
    p = power * 2 / (n - 1)
    if kind == "standard":
        return p
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p >= 1, np.inf, p / (1 - p) if kind == "model" else -np.log1p(-p))
