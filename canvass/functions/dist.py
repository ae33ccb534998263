"""Distribution functions from series and continued fractions, for p-values and intervals."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

_TINY = 1e-300


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    """Quantile of the normal distribution, by Newton steps on the tail that holds p."""
    if not 0 < p < 1:
        return math.nan if p not in (0, 1) else math.copysign(math.inf, p - 0.5)
    if p > 0.5:
        return -norm_ppf(1 - p)
    t = math.sqrt(-2 * math.log(p))
    x = -(t - (2.30753 + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t))
    for _ in range(60):
        density = math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        error = norm_cdf(x) - p
        step = error / max(density, _TINY)
        step /= 1 + x * step / 2
        x -= step
        if abs(step) < 1e-15 * max(1, abs(x)):
            break
    return x


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * scale


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, 10_000):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + n * d or _TINY)
            c = 1 + n / c or _TINY
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_cdf(d2 / (d2 + d1 * x), d2 / 2, d1 / 2)


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student's t by bisection."""
    if p < 0.5:
        return -t_ppf(1 - p, df)
    low, high = 0.0, 1.0
    while 1 - t_sf2(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_sf2(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def fisher_exact(table: np.ndarray) -> float:
    """Two-sided Fisher test of a 2x2 table: the sum of all tables no likelier than this one."""
    (a, b), (c, d) = np.asarray(table, dtype=int).tolist()
    r, s, n = a + b, c + d, a + c
    log = lambda k: math.lgamma(r + 1) - math.lgamma(k + 1) - math.lgamma(r - k + 1) + math.lgamma(s + 1) - math.lgamma(n - k + 1) - math.lgamma(s - n + k + 1)
    whole = math.lgamma(r + s + 1) - math.lgamma(n + 1) - math.lgamma(r + s - n + 1)
    seen = log(a)
    support = range(max(0, n - s), min(r, n) + 1)
    return min(1.0, sum(math.exp(x - whole) for x in map(log, support) if x <= seen + 1e-7))


def bvn_cdf(h: float, k: float, rho: float) -> float:
    """P(X < h, Y < k) of a standard bivariate normal, by Gauss-Legendre quadrature over the correlation."""
    if math.isinf(h) or math.isinf(k):
        if h == -math.inf or k == -math.inf:
            return 0.0
        return norm_cdf(k if h == math.inf else h)
    nodes, weights = _legendre()
    top = math.asin(max(-1.0, min(1.0, rho)))
    angle = top * (nodes + 1) / 2
    s = np.sin(angle)
    inner = np.exp(-(h * h + k * k - 2 * h * k * s) / (2 * np.maximum(1 - s * s, 1e-300)))
    return norm_cdf(h) * norm_cdf(k) + float((weights * inner).sum()) * top / (4 * math.pi)


@lru_cache(maxsize=1)
def _legendre() -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(48)


def benjamini_hochberg(p: np.ndarray) -> np.ndarray:
    """Adjusted p-values of the step-up procedure."""
    p = np.asarray(p, dtype=float)
    order = np.argsort(p, kind="stable")
    stepped = p[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty_like(p)
    out[order] = np.minimum(np.minimum.accumulate(stepped[::-1])[::-1], 1)
    return out
