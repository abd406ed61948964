"""Special functions on numpy arrays: normal, gamma and beta distributions."""

from __future__ import annotations

import math

import numpy as np

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])
_ERFC = np.vectorize(math.erfc, otypes=[float])


def ndtr(z) -> np.ndarray:
    """Normal distribution function."""
    return 0.5 * _ERFC(-np.asarray(z, float) / math.sqrt(2))


def ndtri(p) -> np.ndarray:
    """Its inverse: bisection on a bracket that holds all doubles, then Newton steps."""
    p = np.asarray(p, float)
    low, high = np.full(p.shape, -39.0), np.full(p.shape, 39.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = ndtr(mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    out = (low + high) / 2
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, np.where(np.isnan(p), np.nan, out)))


def gammainc(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma function, by series below a + 1 and continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    ok = (a > 0) & (x > 0) & np.isfinite(a) & np.isfinite(x)
    sa, sx = np.where(ok, a, 1.0), np.where(ok, x, 1.0)
    front = np.exp(sa * np.log(sx) - sx - _LGAMMA(sa))
    term = 1 / sa
    series = term.copy()
    for n in range(1, 500):
        term = term * sx / (sa + n)
        series += term
    tiny = 1e-300
    b = sx + 1 - sa
    c, d = np.full(sx.shape, 1 / tiny), 1 / np.where(b == 0, tiny, b)
    h = d
    for n in range(1, 500):
        an = -n * (n - sa)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
    value = np.where(sx < sa + 1, front * series, 1 - front * h)
    return np.where(ok, np.clip(value, 0, 1), np.where((a > 0) & (x == 0), 0.0, np.where((a > 0) & np.isposinf(x), 1.0, np.nan)))


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    ok = (a > 0) & (b > 0) & (x > 0) & (x < 1)
    sa, sb, sx = np.where(ok, a, 1.0), np.where(ok, b, 1.0), np.where(ok, x, 0.5)
    swap = sx > (sa + 1) / (sa + sb + 2)
    p, q, y = np.where(swap, sb, sa), np.where(swap, sa, sb), np.where(swap, 1 - sx, sx)
    front = np.exp(_LGAMMA(p + q) - _LGAMMA(p) - _LGAMMA(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    fix = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(y)
    d = 1 / fix(1 - (p + q) * y / (p + 1))
    h = d
    for m in range(1, 300):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / fix(1 + num * d)
            c = fix(1 + num / c)
            h = h * d * c
    value = np.where(swap, 1 - front * h, front * h)
    return np.where(ok, np.clip(value, 0, 1), np.where((a > 0) & (b > 0) & (x <= 0), 0.0, np.where((a > 0) & (b > 0) & (x >= 1), 1.0, np.nan)))


def t_two_sided(t, dof) -> np.ndarray:
    """Two-sided p-value of Student's t."""
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    return betainc(dof / 2, 0.5, dof / (dof + t * t)) if np.ndim(t) else betainc(np.array([dof / 2]), 0.5, np.array([dof / (dof + t * t)]))[0]


def chi2_sf(x, dof) -> np.ndarray:
    """Upper tail of the chi-squared distribution."""
    return 1 - gammainc(np.asarray(dof, float) / 2, np.asarray(x, float) / 2)
