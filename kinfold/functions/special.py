"""Special functions that neither Spark SQL nor numpy has, on numpy arrays."""

from __future__ import annotations

import math

import numpy as np

lgamma = np.vectorize(math.lgamma, otypes=[float])
erfc = np.vectorize(math.erfc, otypes=[float])


def digamma(x) -> np.ndarray:
    """Recurrence up to 8, then the asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out[low] -= 1 / x[low]
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def log_beta(a, b) -> np.ndarray:
    return lgamma(a) + lgamma(b) - lgamma(np.add(a, b))


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - float(log_beta(a, b))) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def beta_quantile(p: float, a: float, b: float) -> float:
    """By bisection of ``beta_cdf``."""
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def log_sum_exp(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fisher_right(n11, ka, kb, n) -> np.ndarray:
    """P(at least n11) of the hypergeometric law with margins ka and kb of n.

    Summed by the ratio of neighbouring terms, away from the mode and for all rows at
    once, so only terms that count are visited; below the mode it is one minus the rest.
    """
    n11, ka, kb, n = (np.asarray(v, dtype=np.int64) for v in (n11, ka, kb, n))
    mode = ((ka + 1.0) * (kb + 1.0)) // (n + 2.0)
    up = n11 > mode
    low, high = np.maximum(0, ka + kb - n), np.minimum(ka, kb)
    at = np.where(up, n11, n11 - 1).astype(float)
    live = np.where(up, at <= high, at >= low)
    j = np.clip(at, low, high)
    logs = lgamma(ka + 1.0) - lgamma(j + 1) - lgamma(ka - j + 1) + lgamma(n - ka + 1.0) - lgamma(kb - j + 1) - lgamma(n - ka - kb + j + 1)
    term = np.where(live, np.exp(logs - (lgamma(n + 1.0) - lgamma(kb + 1.0) - lgamma(n - kb + 1.0))), 0.0)
    total = term.copy()
    while True:
        with np.errstate(divide="ignore", invalid="ignore"):
            ahead = (ka - j) * (kb - j) / ((j + 1) * (n - ka - kb + j + 1))
            back = j * (n - ka - kb + j) / ((ka - j + 1) * (kb - j + 1))
        term = np.where(live, term * np.where(up, ahead, back), 0.0)
        j = j + np.where(up, 1, -1)
        live &= (term > total * 1e-17) & (j <= high) & (j >= low)
        if not live.any():
            break
        total = total + np.where(live, term, 0.0)
    return np.clip(np.where(up, total, 1 - total), 0.0, 1.0)


def chi_square_p(statistic) -> np.ndarray:
    """Upper tail of the chi-square law with one degree of freedom."""
    return erfc(np.sqrt(np.maximum(np.asarray(statistic, dtype=float), 0) / 2))
