"""Quantiles of Poisson, gamma and negative binomial distributions, vectorized with numpy."""

from __future__ import annotations

import math

import numpy as np


def poisson_cdf(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """P(X <= k)."""
    k, mean = np.broadcast_arrays(np.asarray(k, dtype=float), np.asarray(mean, dtype=float))
    total, term = np.exp(-mean), np.exp(-mean)
    for i in range(1, int(max(k.max(initial=0), 0)) + 1):
        term = term * mean / i
        total = total + np.where(k >= i, term, 0)
    return np.where(k < 0, 0.0, np.minimum(total, 1.0))


def poisson_quantile(p: float, mean: np.ndarray) -> np.ndarray:
    """Least k with P(X <= k) >= p."""
    mean = np.asarray(mean, dtype=float)
    k, term = np.zeros(mean.shape, dtype=int), np.exp(-mean)
    total, i = term.copy(), 0
    while True:
        short = total < p - 1e-12
        if not short.any() or i > 10_000:
            return k
        i += 1
        term = term * mean / i
        total = total + term
        k = np.where(short, i, k)


def normal_quantile(p: float) -> float:
    """z with P(Z <= z) = p, by bisection on the error function."""
    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def gamma_cdf(x: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function, by series and continued fraction."""
    x, shape = np.broadcast_arrays(np.asarray(x, dtype=float), np.asarray(shape, dtype=float))
    out = np.zeros(x.shape)
    lead = np.exp(-x + shape * np.log(np.maximum(x, 1e-300)) - np.vectorize(math.lgamma, otypes=[float])(shape))
    low = (x > 0) & (x < shape + 1)
    if low.any():
        z, a = x[low], shape[low]
        term = total = 1 / a
        for n in range(1, 2000):
            term = term * z / (a + n)
            total = total + term
            if (term < 1e-14 * total).all():
                break
        out[low] = total * lead[low]
    high = x >= shape + 1
    if high.any():
        z, a = x[high], shape[high]
        b, c = z + 1 - a, np.full(z.shape, 1e300)
        d = 1 / b
        h = d.copy()
        for i in range(1, 2000):
            an = -i * (i - a)
            b = b + 2
            d = 1 / (an * d + b)
            c = b + an / c
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-14).all():
                break
        out[high] = 1 - lead[high] * h
    return out


def gamma_quantile(p: float, shape: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """x with P(X <= x) = p for each row: bisection, and Wilson and Hilferty's formula for shapes
    above 500, where it is right to five digits."""
    shape, rate = np.broadcast_arrays(np.asarray(shape, dtype=float), np.asarray(rate, dtype=float))
    out = shape * (1 - 1 / (9 * shape) + normal_quantile(p) / (3 * np.sqrt(shape))) ** 3
    few = shape <= 500
    if few.any():
        a = shape[few]
        lo, hi = np.zeros(a.shape), a * 4 + 20
        for _ in range(70):
            mid = (lo + hi) / 2
            less = gamma_cdf(mid, a) < p
            lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
        out[few] = (lo + hi) / 2
    return out / rate


def negative_binomial_quantile(p: float, shape: float, success: float) -> int:
    """Least k with P(X <= k) >= p; X counts failures before ``shape`` successes."""
    mean = shape * (1 - success) / success
    k = np.arange(int(mean + 12 * math.sqrt(mean / success) + 30))
    steps = np.log(shape + k[1:] - 1) - np.log(k[1:]) + math.log(1 - success)
    logs = shape * math.log(success) + np.concatenate([[0.0], np.cumsum(steps)])
    return int(np.searchsorted(np.cumsum(np.exp(logs)), p - 1e-12))


def chi_square_tail_3(x: float) -> float:
    """P(X > x) of a chi-square distribution of three degrees of freedom."""
    return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
