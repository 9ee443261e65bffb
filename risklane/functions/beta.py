"""Beta quantiles and Beta draws, as vectorised pandas functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    x, a, b = np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in (x, a, b)])
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    tiny = 1e-300

    def guarded(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(x)
    d = 1 / guarded(1 - (a + b) * x / (a + 1))
    fraction = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 / guarded(1 + step * d)
            c = guarded(1 + step / c)
            fraction = fraction * c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
                       + a * np.log(x) + b * np.log1p(-x)) / a
    lower = np.where(x <= 0, 0.0, front * fraction)
    return np.where(flip, 1 - lower, lower)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(60):
        middle = (low + high) / 2
        under = beta_cdf(middle, a, b) < p
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def interval95(alpha: pd.Series, beta: pd.Series) -> pd.Series:
    """The 2.5% and 97.5% quantiles, rounded to four places."""
    a, b = alpha.to_numpy(float), beta.to_numpy(float)
    ends = np.stack([beta_quantile(0.025, a, b), beta_quantile(0.975, a, b)], axis=1)
    return pd.Series(list(np.round(ends, 4)))


def _mix(bits: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    bits = (bits ^ (bits >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    bits = (bits ^ (bits >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return bits ^ (bits >> np.uint64(31))


def _uniform(seed: np.ndarray, step: int) -> np.ndarray:
    """In (0, 1), a pure function of (seed, step)."""
    bits = _mix(seed + np.uint64((step * 0x9E3779B97F4A7C15) % 2**64))
    return ((bits >> np.uint64(11)).astype(float) + 0.5) / 2**53


def _gamma(shape: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Marsaglia-Tsang for shape >= 1; the few rejected entries go round again."""
    d = shape - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out = np.empty_like(d)
    left = np.arange(len(d))
    step = 0
    while len(left):
        s, dl, cl = seed[left], d[left], c[left]
        normal = np.sqrt(-2 * np.log(_uniform(s, step + 1))) * np.cos(2 * np.pi * _uniform(s, step + 2))
        v = (1 + cl * normal) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            bound = 0.5 * normal**2 + dl - dl * v + dl * np.log(v)
            taken = (v > 0) & (np.log(_uniform(s, step + 3)) < bound)
        out[left[taken]] = dl[taken] * v[taken]
        left = left[~taken]
        step += 3
    return out


def beta_draws(seed: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        bits = seed.astype(np.int64).view(np.uint64)
        x = _gamma(alpha.astype(float), _mix(bits ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        y = _gamma(beta.astype(float), _mix(bits ^ np.uint64(0x5A5A5A5A5A5A5A5A)))
    return x / (x + y)


@F.pandas_udf(T.DoubleType())
def beta_draw(seed: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
    """One Beta(alpha, beta) draw per row, decided by ``seed`` alone, so reruns agree."""
    return pd.Series(beta_draws(seed.to_numpy(), alpha.to_numpy(), beta.to_numpy()))
