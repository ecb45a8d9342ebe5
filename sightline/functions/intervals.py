"""Exact binomial bounds. They need the incomplete beta function, hence one Arrow UDF over whole batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def regularized_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) element by element for a, b > 0 and 0 < x < 1, by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)  # the fraction converges fast on the other side
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
    floor = 1e-300
    held = lambda v: np.where(np.abs(v) < floor, floor, v)
    d = 1 / held(1 - (p + q) * y / (p + 1))
    c, total = np.ones_like(d), d.copy()
    for m in range(1, 2000):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / held(1 + even * d), held(1 + even / c)
        total = total * d * c
        d, c = 1 / held(1 + odd * d), held(1 + odd / c)
        total = total * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    part = front * total / p
    return np.where(swap, 1 - part, part)


def upper_bounds(failures: np.ndarray, trials: np.ndarray, confidence: float) -> np.ndarray:
    """Upper ends of the exact two-sided intervals for rates, for all rows at once.

    The bound is the quantile of Beta(failures + 1, trials - failures). Newton steps on its distribution function,
    held inside a bracket that each step narrows, meet it in a few rounds.
    """
    failures, trials = np.asarray(failures, dtype=float), np.asarray(trials, dtype=float)
    if np.any((trials <= 0) | (failures < 0) | (failures > trials)):
        raise ValueError("impossible binomial counts")
    out = np.ones(len(trials))
    open_ = failures < trials
    a, b = failures[open_] + 1, trials[open_] - failures[open_]
    goal = 1 - (1 - confidence) / 2
    low, high = np.zeros(len(a)), np.ones(len(a))
    x = a / (a + b)
    scale = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) if len(a) else a
    for _ in range(200):
        if not len(a):
            break
        off = regularized_beta(a, b, x) - goal
        low, high = np.where(off < 0, x, low), np.where(off < 0, high, x)
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            step = x - off / np.exp(scale + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
        inside = (step > low) & (step < high)
        nearer = np.where(inside, step, (low + high) / 2)
        done = np.all(np.abs(nearer - x) <= 1e-15)
        x = np.clip(nearer, 1e-300, 1 - 1e-16)
        if done:
            break
    out[open_] = x
    return out


def clopper_pearson_upper(failures: Column, trials: Column, confidence: float = 0.95) -> Column:
    """Exact upper bound of ``failures``/``trials``; the closed forms for 0 and all stay in the JVM."""
    tail = (1.0 - confidence) / 2.0

    @F.pandas_udf("double")
    def solve(k: pd.Series, n: pd.Series) -> pd.Series:
        out = np.full(len(k), np.nan)
        known = (k.notna() & n.notna()).to_numpy()
        out[known] = upper_bounds(k[known], n[known], confidence)
        return pd.Series(out).where(known, None).astype("float64")

    invalid = (trials <= 0) | (failures < 0) | (failures > trials)
    return (F.when(failures.isNull() | trials.isNull(), F.lit(None).cast("double"))
            .when(invalid, F.raise_error(F.lit("impossible binomial counts")).cast("double"))
            .when(failures == 0, F.lit(1.0) - F.pow(F.lit(tail), F.lit(1.0) / trials))
            .when(failures == trials, F.lit(1.0))
            .otherwise(solve(F.when((failures > 0) & (failures < trials), failures),
                             F.when((failures > 0) & (failures < trials), trials))))
