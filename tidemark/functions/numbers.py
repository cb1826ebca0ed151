"""Numeric helpers that keep results comparable between engines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def tidy(value: Column | str, digits: int = 6) -> Column:
    """Rounded double in which a zero is always positive."""
    rounded = F.round(F.col(value) if isinstance(value, str) else value, digits)
    return F.when(rounded == 0.0, F.lit(0.0)).otherwise(rounded)


def ratio(part: Column, whole: Column) -> Column:
    """Real division; NULL where the divisor is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def x_log_x(value: Column) -> Column:
    """x ln x, 0 at x = 0."""
    x = value.cast("double")
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def log_gamma(values: np.ndarray) -> np.ndarray:
    """Stirling's series; small arguments are first moved up by the recurrence."""
    x = np.asarray(values, float)
    low = x < 16
    y = np.where(low, x + 16, x)
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    moved = sum(np.log(np.where(low, x + k, 1.0)) for k in range(16))
    return out - moved


@F.pandas_udf(DoubleType())
def log_choose(n: pd.Series, k: pd.Series) -> pd.Series:
    """Natural logarithm of n choose k."""
    n, k = n.to_numpy(float), k.to_numpy(float)
    return pd.Series(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1))


def log_beta(a: Column, b: Column) -> Column:
    """Natural logarithm of the beta function."""
    return -F.log(b) - log_choose(a + b - 1, a - 1)


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300

    def guarded(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(x)
    d = 1.0 / guarded(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / guarded(1.0 + even * d)
        c = guarded(1.0 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / guarded(1.0 + odd * d)
        c = guarded(1.0 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def regularized_beta(a, b, x) -> np.ndarray:
    """Regularized incomplete beta function I_x(a, b)."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    inside = (x > 0) & (x < 1)
    xs = np.where(inside, x, 0.5)
    front = np.exp(
        log_gamma(a + b) - log_gamma(a) - log_gamma(b)
        + a * np.log(xs) + b * np.log1p(-xs)
    )
    direct = xs < (a + 1.0) / (a + b + 2.0)
    p, q = np.where(direct, a, b), np.where(direct, b, a)
    y = np.where(direct, xs, 1.0 - xs)
    part = front * beta_fraction(p, q, y) / p
    value = np.where(direct, part, 1.0 - part)
    return np.where(inside, value, np.where(x >= 1, 1.0, np.where(x <= 0, 0.0, np.nan)))


@F.pandas_udf(DoubleType())
def beta_share(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    """Regularized incomplete beta function as a column."""
    return pd.Series(regularized_beta(*(v.to_numpy(float) for v in (a, b, x))))


def two_sided_t(t, dof) -> np.ndarray:
    """Two-sided p-value of Student's t; NaN in, NaN out."""
    t, dof = np.asarray(t, dtype=float), np.asarray(dof, dtype=float)
    known = np.isfinite(t) & np.isfinite(dof) & (dof > 0)
    v = np.where(known, dof, 1.0)
    s = np.where(known, t, 0.0)
    p = regularized_beta(v / 2.0, np.full_like(v, 0.5), v / (v + s * s))
    sure = np.isinf(t) & (dof > 0)
    return np.where(known, p, np.where(sure, 0.0, np.nan))


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t as a column; NULL where it is undefined."""
    p = two_sided_t(t.to_numpy(float), dof.to_numpy(float))
    return pd.Series(p).where(np.isfinite(p), None)
