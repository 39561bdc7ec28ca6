"""P-values for one summary row per group (vectorised; no per-row Python)."""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def safe_corr(a: str, b: str) -> Column:
    """Pearson r of a group; null (not an error) when either side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz), vectorised; runs until every fraction
    stands still (about sqrt(max(a, b)) steps)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    z = np.clip(z, 0.0, 1.0)
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c = np.ones_like(z)
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        f = d.copy()
        for m in count(1):
            before = f
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                        -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                f = f * c * d
            if not (np.abs(f - before) > 1e-15 * np.abs(f)).any():
                break
    out = np.where(z <= 0, 0.0, front * f)
    return np.where(swap, 1 - out, out)


@F.pandas_udf(DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a Pearson or Spearman coefficient from the t distribution with n - 2 degrees of freedom."""
    rr, dof = r.astype(float).to_numpy(), n.astype(float).to_numpy() - 2
    ok = np.isfinite(rr) & (dof > 0)
    p = np.full(len(rr), np.nan)
    x = np.clip(1 - rr[ok] ** 2, 0.0, 1.0)
    p[ok] = incomplete_beta(dof[ok] / 2, np.full(ok.sum(), 0.5), x)
    return pd.Series(p)


@F.pandas_udf(DoubleType())
def ks_p_value(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Asymptotic two-sided Kolmogorov-Smirnov p."""
    en = np.sqrt(n1.astype(float) * n2.astype(float) / (n1 + n2).astype(float)).to_numpy()
    t = en * d.astype(float).to_numpy()
    k = np.arange(1, 101)[:, None]  # t is 0.2 at least below, so the terms vanish long before the last
    series = 2 * (((-1.0) ** (k - 1)) * np.exp(-2 * k * k * t[None, :] ** 2)).sum(axis=0)
    return pd.Series(np.where(t < 0.2, 1.0, np.clip(series, 0.0, 1.0)))
