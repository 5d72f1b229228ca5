"""Student-t tail probabilities (U-01) as a vectorised Pandas UDF: the regularised incomplete beta."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import col


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x])


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz), element-wise."""
    flip = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    inner = (xx > 0.0) & (xx < 1.0)
    xs = np.where(inner, xx, 0.5)
    front = np.exp(_log_gamma(aa + bb) - _log_gamma(aa) - _log_gamma(bb) + aa * np.log(xs) + bb * np.log1p(-xs)) / aa
    tiny = 1e-300
    c = np.ones_like(xs)
    d = 1.0 - (aa + bb) * xs / (aa + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (
            m * (bb - m) * xs / ((aa + 2 * m - 1) * (aa + 2 * m)),
            -(aa + m) * (aa + bb + m) * xs / ((aa + 2 * m) * (aa + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    out = np.where(inner, front * h, np.where(xx >= 1.0, 1.0, 0.0))
    return np.where(flip, 1.0 - out, out)


@F.pandas_udf(T.DoubleType())
def _two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    tv, nu = t.to_numpy(dtype=float), df.to_numpy(dtype=float)
    ok = np.isfinite(tv) & np.isfinite(nu) & (nu > 0)
    out = np.full(len(tv), np.nan)
    if ok.any():
        n = nu[ok]
        out[ok] = betainc(n / 2.0, np.full(n.shape, 0.5), n / (n + tv[ok] ** 2))
    return pd.Series(out).where(ok, None)


def t_two_sided(t, df) -> Column:
    """P(|T| > |t|)."""
    p = _two_sided(col(t).cast("double"), col(df).cast("double"))
    return F.when(~F.isnan(p), p)


def t_upper(t, df) -> Column:
    """P(T > t)."""
    half = t_two_sided(t, df) / 2.0
    return F.when(col(t) >= 0, half).otherwise(1.0 - half)
