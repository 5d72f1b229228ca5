"""Row-frame windows per symbol with the full-window rule, and recursive averages without Python."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import col, corr_over

SYMBOL, DATE = "symbol", "dt"


def ts(by=SYMBOL, order=DATE) -> WindowSpec:
    return W.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)


def spread(d: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition on the keys into the configured number of partitions, for work that is heavy per row.

    Adaptive coalescing goes by bytes and would put small but expensive groups into one task. Windows
    and grouped maps on the same keys reuse this exchange.
    """
    return d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def frame(n: int, shift: int = 0, by=SYMBOL, order=DATE) -> WindowSpec:
    """The last n rows, ending `shift` rows before the current one."""
    return ts(by, order).rowsBetween(-(n - 1) - shift, -shift)


def lag(x, n: int = 1, by=SYMBOL, order=DATE) -> Column:
    return F.lag(col(x), n).over(ts(by, order))


def lead(x, n: int = 1, by=SYMBOL, order=DATE) -> Column:
    return F.lead(col(x), n).over(ts(by, order))


def full(x, agg: Column, n: int, shift: int = 0, min_periods: int | None = None, by=SYMBOL, order=DATE) -> Column:
    """`agg` over the last n rows, NULL unless enough values of `x` are present."""
    w = frame(n, shift, by, order)
    need = n if min_periods is None else min_periods
    return F.when(F.count(col(x)).over(w) >= need, agg.over(w))


def r_mean(x, n, shift=0, min_periods=None, **k) -> Column:
    return full(x, F.avg(col(x)), n, shift, min_periods, **k)


def r_sum(x, n, shift=0, min_periods=None, **k) -> Column:
    return full(x, F.sum(col(x)), n, shift, min_periods, **k)


def r_std(x, n, shift=0, min_periods=None, **k) -> Column:
    return full(x, F.stddev_samp(col(x)), n, shift, min_periods, **k)


def r_max(x, n, shift=0, min_periods=None, **k) -> Column:
    return full(x, F.max(col(x)), n, shift, min_periods, **k)


def r_min(x, n, shift=0, min_periods=None, **k) -> Column:
    return full(x, F.min(col(x)), n, shift, min_periods, **k)


def r_corr(x, y, n, min_periods=None, **k) -> Column:
    """Rolling correlation; the count is of rows where both are present. A flat side gives NULL."""
    x, y = col(x), col(y)
    ok = x.isNotNull() & y.isNotNull()
    a, b = F.when(ok, x), F.when(ok, y)
    w = frame(n, **k)
    need = n if min_periods is None else min_periods
    moving = (F.min(a).over(w) < F.max(a).over(w)) & (F.min(b).over(w) < F.max(b).over(w))
    return F.when((F.count(a).over(w) >= need) & moving, corr_over(a, b, w))


def r_slope(x, n, pos="bar", **k) -> Column:
    """Least-squares slope of x against the row position."""
    return full(x, F.regr_slope(col(x), col(pos).cast("double")), n, **k)


def r_skew(x, n, min_periods=None, **k) -> Column:
    """Bias-adjusted sample skewness (F.skewness is the population one)."""
    x = col(x)
    w = frame(n, **k)
    c = F.count(x).over(w).cast("double")
    need = max(n if min_periods is None else min_periods, 3)
    g = F.skewness(x).over(w)
    return F.when((c >= need) & (F.stddev_samp(x).over(w) > 1e-12), g * F.sqrt(c * (c - 1)) / (c - 2))


def r_kurt(x, n, min_periods=None, **k) -> Column:
    """Bias-adjusted excess kurtosis."""
    x = col(x)
    w = frame(n, **k)
    c = F.count(x).over(w).cast("double")
    need = max(n if min_periods is None else min_periods, 4)
    g = F.kurtosis(x).over(w)
    return F.when(
        (c >= need) & (F.stddev_samp(x).over(w) > 1e-12),
        (c - 1) / ((c - 2) * (c - 3)) * ((c + 1) * g + 6),
    )


def ffill(x, by=SYMBOL, order=DATE) -> Column:
    """Last known value; never looks ahead."""
    return F.last(col(x), ignorenulls=True).over(ts(by, order).rowsBetween(W.unboundedPreceding, 0))


def running(agg: Column, by=SYMBOL, order=DATE) -> Column:
    return agg.over(ts(by, order).rowsBetween(W.unboundedPreceding, 0))


# ---------------------------------------------------------------- recursive averages

# A term that has decayed by exp(-DECAY) is below double precision next to the newest one.
DECAY = 40.0


def ewm_mean(
    df: DataFrame,
    x: str,
    out: str,
    *,
    span: float | None = None,
    halflife: float | None = None,
    alpha: float | None = None,
    adjust: bool = False,
    min_periods: int = 1,
    seed_rows: int = 0,
    by=SYMBOL,
    order=DATE,
) -> DataFrame:
    """Exponentially weighted mean as plain window sums (no array per row, no Python).

    y_t = a_t y_{t-1} + c_t x_t is unrolled to y_t = sum_i c_i x_i exp(D_i - D_t) with D the running
    sum of -ln a. The exponent is kept small by cutting each series into chunks of decay 40: a chunk
    needs only its own running sum and the last value of the chunk before it, because anything older
    has decayed below double precision. Gaps decay by position, as for a row-position average. Chunk numbers
    rise with the order, so (chunk, order) is the same order: windows over the series share the sort of those over a chunk.

    `seed_rows` > 0 starts from the plain mean of the first rows (Wilder).
    """
    if alpha is None:
        alpha = 2.0 / (span + 1.0) if span is not None else 1.0 - math.exp(-math.log(2.0) / halflife)
    keep = 1.0 - alpha
    rate = -math.log(keep)
    by = [by] if isinstance(by, str) else list(by)
    w = ts(by, order).rowsBetween(W.unboundedPreceding, 0)
    before = ts(by, order).rowsBetween(W.unboundedPreceding, -1)
    p = f"__{out}_"
    xv = F.col(x)
    has = xv.isNotNull()

    d = df.withColumn(p + "i", F.row_number().over(ts(by, order))).withColumn(p + "n", F.count(xv).over(w))
    if adjust:
        chunk_len = max(int(math.ceil(DECAY / rate)), 1)
        d = d.withColumn(p + "k", F.floor(F.col(p + "i") / F.lit(chunk_len)))
        pos = F.col(p + "i") - F.col(p + "k") * chunk_len
        grow = F.exp(pos * F.lit(rate))
        wc = ts([*by, p + "k"], order).rowsBetween(W.unboundedPreceding, 0)
        shrink = F.exp(-pos * F.lit(rate))
        d = d.withColumn(p + "a", F.coalesce(F.sum(xv * grow).over(wc), F.lit(0.0)) * shrink)
        d = d.withColumn(p + "b", F.coalesce(F.sum(F.when(has, grow)).over(wc), F.lit(0.0)) * shrink)
        last = F.col(p + "i") % chunk_len == chunk_len - 1
        carry = F.exp(-(pos + 1) * F.lit(rate))
        before = W.partitionBy(*by).orderBy(p + "k", order).rowsBetween(W.unboundedPreceding, -1)
        num = F.col(p + "a") + F.coalesce(F.last(F.when(last, F.col(p + "a")), True).over(before), F.lit(0.0)) * carry
        den = F.col(p + "b") + F.coalesce(F.last(F.when(last, F.col(p + "b")), True).over(before), F.lit(0.0)) * carry
        d = d.withColumn(out, F.when((F.col(p + "n") >= min_periods) & (den > 0), num / den))
        return d.drop(*[p + s for s in "inkab"])

    # adjust=False: coefficients depend on the gap since the previous value
    d = d.withColumn(p + "g", F.col(p + "i") - F.last(F.when(has, F.col(p + "i")), True).over(before))
    held = F.exp(-F.col(p + "g") * F.lit(rate))
    first = F.col(p + "n") == (seed_rows if seed_rows else 1)
    started = F.col(p + "n") >= (seed_rows if seed_rows else 1)
    seed = F.avg(xv).over(w) if seed_rows else xv
    d = d.withColumn(
        p + "c",
        F.when(has & started, F.when(first, seed).otherwise(xv * F.lit(alpha) / (held + F.lit(alpha)))),
    )
    d = d.withColumn(
        p + "d",
        F.when(has & started & ~first, -F.log(held / (held + F.lit(alpha)))).otherwise(F.lit(0.0)),
    )
    d = d.withColumn(p + "D", F.sum(p + "d").over(w))
    d = d.withColumn(p + "k", F.floor(F.col(p + "D") / F.lit(DECAY)))
    wc = ts([*by, p + "k"], order).rowsBetween(W.unboundedPreceding, 0)
    pos = F.col(p + "D") - F.col(p + "k") * F.lit(DECAY)
    d = d.withColumn(p + "s", F.coalesce(F.sum(F.col(p + "c") * F.exp(pos)).over(wc) * F.exp(-pos), F.lit(0.0)))
    # value and position of the previous chunk's last row: the row just before this chunk began
    by_chunk = W.partitionBy(*by).orderBy(p + "k", order)
    start = F.struct(F.lag(p + "s").over(by_chunk).alias("s"), F.lag(p + "D").over(by_chunk).alias("D"))
    d = d.withColumn(p + "o", F.when(F.lag(p + "k").over(by_chunk) < F.col(p + "k"), start))
    d = d.withColumn(p + "o", F.last(p + "o", True).over(wc))
    carried = F.when(F.col(p + "o").isNotNull(), F.col(p + "o.s") * F.exp(F.col(p + "o.D") - F.col(p + "D")))
    y = F.col(p + "s") + F.coalesce(carried, F.lit(0.0))
    d = d.withColumn(out, F.when((F.col(p + "n") >= max(min_periods, seed_rows)), y))
    return d.drop(*[p + s for s in "ingcdDkso"])


# ---------------------------------------------------------------- folds over a bounded window


def _window_list(x, n: int, **k) -> Column:
    return full(x, F.collect_list(col(x)), n, **k)


def worst_drawdown(x, n: int, **k) -> Column:
    """Largest peak-to-trough fall inside the last n rows, as a negative fraction."""
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))

    def step(acc, v):
        peak = F.greatest(acc["peak"], v)
        return F.struct(peak.alias("peak"), F.least(acc["dd"], (v - peak) / peak).alias("dd"))

    arr = _window_list(x, n, **k)
    return F.when(arr.isNotNull(), F.aggregate(arr, start, step, lambda a: a["dd"]))


def ulcer(x, n: int, **k) -> Column:
    """Root mean square of the percentage drawdown inside the last n rows."""
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("ss"))

    def step(acc, v):
        peak = F.greatest(acc["peak"], v)
        d = (v / peak - 1.0) * 100.0
        return F.struct(peak.alias("peak"), (acc["ss"] + d * d).alias("ss"))

    arr = _window_list(x, n, **k)
    return F.when(arr.isNotNull(), F.aggregate(arr, start, step, lambda a: F.sqrt(a["ss"] / n)))


def bars_since_higher(x, n: int, **k) -> Column:
    """Rows since an earlier value at or above the current one, capped at n, as a share of n."""
    x = col(x)
    order = k.get("order", DATE)
    by = k.get("by", SYMBOL)
    w = ts(by, order).rowsBetween(-n, -1)
    past = F.collect_list(F.coalesce(x, F.lit(float("inf")))).over(w)
    cur = x
    hit = F.array_max(F.transform(past, lambda v, i: F.when(v >= cur, i + 1).otherwise(F.lit(0))))
    return F.when(cur.isNotNull() & (F.size(past) > 0), (F.size(past) - F.coalesce(hit, F.lit(0))) / F.lit(float(n)))


def _hurst_udf(n: int, divisions: tuple[int, ...]):
    """Arrow batches of window arrays to exponents; every step is a whole-batch NumPy operation."""

    @F.pandas_udf(T.DoubleType())
    def run(windows: pd.Series) -> pd.Series:
        out = np.full(len(windows), np.nan)
        have = windows.notna().to_numpy()
        if have.any():
            x = np.stack(windows[have].to_numpy()).astype(float)
            pts = []
            for div in divisions:
                m = n // div
                if m < 4:
                    continue
                sub = x[:, : div * m].reshape(len(x), div, m)
                dev = sub - sub.mean(axis=2, keepdims=True)
                cum = dev.cumsum(axis=2)
                sd = np.sqrt((dev**2).mean(axis=2))
                ok = sd > 1e-10
                rs = np.where(ok, (cum.max(axis=2) - cum.min(axis=2)) / np.where(ok, sd, 1.0), 0.0)
                k = ok.sum(axis=1)
                mean = np.where(k > 0, rs.sum(axis=1) / np.maximum(k, 1), 0.0)
                pts.append((np.log(m), np.where(mean > 0, np.log(np.where(mean > 0, mean, 1.0)), np.nan)))
            lx = np.array([a for a, _ in pts])[None, :]
            ly = np.column_stack([b for _, b in pts])
            seen = np.isfinite(ly)
            c = seen.sum(axis=1)
            y, xx = np.where(seen, ly, 0.0), np.where(seen, lx, 0.0)
            den = c * (xx**2).sum(axis=1) - xx.sum(axis=1) ** 2
            good = (c >= 2) & (np.abs(den) > 1e-10)
            h = (c * (xx * y).sum(axis=1) - xx.sum(axis=1) * y.sum(axis=1)) / np.where(good, den, 1.0)
            out[have] = np.where(good, np.clip(h, 0.0, 1.0), np.nan)
        return pd.Series(out)

    return run


def hurst(df: DataFrame, x: str, out: str, n: int = 60, divisions=(2, 4, 8), **k) -> DataFrame:
    """Rescaled-range exponent: slope of ln(R/S) on ln(length) over splits of the window, clipped to [0,1]."""
    d = df.withColumn("__win", _window_list(x, n, **k)).withColumn("__h", _hurst_udf(n, tuple(divisions))("__win"))
    return d.withColumn(out, F.when(~F.isnan("__h"), F.col("__h"))).drop("__win", "__h")
