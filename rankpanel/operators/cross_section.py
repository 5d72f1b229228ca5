"""Cross-section operators (X-01..X-22): every date is one cross-section of symbols.

Standardisation needs only a handful of numbers per date. They are aggregated (map-side combined) and
joined back, so the panel itself is not shuffled by date; only rank-based steps sort inside a date.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import col
from ..functions.ranking import ordinal_rank, pct_rank, rank01

STD_FLOOR = 1e-10
LOWER, UPPER = 0.025, 0.975


def _stats(df: DataFrame, names: Sequence[str], by: Sequence[str], bounds: bool) -> DataFrame:
    agg = []
    for n in names:
        agg += [F.avg(n).alias(f"{n}__m"), F.stddev_samp(n).alias(f"{n}__s"), F.count(n).alias(f"{n}__n")]
        if bounds:
            agg += [F.percentile(n, LOWER).alias(f"{n}__lo"), F.percentile(n, UPPER).alias(f"{n}__hi")]
    return df.groupBy(*by).agg(*agg)


def zscore(df: DataFrame, names: Sequence[str], winsorise: bool = False, by: Sequence[str] = ("dt",), pass_small: bool = False) -> DataFrame:
    """z-score per cross-section, NULL where the spread vanishes; quantile clip of the z-scores on request.

    A z-score is increasing in the value, so clipping the value at its quantiles first is the same
    thing. `pass_small` leaves groups with fewer than two values (or no spread) unchanged.
    """
    by = list(by)
    d = df.join(_stats(df, names, by, winsorise), by)
    out = []
    for c in df.columns:
        if c not in names:
            out.append(F.col(c))
            continue
        v, m, s = F.col(c), F.col(f"{c}__m"), F.col(f"{c}__s")
        x = F.when(v.isNotNull(), F.greatest(F.col(f"{c}__lo"), F.least(F.col(f"{c}__hi"), v))) if winsorise else v
        z = F.when(s >= STD_FLOOR, (x - m) / s)
        if pass_small:
            z = F.when((F.col(f"{c}__n") >= 2) & (s >= STD_FLOOR), z).otherwise(v)
        out.append(z.alias(c))
    return d.select(*out)


def standardise(df: DataFrame, names: Iterable[str], bounded: Iterable[str]) -> DataFrame:
    """Bounded factors to centred percentage ranks, all others to winsorised z-scores."""
    bounded = set(bounded)
    names = list(names)
    free = [n for n in names if n not in bounded]
    d = zscore(df, free, winsorise=True) if free else df
    ranks = [n for n in names if n in bounded]
    return centred_ranks(d, ranks) if ranks else d


def centred_ranks(df: DataFrame, names: Sequence[str], ids: Sequence[str] = ("dt", "symbol")) -> DataFrame:
    """Every named column to its percentage rank of the date less a half; `ids` name a row.

    All columns are ranked in one sort of narrow rows (id, column, value) and joined back: a window per column would
    carry the whole row through a sort for each of them, and a task would hold them all.
    """
    place = {n: i for i, n in enumerate(names)}
    cells = F.posexplode(F.array(*[F.col(n).cast("double") for n in names])).alias("__c", "__v")
    d = df.select(*ids, cells).where("__v is not null").select(*ids, "__c", pct_rank("__v", [ids[0], "__c"]).alias("__p"))
    d = d.groupBy(*ids).agg(*[(F.max(F.when(F.col("__c") == i, F.col("__p"))) - 0.5).alias(f"__p{i}") for i in place.values()])
    same = reduce(lambda x, y: x & y, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ids])
    out = [F.col(f"r.__p{place[c]}").alias(c) if c in place else F.col(f"l.{c}") for c in df.columns]
    return df.alias("l").join(d.alias("r"), same, "left").select(*out)


def processing_report(df: DataFrame, names: Sequence[str], bounded: Iterable[str]) -> DataFrame:
    """Per factor: nulls before and after, clipped counts, dates without spread."""
    bounded = set(bounded)
    free = [n for n in names if n not in bounded]
    d = df.join(_stats(df, free, ["dt"], True), "dt")
    aggs = []
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    for n in free:
        flat = ~(F.col(f"{n}__s") >= STD_FLOOR) | F.col(f"{n}__s").isNull()
        aggs.append(
            F.struct(
                one(F.col(n).isNull()).alias("nulls_before"),
                one(F.col(n).isNull() | flat).alias("nulls_after"),
                one(~flat & (F.col(n) < F.col(f"{n}__lo"))).alias("clipped_low"),
                one(~flat & (F.col(n) > F.col(f"{n}__hi"))).alias("clipped_high"),
                F.countDistinct(F.when(F.col(f"{n}__s") < STD_FLOOR, F.col("dt"))).alias("flat_dates"),
            ).alias(n)
        )
    wide = d.agg(*aggs)
    return wide.unpivot([], free, "factor", "s").select("factor", "s.*")


def solve_rows(k: int):
    """Vectorised solve of the normal equations of many dates at once."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(xtx: pd.Series, xty: pd.Series) -> pd.Series:
        a = np.array(xtx.tolist(), dtype=float).reshape(-1, k, k)
        b = np.array(xty.tolist(), dtype=float).reshape(-1, k, 1)
        ok = np.abs(np.linalg.det(a)) > 1e-18
        out = np.full((len(a), k), np.nan)
        if ok.any():
            out[ok] = np.linalg.solve(a[ok], b[ok])[:, :, 0]
        return pd.Series([row if good else None for row, good in zip(out, ok)])

    return solve


def residual(df: DataFrame, y: str, xs: Sequence[str], out: str, min_rows: int = 10, by: str = "dt") -> DataFrame:
    """Cross-section least-squares residual of y on the regressors and an intercept.

    The sums of squares and products are aggregated per date around the date's means; only those few
    numbers reach the solver, never the rows of a date.
    """
    ok = F.col(y).isNotNull()
    for x in xs:
        ok = ok & F.col(x).isNotNull()
    d = df.where(ok)
    means = d.groupBy(by).agg(F.count(F.lit(1)).alias("__n"), F.avg(y).alias("__my"), *[F.avg(x).alias(f"__m{i}") for i, x in enumerate(xs)])
    d = d.join(means, by).where(F.col("__n") >= min_rows)
    cx = [F.col(x) - F.col(f"__m{i}") for i, x in enumerate(xs)]
    cy = F.col(y) - F.col("__my")
    k = len(xs)
    sums = d.groupBy(by).agg(
        F.array(*[F.sum(cx[i] * cx[j]) for i in range(k) for j in range(k)]).alias("__xtx"),
        F.array(*[F.sum(cx[i] * cy) for i in range(k)]).alias("__xty"),
    )
    beta = sums.select(by, solve_rows(k)("__xtx", "__xty").alias("__b")).where("__b is not null")
    d = d.join(beta, by)
    fit = sum((F.col("__b")[i] * cx[i] for i in range(k)), F.lit(0.0))
    return d.withColumn(out, cy - fit).drop("__n", "__my", "__b", *[f"__m{i}" for i in range(k)])


def composite(long: DataFrame, coef: DataFrame, keys: Sequence[str] = ("combo",)) -> DataFrame:
    """Score of each combo: sum of coef x value over the factors present; nothing or exactly 0 is not selectable."""
    d = long.join(coef, "factor").groupBy(*keys, "dt", "symbol").agg(F.sum(F.col("coef") * F.col("value")).alias("s"))
    return d.select(*keys, "dt", "symbol", F.when(F.col("s") != 0, F.col("s")).alias("score"))


def weighted_signal(long: DataFrame, weights: DataFrame, keys: Sequence[str] = ("combo",)) -> DataFrame:
    """Weighted mean over the factors present, weights re-normalised to those."""
    d = long.join(weights, "factor").groupBy(*keys, "dt", "symbol").agg(
        F.sum(F.col("weight") * F.col("value")).alias("n"), F.sum("weight").alias("d")
    )
    return d.select(*keys, "dt", "symbol", F.when(F.col("d") > 0, F.col("n") / F.col("d")).alias("signal"))


def veto(value, threshold: float, penalty: float, by="dt", high: bool = True, min_valid: int = 5) -> Column:
    v = col(value)
    r = rank01(v, by)
    enough = F.count(v).over(W.partitionBy(by)) >= min_valid
    hit = (r >= threshold) if high else (r <= threshold)
    return F.when(enough & v.isNotNull() & hit, F.lit(penalty)).otherwise(F.lit(0.0))


def market_proxy(panel: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Close of the first named symbol that trades on the date, else the cross-section mean."""
    picks = [F.max(F.when(F.col("symbol") == s, F.col("close"))) for s in symbols]
    return panel.groupBy("dt").agg(F.coalesce(*picks, F.avg("close")).alias("proxy"))


def untradable(limit: float = 0.095) -> Column:
    """Limit-up or no volume: needs `r`, `volume`, `traded`."""
    return F.coalesce(F.col("r") > limit, F.lit(False)) | ~F.col("traded") | (F.coalesce("volume", F.lit(0.0)) <= 0)


def rank_monitor(scores: DataFrame, subset: Column, top: Sequence[int] = (2, 10)) -> DataFrame:
    """How often symbols of a subset reach the top of the ranking, and where they usually stand."""
    d = scores.where("score is not null").withColumn("pos", ordinal_rank("score", "dt", descending=True)).withColumn("r01", rank01("score", "dt"))
    aggs = [F.avg((F.col("pos") <= k).cast("double")).alias(f"top{k}_rate") for k in top]
    return d.where(subset).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), *aggs, F.avg("r01").alias("rank_mean"), F.median("r01").alias("rank_median"),
        F.percentile("r01", 0.1).alias("rank_p10"), F.percentile("r01", 0.9).alias("rank_p90"),
    )


def block_correlations(returns: DataFrame, period: str, block: int = 1000) -> DataFrame:
    """Pairwise-complete correlations of all symbol pairs per period, by blocks of symbols.

    A task holds two blocks of at most about `block` series, whatever the size of the universe.
    """
    n = returns.select("symbol").distinct().count()
    blocks = max(1, -(-n // block))
    d = returns.select(period, "symbol", "dt", "r").withColumn("a", F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int"))
    d = d.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    d = d.select(period, "symbol", "dt", "r", "a", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    ptype = dict(returns.dtypes)[period]

    def corr(key, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key[1], key[2]
        wide = lambda blk: pdf[pdf["a"] == blk].pivot(index="dt", columns="symbol", values="r")
        left, right = wide(i), wide(j)
        dates = left.index.union(right.index)
        left, right = left.reindex(dates), right.reindex(dates)
        x, y = left.to_numpy(dtype=float), right.to_numpy(dtype=float)
        mx, my = np.isfinite(x), np.isfinite(y)
        x0, y0 = np.where(mx, x, 0.0), np.where(my, y, 0.0)
        m, n = mx.astype(float), my.astype(float)
        cnt = m.T @ n
        with np.errstate(all="ignore"):
            ex, ey = (x0.T @ n) / cnt, (m.T @ y0) / cnt
            cov = (x0.T @ y0) / cnt - ex * ey
            c = cov / np.sqrt(((x0**2).T @ n) / cnt - ex**2) / np.sqrt((m.T @ (y0**2)) / cnt - ey**2)
        rows, cols = np.nonzero(np.isfinite(c) & (cnt >= 2))
        out = pd.DataFrame({"a": np.array(left.columns)[rows], "b": np.array(right.columns)[cols], "c": c[rows, cols]})
        out = out[out["a"] < out["b"]] if i == j else out
        out.insert(0, period, key[0])
        return out

    return d.groupBy(period, "i", "j").applyInPandas(corr, f"{period} {ptype}, a string, b string, c double")


def mean_pairwise(returns: DataFrame, period: str) -> DataFrame:
    return block_correlations(returns, period).groupBy(period).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("c").alias("mean_corr"), F.median("c").alias("median_corr")
    )
