"""Predictive power and factor quality (A-01..A-30) on the long factor table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import corr, ratio
from ..functions.ranking import avg_rank, ordinal_rank, pct_rank
from ..functions.student import t_two_sided

MIN_ROWS = 5
MIN_OBS = 30


def rank_ic(long: DataFrame, ret: str, keys: Sequence[str] = ("factor", "dt"), min_rows: int = MIN_ROWS, value: str = "value") -> DataFrame:
    """Rank correlation per group on rows where both sides are present, average ranks.

    The ranks and the correlation share one exchange on the group keys.
    """
    keys = list(keys)
    d = long.where(F.col(ret).isNotNull() & F.col(value).isNotNull())
    d = d.select(*keys, avg_rank(value, keys).alias("a"), avg_rank(ret, keys).alias("b"))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        corr("a", "b").alias("c"),
        ((F.min("a") < F.max("a")) & (F.min("b") < F.max("b"))).alias("moves"),
    )
    return g.where((F.col("n") >= min_rows) & F.col("moves")).select(*keys, F.round("c", 12).alias("ic"), "n")


def rank_ic_legacy(long: DataFrame, ret: str, keys: Sequence[str] = ("factor", "dt"), min_rows: int = MIN_ROWS) -> DataFrame:
    """Variant that ranks each side before the joint mask and takes each side's norm over its own rows."""
    keys = list(keys)
    d = long.select(*keys, avg_rank("value", keys).alias("a"), avg_rank(ret, keys).alias("b"))
    w = W.partitionBy(*keys)
    d = d.select(*keys, (F.col("a") - F.avg("a").over(w)).alias("a"), (F.col("b") - F.avg("b").over(w)).alias("b"))
    g = d.groupBy(*keys).agg(
        F.sum(F.col("a") * F.col("b")).alias("ab"),
        F.sum(F.col("a") * F.col("a")).alias("aa"),
        F.sum(F.col("b") * F.col("b")).alias("bb"),
        F.count(F.col("a") + F.col("b")).alias("n"),
    )
    g = g.where((F.col("n") >= min_rows) & (F.col("aa") * F.col("bb") > 0))
    return g.select(*keys, F.round(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")), 12).alias("ic"), "n")


def ordinal_ic(long: DataFrame, ret: str, keys: Sequence[str] = ("factor", "dt"), min_rows: int = 3, value: str = "value") -> DataFrame:
    """Rank correlation with ordinal ranks (ties by symbol)."""
    keys = list(keys)
    d = long.where(F.col(ret).isNotNull() & F.col(value).isNotNull())
    d = d.select(*keys, ordinal_rank(value, keys).alias("a"), ordinal_rank(ret, keys).alias("b"))
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), corr("a", "b").alias("c"))
    return g.where(F.col("n") >= min_rows).select(*keys, F.round("c", 12).alias("ic"), "n")


def summarise(ic: DataFrame, keys: Sequence[str] = ("factor",), min_obs: int = MIN_OBS, value: str = "ic") -> DataFrame:
    """Mean, std, ratio, t, two-sided p, hit rate and count of a daily statistic."""
    v = F.col(value)
    g = ic.groupBy(*keys).agg(
        F.avg(v).alias("mean_ic"), F.stddev_samp(v).alias("std_ic"), F.avg((v > 0).cast("double")).alias("hit_rate"), F.count(v).alias("n_obs")
    ).where(F.col("n_obs") >= min_obs)
    live = F.col("std_ic") > 1e-10
    g = g.withColumn("ic_ir", F.when(live, F.col("mean_ic") / F.col("std_ic")).otherwise(F.lit(0.0)))
    g = g.withColumn("t_stat", F.when(live, F.col("mean_ic") / (F.col("std_ic") / F.sqrt("n_obs"))).otherwise(F.lit(0.0)))
    return g.withColumn("p_value", F.when(live, t_two_sided("t_stat", F.col("n_obs") - 1)).otherwise(F.lit(1.0)))


def spearman3(a: Column, b: Column, c: Column) -> Column:
    """Rank correlation of three values with 1, 2, 3 (average ranks)."""
    half = lambda x, y: F.when(x > y, 1.0).when(x == y, 0.5).otherwise(0.0)
    ra, rb, rc = half(a, b) + half(a, c), half(b, a) + half(b, c), half(c, a) + half(c, b)
    ss = (ra - 1) * (ra - 1) + (rb - 1) * (rb - 1) + (rc - 1) * (rc - 1)
    return F.when(ss > 0, F.try_divide(rc - ra, F.sqrt(2 * ss)))


def terciles(long: DataFrame, ret: str, min_rows: int = 6) -> DataFrame:
    """Mean forward return of the bottom, middle and top third by rank, and how monotone they are."""
    keys = ["factor", "dt"]
    d = long.withColumn("p", pct_rank("value", keys)).where(F.col(ret).isNotNull())
    third = F.when(F.col("p") < 1 / 3, 1).when(F.col("p") < 2 / 3, 2).otherwise(3)
    mean = lambda k: F.avg(F.when(third == k, F.col(ret)))
    daily = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[mean(k).alias(f"m{k}") for k in (1, 2, 3)]).where(F.col("n") >= min_rows)
    g = daily.groupBy("factor").agg(*[F.coalesce(F.avg(f"m{k}"), F.lit(0.0)).alias(f"tercile_{k}") for k in (1, 2, 3)])
    mono = F.coalesce(F.abs(spearman3(F.col("tercile_1"), F.col("tercile_2"), F.col("tercile_3"))), F.lit(0.0))
    return g.withColumn("monotonicity", mono)


def layered(long: DataFrame, ret: str, groups: int = 5, min_rows: int | None = None) -> DataFrame:
    """Equal-width quantile groups per date by rank, their mean return over time, and the long-short spread."""
    keys = ["factor", "dt"]
    d = long.where(F.col(ret).isNotNull()).withColumn("p", pct_rank("value", keys)).withColumn("cnt", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    d = d.where(F.col("cnt") >= (min_rows or groups)).withColumn("g", F.least(F.lit(groups), F.ceil(F.col("p") * groups)).cast("int"))
    daily = d.groupBy(*keys).agg(*[F.avg(F.when(F.col("g") == k, F.col(ret))).alias(f"g{k}") for k in range(1, groups + 1)])
    out = daily.groupBy("factor").agg(*[F.avg(f"g{k}").alias(f"group_{k}") for k in range(1, groups + 1)])
    return out.withColumn("long_short", F.col(f"group_{groups}") - F.col("group_1"))


def quartile_spread(long: DataFrame, ret: str, min_rows: int = 8) -> DataFrame:
    keys = ["factor", "dt"]
    d = long.where(F.col(ret).isNotNull())
    cut = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("value", 0.25).alias("lo"), F.percentile("value", 0.75).alias("hi")).where(F.col("n") >= min_rows)
    d = d.join(cut, keys)
    g = d.groupBy(*keys).agg(
        F.avg(F.when(F.col("value") >= F.col("hi"), F.col(ret))).alias("top"), F.avg(F.when(F.col("value") <= F.col("lo"), F.col(ret))).alias("bottom")
    )
    return g.select(*keys, (F.col("top") - F.col("bottom")).alias("spread"))


def rolling_mean_ic(ic: DataFrame, window: int = 120) -> DataFrame:
    w = W.partitionBy("factor").orderBy("dt").rowsBetween(-(window - 1), 0)
    d = ic.select("factor", F.when(F.count("ic").over(w) == window, F.avg("ic").over(w)).alias("m")).where("m is not null")
    return d.groupBy("factor").agg(
        F.avg("m").alias("rolling_ic_mean"), F.avg((F.col("m") > 0).cast("double")).alias("rolling_ic_positive_rate"), F.count("m").alias("n")
    )


def decay(long: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Mean statistic per horizon in one long table keyed by horizon, and the strongest one."""
    value = long.select("factor", "dt", "symbol", "value", F.explode(F.array(*[
        F.struct(F.lit(h).alias("h"), F.col(f"fwd{h}").alias("fwd")) for h in horizons
    ])).alias("s")).select("factor", "dt", "value", "s.h", "s.fwd")
    m = rank_ic(value, "fwd", ("factor", "h", "dt")).groupBy("factor", "h").agg(F.avg("ic").alias("m"))
    g = m.groupBy("factor").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("h", "m")))).alias("by_h"),
        F.max_by("h", F.struct(F.round(F.abs("m"), 10), -F.col("h"))).alias("best_horizon"),
    )
    return g.select("factor", *[F.coalesce(F.col("by_h")[h], F.lit(0.0)).alias(f"ic_{h}") for h in horizons], "best_horizon")


def rank_autocorrelation(long: DataFrame, lag: int, min_pairs: int = 100) -> DataFrame:
    """Pooled rank correlation of today's cross-section rank with the rank `lag` bars ago."""
    d = long.withColumn("p", pct_rank("value", ["factor", "dt"]))
    past = d.select("factor", "symbol", (F.col("bar") + lag).alias("bar"), F.col("p").alias("q"))
    d = d.join(past, ["factor", "symbol", "bar"]).select("factor", "p", "q")
    return pooled_rank_corr(d, "p", "q", ["factor"], min_pairs).withColumnRenamed("corr", "rank_autocorr")


def pooled_rank_corr(d: DataFrame, x: str, y: str, keys: Sequence[str], min_pairs: int = 1) -> DataFrame:
    """Rank correlation over all rows of a key.

    Average ranks depend on value counts only. The values are counted first (map-side combined), the
    window then runs over distinct values, and the ranks are joined back.
    """
    keys = list(keys)

    def rank_table(c: str, out: str) -> DataFrame:
        n = d.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("__c"))
        w = W.partitionBy(*keys).orderBy(c).rowsBetween(W.unboundedPreceding, 0)
        return n.select(*keys, c, (F.sum("__c").over(w) - (F.col("__c") - 1) / F.lit(2.0)).alias(out))

    r = d.join(rank_table(x, "__a"), [*keys, x]).join(rank_table(y, "__b"), [*keys, y])
    g = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), corr("__a", "__b").alias("corr"))
    return g.where(F.col("n_pairs") >= min_pairs)


def pair_columns(names: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def factor_correlations(wide: DataFrame, names: Sequence[str], min_rows: int = MIN_ROWS) -> DataFrame:
    """Mean daily rank correlation of every factor pair, from the wide table.

    One aggregate per date holds one correlation per pair of columns, so no row pairs are produced.
    Each factor is ranked once per date over its own rows; pairs then use the rows both share.
    """
    pairs = pair_columns(names)
    ranked = wide.select("dt", *[F.when(F.col(n).isNotNull(), avg_rank(n, "dt")).alias(n) for n in names])
    agg = []
    for a, b in pairs:
        ok = F.col(a).isNotNull() & F.col(b).isNotNull()
        agg.append(F.when(F.count(F.when(ok, 1)) >= min_rows, corr(F.when(ok, F.col(a)), F.when(ok, F.col(b)))).alias(f"{a}|{b}"))
    daily = ranked.groupBy("dt").agg(*agg)
    cols = [f"{a}|{b}" for a, b in pairs]
    m = daily.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in cols])
    long = m.unpivot([], [F.col(f"`{c}`") for c in cols], "pair", "corr")
    return long.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "corr")


def two_sided_trains(ic: DataFrame, split: Column) -> DataFrame:
    """Train and holdout summary of a daily statistic in one pass."""
    out = []
    for name, cond in (("train", ~split), ("ho", split)):
        v = F.when(cond, F.col("ic"))
        out += [F.avg(v).alias(f"{name}_ic"), F.stddev_samp(v).alias(f"{name}_std"), F.count(v).alias(f"{name}_n"), F.avg((v > 0).cast("double")).alias(f"{name}_hit")]
    g = ic.groupBy("factor").agg(*out)
    for name in ("train", "ho"):
        g = g.withColumn(f"{name}_icir", F.when(F.col(f"{name}_std") > 1e-10, F.col(f"{name}_ic") / F.col(f"{name}_std")))
    return g


MIN_IC, MIN_ICIR = 0.02, 0.1


def directions(split: DataFrame) -> DataFrame:
    """Direction, whether it holds out of sample, whether flipping the factor is advised, and the effect."""
    tr, ho = F.col("train_ic"), F.col("ho_ic")
    weak = (F.abs(tr) < MIN_IC) | (F.abs(ho) < MIN_IC)
    direction = F.when(F.abs(tr) < MIN_IC, "neutral").when(tr > 0, "positive").otherwise("negative")
    d = split.withColumn("direction", direction).withColumn("direction_stable", F.when(weak, True).otherwise(tr * ho > 0))
    strong = (F.abs(tr) >= MIN_IC) & (F.abs(F.col("train_icir")) >= MIN_ICIR) & (F.abs(ho) >= MIN_IC)
    d = d.withColumn("flip_recommended", strong & (F.col("direction") == "negative") & F.col("direction_stable"))
    return d.withColumn("flipped_ho_ic", F.when(tr < 0, -ho).otherwise(ho))


def coverage(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Null rate and the least and mean number of values per date."""
    daily = wide.groupBy("dt").agg(F.count(F.lit(1)).alias("__all"), *[F.count(n).alias(n) for n in names])
    d = daily.unpivot(["__all"], list(names), "factor", "n")
    return d.groupBy("factor").agg(
        (1 - F.sum("n") / F.sum("__all")).alias("null_rate"), F.min("n").alias("min_valid"), F.avg("n").alias("mean_valid")
    )


def quality_score(d: DataFrame) -> DataFrame:
    """Points for significance, monotonicity, stability, low turnover and direction; and the pass rule."""
    pts = lambda cond, p: F.when(cond, F.lit(p)).otherwise(F.lit(0.0))
    p = F.col("p_value")
    good = F.when(F.col("direction") == "high_is_good", F.col("mean_ic") > 0).when(F.col("direction") == "low_is_good", F.col("mean_ic") < 0).otherwise(F.lit(True))
    score = (
        F.when(p < 0.01, 2.0).when(p < 0.05, 1.0).otherwise(0.0)
        + pts(F.col("monotonicity") >= 0.8, 1.0)
        + pts(F.coalesce(F.col("rolling_ic_positive_rate"), F.lit(0.0)) > 0.55, 1.0)
        + pts(F.coalesce(F.col("rank_autocorr"), F.lit(0.0)) > 0.7, 0.5)
        + pts(good, 1.0)
        - pts(~F.col("production_ready"), 3.0)
    )
    d = d.withColumn("quality_score", score)
    return d.withColumn("passed", (F.col("quality_score") >= 2.0) & (F.col("null_rate") <= 0.30))


def topk_precision(long: DataFrame, ret: str, k: int = 2, hit: int = 5, boundary: int = 10, min_rows: int = 10) -> DataFrame:
    """Overlap of the factor's best with the actual best, hit rate, and the rank correlation inside the factor's top."""
    keys = ["factor", "dt"]
    d = long.where(F.col(ret).isNotNull()).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*keys))).where(F.col("n") >= max(boundary, min_rows))
    d = d.withColumn("pf", ordinal_rank("value", keys, descending=True)).withColumn("pr", ordinal_rank(ret, keys, descending=True))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    daily = d.groupBy(*keys).agg(
        (one((F.col("pf") <= k) & (F.col("pr") <= k)) / k).alias("precision"),
        (one((F.col("pf") <= k) & (F.col("pr") <= hit)) > 0).cast("double").alias("hit"),
    )
    inside = rank_ic(d.where(F.col("pf") <= boundary), ret, keys).groupBy("factor").agg(F.avg("ic").alias("boundary_ic"))
    g = daily.groupBy("factor").agg(F.avg("precision").alias("top_precision"), F.avg("hit").alias("top_hit_rate"), F.count(F.lit(1)).alias("n_dates"))
    return g.join(inside, "factor", "left")


def rank_stability(long: DataFrame, freq: int, k: int = 2) -> DataFrame:
    """On rebalance bars: rank autocorrelation, share of the top that stays, volatility of the relative rank."""
    keys = ["factor", "bar"]
    d = long.where(F.col("bar") % freq == 0).select("factor", "symbol", "bar", "value")
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    d = d.select("factor", "symbol", "bar", avg_rank("value", keys).alias("rk"), ordinal_rank("value", keys, descending=True).alias("pos"), n.alias("n"))
    d = d.withColumn("r01", F.when(F.col("n") > 1, (F.col("rk") - 1) / (F.col("n") - 1)))
    nxt = d.select("factor", "symbol", (F.col("bar") - freq).alias("bar"), F.col("rk").alias("rk2"), F.col("pos").alias("pos2"))
    pairs = d.join(nxt, ["factor", "symbol", "bar"]).select("factor", "bar", "rk", "rk2", "pos", "pos2")
    corr = rank_ic(pairs, "rk2", keys, 4, "rk").groupBy("factor").agg(F.avg("ic").alias("rank_autocorr"))
    stay = pairs.groupBy(*keys).agg((F.sum(F.when((F.col("pos") <= k) & (F.col("pos2") <= k), 1).otherwise(0)) / k).alias("s"))
    stay = stay.groupBy("factor").agg(F.avg("s").alias("top_persistence"))
    vol = d.groupBy("factor", "symbol").agg(F.stddev_pop("r01").alias("v")).groupBy("factor").agg(F.avg("v").alias("rank_volatility"))
    return corr.join(stay, "factor").join(vol, "factor")


def window_stability(ic: DataFrame, bars: DataFrame, window: int = 180, step: int = 60, limits=(0.0, 0.2, 0.5)) -> DataFrame:
    """Mean statistic per sliding window of bars, then its moments across windows and the stability verdict."""
    total = bars.agg((F.max("bar") + 1).alias("__t"))
    d = ic.join(bars, "dt").crossJoin(F.broadcast(total))  # one row
    first = F.greatest(F.lit(0), F.ceil((F.col("bar") - window + 1) / F.lit(step)).cast("int"))
    last = F.least(F.floor(F.col("bar") / F.lit(step)), F.floor((F.col("__t") - window - 1) / F.lit(step))).cast("int")
    d = d.where(first <= last).select("factor", "ic", F.explode(F.sequence(first, last)).alias("win"))
    w = d.groupBy("factor", "win").agg(F.avg("ic").alias("m"))
    g = w.groupBy("factor").agg(
        F.count(F.lit(1)).alias("windows"), F.avg("m").alias("ic_mean"), F.stddev_pop("m").alias("ic_std"), F.skewness("m").alias("ic_skew"),
        F.avg((F.col("m") > 0).cast("double")).alias("positive_rate"),
    ).where("windows >= 3")
    g = g.withColumn("stability_score", 0.4 * F.col("ic_mean") + 0.3 * F.col("positive_rate") - 0.3 * F.col("ic_std"))
    return g.withColumn("is_stable", (F.col("ic_mean") >= limits[0]) & (F.col("ic_std") <= limits[1]) & (F.col("positive_rate") >= limits[2]))


def time_folds(ic: DataFrame, bars: DataFrame, folds: int = 3, floor: float = 0.02) -> DataFrame:
    """Each fold is the test set once; all train and test means must agree in sign beyond the floor."""
    total = bars.agg((F.max("bar") + 1).alias("__t"))
    size = F.floor(F.col("__t") / folds)
    d = ic.join(bars, "dt").crossJoin(F.broadcast(total)).withColumn("fold", F.least(F.floor(F.col("bar") / size), F.lit(folds - 1)).cast("int"))
    cols = []
    for k in range(folds):
        cols += [F.avg(F.when(F.col("fold") != k, F.col("ic"))).alias(f"train_{k}"), F.avg(F.when(F.col("fold") == k, F.col("ic"))).alias(f"test_{k}")]
    g = d.groupBy("factor").agg(*cols)
    every = [F.col(f"{s}_{k}") for s in ("train", "test") for k in range(folds)]
    up = down = F.lit(True)
    for c in every:
        up, down = up & F.coalesce(c > floor, F.lit(True)), down & F.coalesce(c < -floor, F.lit(True))
    return g.withColumn("cv_passed", up | down)


def max_correlation(wide: DataFrame, candidates: Sequence[str], active: Sequence[str]) -> DataFrame:
    """Largest absolute mean daily rank correlation with the active set, itself excluded; missing takes the middle rank."""
    names = sorted(set(candidates) | set(active))
    n = F.count(F.lit(1)).over(W.partitionBy("dt"))
    r = wide.select("dt", *[F.coalesce(avg_rank(c, "dt"), (n + 1) / F.lit(2.0)).alias(c) for c in names])
    flat = lambda c: F.min(c) == F.max(c)
    pairs = [(c, a) for c in names for a in active if c != a]
    daily = r.groupBy("dt").agg(*[F.when(flat(c) | flat(a), F.lit(0.0)).otherwise(corr(c, a)).alias(f"{c}|{a}") for c, a in pairs])
    m = daily.agg(*[F.abs(F.avg(F.col(f"`{c}|{a}`"))).alias(f"{c}|{a}") for c, a in pairs])
    best = [F.greatest(*[F.col(f"`{c}|{a}`") for a in active if a != c], F.lit(0.0)).alias(c) for c in names]
    return m.select(*best).unpivot([], names, "factor", "max_abs_corr")


def eigen_shares(k: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def shares(windows: pd.Series) -> pd.Series:
        out = []
        centre = np.eye(k) - 1.0 / k
        for rows in windows:
            g = np.zeros((k, k))
            for i, r in enumerate(rows):
                for lag in range(i + 1):
                    g[i, i - lag] = g[i - lag, i] = r[lag]
            ev = np.sort(np.linalg.eigvalsh(centre @ g @ centre))[::-1]
            tot = ev[ev > 0].sum()
            out.append([float(ev[0] / tot), float(ev[1] / tot)] if tot > 1e-18 else None)
        return pd.Series(out)

    return shares


def principal_shares(returns: DataFrame, window: int = 60) -> DataFrame:
    """Share of return variance on the first two principal components, rolling.

    The covariance over symbols has the same non-zero eigenvalues as the window x window matrix of
    products between dates. Those products are sums over symbols, aggregated per date with map-side
    combining; only `window` numbers per date reach the eigenvalue step, however many symbols exist.
    """
    base = returns.select("symbol", "dt", F.coalesce("r", F.lit(0.0)).alias("r"))
    w = W.partitionBy("symbol").orderBy("dt")
    d = base.select("dt", *[(F.col("r") * F.coalesce(F.lag("r", k).over(w), F.lit(0.0))).alias(f"p{k}") for k in range(window)])
    g = d.groupBy("dt").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(window)])
    g = g.select("dt", F.array(*[F.col(f"p{k}") for k in range(window)]).alias("g"), F.lit("m").alias("series"))
    fr = W.partitionBy("series").orderBy("dt").rowsBetween(-(window - 1), 0)
    g = g.select("dt", F.count(F.lit(1)).over(fr).alias("n"), F.collect_list("g").over(fr).alias("rows")).where(F.col("n") == window)
    s = g.select("dt", eigen_shares(window)("rows").alias("s")).where("s is not null")
    return s.select("dt", F.col("s")[0].alias("pc1"), F.col("s")[1].alias("pc2"))
