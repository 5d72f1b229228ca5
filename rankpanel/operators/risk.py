"""Performance and risk of return series (R-01..R-24). A series is (combo, dt, bar, r); equity is eq."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import compound, corr, ratio

PER_YEAR = 252.0


def _w(keys, order="dt"):
    return W.partitionBy(*keys).orderBy(order)


def _upto(keys, order="dt"):
    return _w(keys, order).rowsBetween(W.unboundedPreceding, 0)


def equity(d: DataFrame, keys: Sequence[str] = ("combo",), r: str = "r", order: str = "dt") -> DataFrame:
    return d.withColumn("eq", F.exp(F.sum(F.log1p(r)).over(_upto(keys, order))))


def drawdown(d: DataFrame, keys: Sequence[str] = ("combo",), order: str = "dt") -> DataFrame:
    return d.withColumn("dd", F.col("eq") / F.max("eq").over(_upto(keys, order)) - 1)


def window_metrics(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return, drawdown, Sharpe and Calmar of an equity curve inside each group."""
    keys = list(keys)
    d = drawdown(d, keys).withColumn("ret", ratio("eq", F.lag("eq").over(_w(keys))) - 1)
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.max_by("eq", "dt") / F.min_by("eq", "dt") - 1).alias("total_return"),
        F.min("dd").alias("max_drawdown"),
        F.avg("ret").alias("m"),
        F.stddev_samp("ret").alias("s"),
        F.count("ret").alias("k"),
    )
    ann = F.pow(1 + F.col("total_return"), F.lit(PER_YEAR) / F.when(F.col("k") > 0, F.col("k"))) - 1
    return g.select(
        *keys, "n", "total_return", "max_drawdown",
        F.when(F.col("s") > 1e-12, F.col("m") / F.col("s") * math.sqrt(PER_YEAR)).alias("sharpe"),
        F.when(F.col("max_drawdown") < -1e-10, ann / F.abs("max_drawdown")).alias("calmar"),
    )


def trade_statistics(d: DataFrame, keys: Sequence[str] = ("combo",), per_year: float = PER_YEAR) -> DataFrame:
    """Moments (population), win rate, profit factor, payoff, expectancy, annualised figures."""
    r = F.col("r")
    win, loss = F.when(r > 0, r), F.when(r <= 0, r)
    g = d.groupBy(*keys).agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurt"),
        F.max(r).alias("best"), F.min(r).alias("worst"), (F.count(win) / F.count(r)).alias("win_rate"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"),
        F.sum(win).alias("w"), F.sum(loss).alias("l"),
    )
    g = g.withColumn("profit_factor", F.when(F.col("l") != 0, F.abs(F.col("w") / F.col("l"))))
    g = g.withColumn("payoff", F.when(F.col("avg_loss") != 0, F.abs(F.col("avg_win") / F.col("avg_loss"))))
    g = g.withColumn("expectancy", F.col("win_rate") * F.col("avg_win") + (1 - F.col("win_rate")) * F.col("avg_loss"))
    return g.withColumn("annual_vol", F.col("std") * math.sqrt(per_year)).drop("w", "l")


def concentration(d: DataFrame, keys: Sequence[str] = ("combo",)) -> DataFrame:
    """Share of the best 20 % of periods and the Gini coefficient of absolute returns."""
    keys = list(keys)
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    d = d.select(
        *keys, "r", n.alias("n"),
        F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("r"), "dt")).alias("top"),
        F.row_number().over(W.partitionBy(*keys).orderBy(F.abs("r"), "dt")).alias("i"),
    )
    a = F.abs("r")
    return d.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.try_divide(F.sum(F.when(F.col("top") <= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.2)), F.col("r"))), F.sum("r")).alias("top20_share"),
        F.try_divide(F.sum((2 * F.col("i") - F.col("n") - 1) * a), F.first("n") * F.sum(a)).alias("gini"),
    )


def episodes(d: DataFrame, threshold: float = -0.05, keys: Sequence[str] = ("combo",)) -> DataFrame:
    """Drawdown episodes: they begin when the drawdown passes the threshold and end at the next peak."""
    keys = list(keys)
    d = drawdown(d, keys)
    peak = (F.col("dd") >= 0).cast("int")
    d = d.withColumn("run", F.sum(peak).over(_upto(keys)))  # rows between two peaks share a run
    deep = d.withColumn("first", F.min(F.when(F.col("dd") < threshold, F.col("dt"))).over(W.partitionBy(*keys, "run")))
    deep = deep.where(F.col("first").isNotNull() & (F.col("dt") >= F.col("first")) & (F.col("dd") < 0))
    e = deep.groupBy(*keys, "run").agg(
        F.min("dt").alias("start_dt"), F.min_by("dt", F.struct("dd", "dt")).alias("trough_dt"), F.min("dd").alias("depth"), F.count(F.lit(1)).alias("bars"), F.max("bar").alias("last_bar")
    )
    ends = d.where("dd >= 0").select(*keys, (F.col("run") - 1).alias("run"), F.col("dt").alias("end_dt"))
    return e.join(ends, [*keys, "run"], "left").select(*keys, "start_dt", "trough_dt", "end_dt", "depth", "bars")


def block_bootstrap(d: DataFrame, n_boot: int, block: int, seed: int, size: int | None = None, keys: Sequence[str] = ("combo",)) -> DataFrame:
    """Resampled series in blocks: starts come from a hash of (seed, draw, block), so a lost task redraws the same.

    One row per (draw, block) is generated in parallel and joined to the series by position; each draw
    is then one group of `n` rows.
    """
    keys = list(keys)
    pos = d.withColumn("pos", F.row_number().over(_w(keys)) - 1).select(*keys, "pos", "r")
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    draws = n.withColumn("len", F.least(F.lit(size), F.col("n")) if size else F.col("n")).withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    draws = draws.withColumn("blk", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("len") / block) - 1).cast("int"))))
    # a series shorter than a block wraps around, so its draws differ too
    start = F.pmod(F.xxhash64(F.lit(seed), "boot", "blk"), F.when(F.col("n") < block, F.col("n")).otherwise(F.col("n") - block + 1))
    rows = draws.withColumn("start", start).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    rows = rows.select(*keys, "boot", "len", F.pmod(F.col("start") + F.col("k"), F.col("n")).cast("int").alias("pos"), (F.col("blk") * block + F.col("k")).alias("dt")).where(F.col("dt") < F.col("len"))
    s = equity(rows.join(pos, [*keys, "pos"]), [*keys, "boot"])
    s = drawdown(s, [*keys, "boot"])
    return s.groupBy(*keys, "boot").agg(
        compound("r").alias("total_return"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.min("dd").alias("max_drawdown"), F.count(F.lit(1)).alias("n")
    ).withColumn("sharpe", F.try_divide(F.pow(F.col("total_return") + 1, PER_YEAR / F.col("n")) - 1, F.col("s") * math.sqrt(PER_YEAR)))  # annual return over annual volatility


def pair_risk(a: DataFrame, b: DataFrame, market: DataFrame) -> DataFrame:
    """Two strategies side by side: drawdown synchrony, joint tails, co-crash ratio, market-conditional loss, residual correlation."""
    x = drawdown(equity(a.withColumn("k", F.lit(1)), ["k"]), ["k"]).select("dt", F.col("r").alias("ra"), F.col("dd").alias("da"))
    y = drawdown(equity(b.withColumn("k", F.lit(1)), ["k"]), ["k"]).select("dt", F.col("r").alias("rb"), F.col("dd").alias("db"))
    d = x.join(y, "dt").join(market.select("dt", F.col("r").alias("rm")), "dt")
    q = d.agg(
        *[F.percentile(c, 0.1).alias(f"q_{c}") for c in ("ra", "rb", "rm")], *[F.regr_slope(c, "rm").alias(f"b_{c}") for c in ("ra", "rb")],
        *[F.regr_intercept(c, "rm").alias(f"i_{c}") for c in ("ra", "rb")],
    )
    d = d.crossJoin(F.broadcast(q))  # one row of cut points and betas
    ea = F.col("ra") - F.col("b_ra") * F.col("rm") - F.col("i_ra")
    eb = F.col("rb") - F.col("b_rb") * F.col("rm") - F.col("i_rb")
    ina, inb = F.col("da") < -0.02, F.col("db") < -0.02
    la, lb, lm = F.col("ra") <= F.col("q_ra"), F.col("rb") <= F.col("q_rb"), F.col("rm") <= F.col("q_rm")
    both_down = (F.col("ra") < 0) & (F.col("rb") < 0)
    c = lambda x: F.sum(x.cast("bigint"))
    p = lambda x: F.avg(x.cast("double"))
    g = d.agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(c(ina & inb).cast("double"), c(ina | inb).cast("double")).alias("dd_sync"), p(la & lb).alias("joint_left"),
        F.try_divide(p(la & lb), p(la) * p(lb)).alias("co_crash_ratio"), p(both_down).alias("joint_loss"), c(lm).alias("mkt_left_n"), c(lm & both_down).alias("mkt_left_k"),
        corr("ra", "rb").alias("full_corr"), corr(ea, eb).alias("residual_corr"),
    )
    ph, n, z2 = F.try_divide(F.col("mkt_left_k").cast("double"), F.col("mkt_left_n").cast("double")), F.col("mkt_left_n"), 1.96**2
    wilson = (ph + z2 / (2 * n) + 1.96 * F.sqrt(ph * (1 - ph) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return g.withColumn("loss_given_mkt_left", ph).withColumn("wilson_upper", wilson)


def overlapping_windows(d: DataFrame, size: int, step: int, keys: Sequence[str] = ("combo",)) -> DataFrame:
    """Adds `win`: each bar once per window that covers it (window k covers bars [k*step, k*step+size))."""
    last = d.agg(F.max("i")).first()[0]  # one number
    top = (last + 1 - size) // step
    i = F.col("i")
    lo = F.greatest(F.lit(0), F.ceil((i - size + 1) / F.lit(step)).cast("int"))
    hi = F.least(F.lit(top), F.floor(i / F.lit(step)).cast("int"))
    return d.where(lo <= hi).withColumn("win", F.explode(F.sequence(lo, hi)))
