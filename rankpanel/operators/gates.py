"""Exposure gates, timing and schedule (G-01..G-07, P-01, P-02): one row per date, a few numbers wide."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.expr import ladder, ratio

SERIES = "series"
K = dict(by=SERIES, order="dt")
THRESHOLDS = (25.0, 30.0, 40.0)
UP_EXPOSURES = (1.0, 0.7, 0.5, 0.3)
DOWN_EXPOSURES = (0.7, 0.4, 0.2, 0.1)
VOL_EXPOSURES = (1.0, 0.7, 0.4, 0.1)


def market_index(panel: DataFrame) -> DataFrame:
    """Equal-weight index level per date; the single series is its own window partition."""
    return panel.groupBy("dt").agg(F.avg("close").alias("px")).withColumn(SERIES, F.lit("market"))


def with_returns(d: DataFrame) -> DataFrame:
    return d.withColumn("ret", ratio("px", R.lag("px", 1, **K)) - 1)


def regime_volatility(window: int = 20) -> Column:
    hv = R.r_std("ret", window, **K) * math.sqrt(252.0) * 100
    return hv


def exposure_ladder(vol, exposures: Sequence[float], thresholds: Sequence[float] = THRESHOLDS) -> Column:
    if len(exposures) != len(thresholds) + 1:
        raise ValueError("one exposure more than thresholds is needed")
    return ladder(vol, list(zip(thresholds, exposures[1:])), exposures[0])


def volatility_gate(index: DataFrame, thresholds=THRESHOLDS, exposures=VOL_EXPOSURES) -> DataFrame:
    d = with_returns(index).withColumn("hv", regime_volatility())
    d = d.withColumn("vol", (F.col("hv") + R.lag("hv", 5, **K)) / 2)
    e = F.when(F.col("vol").isNull(), F.lit(exposures[0])).otherwise(exposure_ladder("vol", exposures, thresholds))
    return d.select(SERIES, "dt", "vol", e.alias("exposure"))


def dual_gate(index: DataFrame, thresholds=THRESHOLDS, up=UP_EXPOSURES, down=DOWN_EXPOSURES) -> DataFrame:
    """Trend (short against long average) chooses the ladder; missing averages count as downtrend."""
    d = with_returns(index).withColumn("hv", regime_volatility())
    d = d.withColumn("vol", (F.col("hv") + R.lag("hv", 5, **K)) / 2)
    rising = F.coalesce(R.r_mean("px", 20, **K) >= R.r_mean("px", 60, **K), F.lit(False))
    low = lambda ex: F.when(F.col("vol").isNull(), F.lit(ex[0])).otherwise(exposure_ladder("vol", ex, thresholds))
    d = d.withColumn("uptrend", rising)
    return d.select(SERIES, "dt", "vol", "uptrend", F.when(F.col("uptrend"), low(up)).otherwise(low(down)).alias("exposure"))


def market_regime(index: DataFrame, window: int = 60, bull=(0.05, 0.20, 0.5), bear=(-0.05, 0.25)) -> DataFrame:
    """bull / bear / sideways from return, volatility and Sharpe of the last `window` bars, with the metrics."""
    d = with_returns(index).withColumn("i", F.row_number().over(R.ts(SERIES, "dt")) - 1)
    d = d.select(
        SERIES, "dt", "px", "i",
        (ratio("px", R.lag("px", window, **K)) - 1).alias("rolling_return"),
        (R.r_std("ret", window, **K) * math.sqrt(252.0)).alias("rolling_vol"),
        (R.r_mean("ret", window, **K) * 252.0).alias("mean_ret"),
        R.r_mean("px", 20, **K).alias("ma20"),
        R.r_mean("px", 60, **K).alias("ma60"),
    )
    d = d.withColumn("rolling_sharpe", F.col("mean_ret") / (F.col("rolling_vol") + 1e-10))
    d = d.withColumn("ma_diff_pct", ratio(F.col("ma20") - F.col("ma60"), "ma60"))
    ret, vol = F.col("rolling_return"), F.col("rolling_vol")
    regime = (
        F.when((F.col("i") < window) | ret.isNull() | vol.isNull(), "sideways")
        .when((ret > bull[0]) & (vol < bull[1]) & (F.col("rolling_sharpe") > bull[2]), "bull")
        .when((ret < bear[0]) | ((ret < 0) & (vol > bear[1])), "bear")
        .otherwise("sideways")
    )
    return d.select(SERIES, "dt", "px", "rolling_return", "rolling_vol", "rolling_sharpe", "ma20", "ma60", "ma_diff_pct", regime.alias("regime"))


REGIME_EXPOSURES = {"bull": 1.0, "sideways": 0.7, "bear": 0.1}


def regime_gate(regimes: DataFrame, levels: dict[str, float] = REGIME_EXPOSURES) -> DataFrame:
    e = F.lit(levels["sideways"])
    for k in ("bull", "bear"):
        e = F.when(F.col("regime") == k, F.lit(levels[k])).otherwise(e)
    return regimes.select(SERIES, "dt", e.alias("exposure"))


def shift_gate(gate: DataFrame, n: int = 1, fill: float = 1.0) -> DataFrame:
    """Exposure known n bars earlier, clipped to [0, 1]; the first n dates take the default."""
    e = F.coalesce(F.lag("exposure", n, fill).over(R.ts(SERIES, "dt")), F.lit(fill))
    return gate.select(SERIES, "dt", F.least(F.greatest(e, F.lit(0.0)), F.lit(1.0)).alias("exposure"))


def gate_stats(gate: DataFrame) -> DataFrame:
    return gate.agg(
        F.count(F.lit(1)).alias("n"), F.avg("exposure").alias("mean_exposure"), F.min("exposure").alias("min_exposure"), F.max("exposure").alias("max_exposure"),
        F.avg((F.col("exposure") < 1).cast("double")).alias("reduced_share"),
    )


def light_timing(index: DataFrame, haven: DataFrame, threshold: float = -0.4, reduced: float = 0.3) -> DataFrame:
    """0.4 x index against its long average + 0.4 x momentum sign + 0.2 x haven against its long average."""
    d = index.join(haven.select("dt", F.col("px").alias("haven")), "dt", "left")
    w = R.frame(200, **K)
    sign = lambda cond: F.when(cond, F.lit(1.0)).otherwise(F.lit(-1.0))
    past = R.lag("px", 20, **K)
    mom = F.when(past.isNull(), F.lit(1.0)).otherwise(sign(F.col("px") > past))
    d = d.withColumn("score", 0.4 * sign(F.col("px") > F.avg("px").over(w)) + 0.4 * mom + 0.2 * sign(F.col("haven") > F.avg("haven").over(w)))
    # scores are sums of +-0.4, +-0.4, +-0.2; the comparison is done on one decimal
    return d.select(SERIES, "dt", F.round("score", 6).alias("score"), F.when(F.round("score", 6) < threshold, F.lit(reduced)).otherwise(F.lit(1.0)).alias("exposure"))


def dual_timing(panel: DataFrame, index: DataFrame, bear: float = 0.1) -> DataFrame:
    """Index against its long average sets the position; each symbol against its short average sets a trend flag."""
    i = index.select("dt", F.when(F.col("px") > F.avg("px").over(R.frame(200, **K)), F.lit(1.0)).otherwise(F.lit(bear)).alias("position"))
    own = F.col("close") >= F.avg("close").over(R.frame(20))
    return panel.where("close is not null").select("symbol", "dt", own.alias("trend")).join(i, "dt").select("symbol", "dt", "trend", "position")


def schedule(days: DataFrame, freq: int, lookback: int = 0, bar: str = "bar") -> DataFrame:
    """Rebalance bars: the first multiple of freq past the lookback, then every freq bars."""
    first = lookback + 1
    return days.where((F.col(bar) >= first) & (F.col(bar) % freq == 0))
