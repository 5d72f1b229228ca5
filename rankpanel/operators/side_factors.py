"""Side-table, premium, money-flow and asset-category factors (F-39..F-56), as column dictionaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.expr import EPS, clip, ratio, safe_div_signed
from ..functions.ranking import pct_rank
from .factors import ANNUAL, CATALOG, carry_side_fields, with_stage_columns


def side_panel(panel: DataFrame) -> DataFrame:
    """Panel with side quantities carried forward, row-to-row changes and the premium rate."""
    d = with_stage_columns(carry_side_fields(panel))
    return d.withColumn("premium", (F.col("close") - F.col("unit_nav")) / F.when(F.col("unit_nav") != 0, F.col("unit_nav")))


def change(c: str, n: int) -> Column:
    return safe_div_signed(F.col(c) - R.lag(c, n), R.lag(c, n))


def share_changes() -> dict[str, Column]:
    return {k.lower(): CATALOG[k].build() for k in ("SHARE_CHG_5D", "SHARE_CHG_10D", "SHARE_CHG_20D")}


def share_turnover() -> Column:
    return ratio(F.abs(F.col("fd_share") - R.lag("fd_share")), "volume")


def rank_change(d: DataFrame, value: Column, n: int, out: str) -> DataFrame:
    """Cross-section percentage rank, then its change over n rows."""
    d = d.withColumn("__v", value)
    d = d.withColumn("__rank", pct_rank("__v", "dt"))
    return d.withColumn(out, F.col("__rank") - R.lag("__rank", n)).drop("__v", "__rank")


def margin_set() -> dict[str, Column]:
    vol20 = R.r_mean("volume", 20, min_periods=10)
    return {
        "margin_long_short": ratio("rzye", "rqye"),
        "margin_net_flow": F.col("rzmre") - F.col("rzche"),
        "margin_density": ratio(F.col("rzye"), F.col("close") * vol20),
    }


def premium_zscore() -> Column:
    m, s = R.r_mean("premium", 60, min_periods=20), R.r_std("premium", 60, min_periods=20)
    return ratio(F.col("premium") - m, s)


def fx_factors(rate: DataFrame) -> DataFrame:
    """One FX series (dt, rate) to its momentum and volatility; the single series is its own group."""
    k = dict(by="pair", order="dt")
    d = rate.withColumn("ret", ratio("rate", R.lag("rate", **k)) - 1)
    return d.select(
        "pair",
        "dt",
        (ratio("rate", R.lag("rate", 10, **k)) - 1).alias("fx_momentum_10d"),
        R.r_std("ret", 20, min_periods=10, **k).alias("fx_vol_20d"),
        (ratio("rate", R.lag("rate", 20, **k)) - 1).alias("fx_momentum_20d"),
    )


def short_side() -> dict[str, Column]:
    return {
        "short_ratio": ratio(F.col("rqye"), F.col("rzye") + F.col("rqye")),
        "short_intensity": ratio("rqmcl", "volume"),
        "short_cover_speed": F.col("rqchl") / (F.col("rqmcl") + F.lit(1e-8)),
        "net_margin_flow": ratio(F.col("rzmre") - F.col("rzche"), F.col("rzye")),
    }


def share_second_order(windows=(10, 20)) -> dict[str, Column]:
    """Needs column `chg5`."""
    out = {}
    for w in windows:
        need = max(w // 2, 5)
        s = R.r_std("chg5", w, min_periods=need)
        out[f"share_stability_{w}d"] = F.when(s >= EPS, 1.0 / s)
        out[f"share_skew_{w}d"] = R.r_skew("chg5", w, min_periods=need)
    return out


def cross_source() -> dict[str, Column]:
    """Needs columns `chg5` and `ret5`."""
    vol_ratio = F.col("volume") / (R.r_mean("volume", 20, min_periods=10) + EPS)
    c10 = change("fd_share", 10)
    return {
        "share_price_div": R.r_corr("chg5", "ret5", 20, min_periods=10),
        "flow_quality": c10 / (vol_ratio + EPS),
        "leverage_flow": change("rzye", 10) - c10,
    }


def premium_variants() -> dict[str, Column]:
    p = F.col("premium")
    m, s = R.r_mean("premium", 20, min_periods=10), R.r_std("premium", 20, min_periods=10)
    return {
        "premium_raw": p,
        "premium_ma5": R.r_mean("premium", 5, min_periods=3),
        "premium_deviation": p - m,
        "premium_delta_5d": p - R.lag("premium", 5),
        "premium_zdev": (p - m) / (s + F.lit(1e-8)),
    }


def money_flow() -> dict[str, Column]:
    """Needs main_pct, xl_pct, l_pct, xl_net, s_net."""
    return {
        "main_net_flow_pct": F.col("main_pct"),
        "xl_net_flow_pct": F.col("xl_pct"),
        "smart_money_ratio": F.col("xl_net") / (F.abs("s_net") + F.lit(1e6)),
        "main_flow_5d_sum": R.r_sum("main_pct", 5, min_periods=3),
        "flow_momentum": R.r_mean("main_pct", 5, min_periods=3) / (F.abs(R.r_mean("main_pct", 20, min_periods=10)) + F.lit(0.01)) - 1,
        "large_order_pct": F.col("l_pct"),
    }


def order_flow(lines: DataFrame) -> DataFrame:
    """Net value of each order-size class per (symbol, week): bought (A, N) minus returned (R)."""
    q = F.col("l_quantity")
    size = F.when(q > 40, "xl").when(q > 25, "l").when(q > 10, "m").otherwise("s")
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    d = lines.select("symbol", F.to_date(F.date_trunc("week", "l_shipdate")).alias("dt"), size.alias("size"), signed.alias("net"), "l_extendedprice")
    agg = [F.round(F.sum(F.when(F.col("size") == s, F.col("net")).otherwise(F.lit(0.0))), 2).alias(f"{s}_net") for s in ("xl", "l", "m", "s")]
    g = d.groupBy("symbol", "dt").agg(*agg, F.round(F.sum("l_extendedprice"), 2).alias("turnover"))
    pct = lambda x: ratio(x * 100.0, F.col("turnover"))
    return g.select("*", pct(F.col("xl_net") + F.col("l_net")).alias("main_pct"), pct(F.col("xl_net")).alias("xl_pct"), pct(F.col("l_net")).alias("l_pct"))


def bond_set() -> dict[str, Column]:
    """Needs `rate` (benchmark) and `vol20`."""
    past = F.collect_list("vol20").over(R.frame(60))
    cur = F.col("vol20")
    rate_move = F.col("rate") - R.lag("rate", 60)
    m5, m20 = (ratio("close", R.lag("close", 5)) - 1) * 100, (ratio("close", R.lag("close", 20)) - 1) * 100
    return {
        "yield_momentum_20d": -m20,
        "duration_proxy_60d": F.when(F.abs(rate_move) >= EPS, F.try_divide(-(F.col("close") - R.lag("close", 60)) / (R.lag("close", 60) + EPS), rate_move)),
        "bond_vol_regime": F.when(F.count("vol20").over(R.frame(60)) == 60, F.size(F.filter(past, lambda v: v >= cur)) / F.lit(60.0)),
        "bond_momentum_score": 0.4 * m5 + 0.6 * m20,
        "yield_curve_slope": R.r_mean("long_rate", 20) - R.r_mean("rate", 20),
    }


def commodity_set() -> dict[str, Column]:
    """Needs `rate` and `mkt`."""
    c = F.col("close")
    mom = (ratio("close", R.lag("close", 20)) - 1) * 100
    hi, lo = R.r_max("close", 20), R.r_min("close", 20)
    return {
        "usd_inverse_mom_20d": -(ratio("rate", R.lag("rate", 20)) - 1) * 100,
        "commodity_trend_20d": mom * (0.5 + (c - lo) / (hi - lo + EPS)),
        "gold_safe_haven_score": clip((1 - R.r_corr("r", "mkt", 20)) / 2, 0.0, 1.0),
        "commodity_vol_adj_mom": R.r_sum("r", 20) * 100 / (R.r_std("r", 20) * math.sqrt(ANNUAL) * 100 + EPS),
    }


def cross_border_set() -> dict[str, Column]:
    """Needs `rate`."""
    mom = (ratio("close", R.lag("close", 20)) - 1) * 100
    gap = (F.col("open") - F.col("prev_close")) / (F.col("prev_close") + EPS) * 100
    return {
        "qdii_momentum_20d": mom,
        "fx_adjusted_mom": mom - (ratio("rate", R.lag("rate", 20)) - 1) * 100,
        "qdii_vol_ratio": R.r_std("r", 10) / (R.r_std("r", 60) + EPS),
        "overnight_gap_score": R.r_sum(gap, 20),
    }


CATEGORIES = {0: "BOND", 1: "COMMODITY", 2: "QDII"}


def category_of(pool) -> Column:
    out = None
    for k, v in CATEGORIES.items():
        out = F.when(F.col(pool) == k, v) if out is None else out.when(F.col(pool) == k, v)
    return out.otherwise("EQUITY")


def atr(d: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    """Wilder average true range: plain mean of the first n ranges, then 1/n smoothing; held over gaps."""
    d = R.ewm_mean(d.where("tr is not null"), "tr", out, alpha=1.0 / n, seed_rows=n)
    return d
