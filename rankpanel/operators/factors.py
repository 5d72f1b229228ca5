"""The factor library (F-01..F-43): rolling windows per symbol, built in three stages.

Stage columns hold what several factors share (returns, true range, signed volume, market return).
All windows share one partitioning and order, so Spark plans a single exchange and sort for the
whole library, and column pruning drops every stage column the requested factors do not use.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.expr import EPS, both, clip, ratio, safe_div, safe_div_signed

ANNUAL = 252.0


# ---------------------------------------------------------------- stage columns


def with_stage_columns(panel: DataFrame) -> DataFrame:
    """Row-to-row changes of the panel. One select, one sort order."""
    c, pc = F.col("close"), R.lag("close")
    d = panel.select(
        "*",
        ratio(c, pc).alias("growth"),
        (c - pc).alias("delta"),
        pc.alias("prev_close"),
        R.lag("high").alias("prev_high"),
        R.lag("low").alias("prev_low"),
        (ratio("volume", R.lag("volume")) - 1).alias("dvol"),
    )
    d = d.select("*", (F.col("growth") - 1).alias("r"))
    tr = both(F.greatest, F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")))
    hd, ld = F.col("high") - F.col("prev_high"), F.col("prev_low") - F.col("low")
    return d.select(
        "*",
        both(F.greatest, tr, F.abs(F.col("low") - F.col("prev_close"))).alias("tr"),
        F.when((hd > ld) & (hd > 0), hd).otherwise(F.lit(0.0)).alias("plus_dm"),
        F.when((ld > hd) & (ld > 0), ld).otherwise(F.lit(0.0)).alias("minus_dm"),
        (F.coalesce(F.signum("delta"), F.lit(0.0)) * F.col("volume")).alias("signed_volume"),
        F.when(F.col("high") != F.col("low"), (2 * c - F.col("high") - F.col("low")) / (F.col("high") - F.col("low") + EPS) * F.col("volume")).alias("mfv"),
    )


def with_market(d: DataFrame) -> DataFrame:
    """Adds the equal-weight market return of the date. The per-date average is one small row per date."""
    mkt = d.groupBy("dt").agg(F.avg("r").alias("mkt"))
    return d.join(mkt, "dt", "left")


def with_obv(d: DataFrame) -> DataFrame:
    return d.withColumn("obv", R.running(F.sum("signed_volume")))


def with_adx(d: DataFrame) -> DataFrame:
    for c, o in (("tr", "atr_e"), ("plus_dm", "pdm_e"), ("minus_dm", "mdm_e")):
        d = R.ewm_mean(d, c, o, span=14, min_periods=14)
    plus, minus = 100 * F.col("pdm_e") / (F.col("atr_e") + EPS), 100 * F.col("mdm_e") / (F.col("atr_e") + EPS)
    d = d.withColumn("dx", 100 * F.abs(plus - minus) / (plus + minus + EPS))
    return R.ewm_mean(d, "dx", "adx", span=14, min_periods=14)


def _pattern_entropy(n: int = 20) -> Column:
    """Ordinal patterns of three consecutive returns in the window, as entropy over ln 6."""
    a, b, c = R.lag("r", 2), R.lag("r", 1), F.col("r")
    code = 2 * ((b < a).cast("int") + (c < a).cast("int")) + (c < b).cast("int")
    return code


def entropy_from_codes(n: int = 20) -> Column:
    w = R.frame(n - 2)
    total = float(n - 2)
    out = F.lit(0.0)
    for k in range(6):
        p = F.sum((F.col("pattern") == k).cast("double")).over(w) / total
        out = out - F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))
    return F.when(F.count("r").over(R.frame(n)) == n, out / math.log(6.0))


# ---------------------------------------------------------------- catalog


@dataclass(frozen=True)
class Factor:
    name: str
    build: Callable[[], Column]
    needs: frozenset = field(default_factory=frozenset)
    bounded: bool = False
    direction: str = "neutral"


CATALOG: dict[str, Factor] = {}


def register(name: str, build: Callable[[], Column], needs: Iterable[str] = (), bounded: bool = False, direction: str = "neutral") -> None:
    """The user hook (U-06): a factor is a Column builder over panel and stage columns plus a metadata row."""
    CATALOG[name] = Factor(name, build, frozenset(needs), bounded, direction)


def _momentum(n):
    return lambda: (ratio("close", R.lag("close", n)) - 1) * 100


def _position(n):
    def build():
        lo, hi = R.r_min("low", n), R.r_max("high", n)
        return F.when(hi - lo > EPS, clip((F.col("close") - lo) / (hi - lo), 0.0, 1.0)).when((hi - lo).isNotNull(), F.lit(0.5))

    return build


def _volume_ratio(n):
    return lambda: safe_div(R.r_mean("volume", n), R.r_mean("volume", n, shift=n))


def _rsi():
    d = F.col("delta")
    up, down = R.r_mean(clip(d, lo=0.0), 14), R.r_mean(-clip(d, hi=0.0), 14)
    return 100 - 100 / (1 + up / (down + EPS))


def _sharpe():
    m, s = R.r_mean("r", 20), R.r_std("r", 20)
    return F.when(s >= EPS, m / (s + EPS) * math.sqrt(ANNUAL))


def _calmar():
    dd = R.worst_drawdown("close", 60)
    return F.when(F.abs(dd) >= EPS, (F.col("close") / R.lag("close", 59) - 1) / F.abs(dd))


def _vortex():
    t = R.r_sum("tr", 14) + EPS
    return R.r_sum(F.abs(F.col("high") - F.col("prev_low")), 14) / t - R.r_sum(F.abs(F.col("low") - F.col("prev_high")), 14) / t


def _relative_strength():
    return R.r_sum(F.log1p("r"), 20) - R.r_sum(F.log1p("mkt"), 20)


def _info_discrete():
    w = R.frame(20)
    pos, neg = F.sum((F.col("r") > 0).cast("double")).over(w), F.sum((F.col("r") < 0).cast("double")).over(w)
    enough = F.count("dt").over(w) == 20
    mom = ratio("close", R.lag("close", 20)) - 1
    return F.when(enough, F.signum(mom) * (F.coalesce(neg, F.lit(0.0)) - F.coalesce(pos, F.lit(0.0))) / 20.0)


def _ibs():
    h, l, c = F.col("high"), F.col("low"), F.col("close")
    return F.when(F.abs(h - l) > EPS, clip((c - l) / (h - l + EPS), 0.0, 1.0)).when((h - l).isNotNull(), F.lit(0.5))


def _up_down():
    up = R.r_sum(F.when(F.col("r") > 0, F.col("volume")).otherwise(F.lit(0.0)), 20)
    dn = R.r_sum(F.when(F.col("r") <= 0, F.col("volume")).otherwise(F.lit(0.0)), 20)
    return safe_div(up, dn)


def _gk():
    hl = F.log(F.col("high") / (F.col("low") + EPS))
    co = F.log(F.col("close") / (F.col("open") + EPS))
    gk = R.r_mean(0.5 * hl * hl - (2 * math.log(2.0) - 1) * co * co, 20)
    cc = R.r_mean(F.col("r") * F.col("r"), 20)
    return F.when(cc >= EPS, F.sqrt(F.abs(gk) / (cc + EPS)))


def _downside():
    neg = clip("r", hi=0.0)
    return F.sqrt(R.r_mean(neg * neg, 20)) * math.sqrt(ANNUAL) * 100


def _ma_ratio(short, long, pct):
    def build():
        q = safe_div(R.r_mean("volume", short), R.r_mean("volume", long))
        return (q - 1) * 100 if pct else q

    return build


HIGH, LOW = "high_is_good", "low_is_good"

register("MOM_20D", _momentum(20), direction=HIGH)
register("SLOPE_20D", lambda: R.r_slope("close", 20), direction=HIGH)
register("PRICE_POSITION_20D", _position(20), bounded=True, direction=HIGH)
register("PRICE_POSITION_120D", _position(120), bounded=True, direction=HIGH)
register("RET_VOL_20D", lambda: R.r_std(F.col("r") * 100, 20), direction=LOW)
register("MAX_DD_60D", lambda: F.abs(R.worst_drawdown("close", 60)) * 100, direction=LOW)
register("VOL_RATIO_20D", _volume_ratio(20), direction=HIGH)
register("VOL_RATIO_60D", _volume_ratio(60), direction=HIGH)
register("PV_CORR_20D", lambda: R.r_corr("r", "dvol", 20), bounded=True)
register("RSI_14", _rsi, bounded=True)
register("OBV_SLOPE_10D", lambda: R.r_slope("obv", 10), needs=("obv",), direction=HIGH)
register("CMF_20D", lambda: R.r_sum("mfv", 20) / (R.r_sum("volume", 20) + EPS), bounded=True, direction=HIGH)
register("SHARPE_RATIO_20D", _sharpe, direction=HIGH)
register("CALMAR_RATIO_60D", _calmar, direction=HIGH)
register("ADX_14D", lambda: F.col("adx"), needs=("adx",), bounded=True)
register("VORTEX_14D", _vortex, direction=HIGH)
register("RELATIVE_STRENGTH_VS_MARKET_20D", _relative_strength, needs=("market",), direction=HIGH)
register("CORRELATION_TO_MARKET_20D", lambda: R.r_corr("r", "mkt", 20), needs=("market",), bounded=True)
register("TSMOM_60D", _momentum(60), direction=HIGH)
register("TSMOM_120D", _momentum(120), direction=HIGH)
register("BREAKOUT_20D", lambda: (F.col("close") / R.r_max("high", 20) - 1) * 100, direction=HIGH)
register("TURNOVER_ACCEL_5_20", _ma_ratio(5, 20, False), direction=HIGH)
register("REALIZED_VOL_20D", lambda: R.r_std("r", 20) * math.sqrt(ANNUAL), direction=LOW)
register("AMIHUD_ILLIQUIDITY", lambda: R.r_mean(F.abs("r") / (F.col("volume") * F.col("close") + EPS), 20) * 1e6)
register("SPREAD_PROXY", lambda: R.r_mean((F.col("high") - F.col("low")) / (F.col("close") + EPS), 5) * 100, direction=LOW)
register("SKEW_20D", lambda: R.r_skew("r", 20))
register("KURT_20D", lambda: R.r_kurt("r", 20))
register("INFO_DISCRETE_20D", _info_discrete)
register("IBS", _ibs, bounded=True)
register("MEAN_REV_RATIO_20D", lambda: (F.col("close") / R.r_mean("close", 20) - 1) * 100)
register("UP_DOWN_VOL_RATIO_20D", _up_down, direction=HIGH)
register("ABNORMAL_VOLUME_20D", _ma_ratio(5, 60, True))
register("ULCER_INDEX_20D", lambda: R.ulcer("close", 20), direction=LOW)
register("DD_DURATION_60D", lambda: R.bars_since_higher("close", 60), bounded=True, direction=LOW)
register("GK_VOL_RATIO_20D", _gk)
register("PERM_ENTROPY_20D", entropy_from_codes, needs=("pattern",), bounded=True)
register("HURST_60D", lambda: F.col("hurst"), needs=("hurst",), bounded=True)
register("DOWNSIDE_DEV_20D", _downside, direction=LOW)

BAR_FACTORS = tuple(CATALOG)


def _change(c, n):
    return lambda: safe_div_signed(F.col(c) - R.lag(c, n), R.lag(c, n))


def _accel():
    return _change("fd_share", 5)() - _change("fd_share", 20)()


register("SHARE_CHG_5D", _change("fd_share", 5), direction=LOW)
register("SHARE_CHG_10D", _change("fd_share", 10), direction=LOW)
register("SHARE_CHG_20D", _change("fd_share", 20), direction=LOW)
register("SHARE_ACCEL", _accel, direction=HIGH)
register("MARGIN_CHG_10D", _change("rzye", 10), needs=("side",), direction=LOW)
register("MARGIN_BUY_RATIO", lambda: safe_div_signed("rzmre", F.col("close") * F.col("volume")), needs=("side",), direction=LOW)

SIDE_FACTORS = tuple(n for n in CATALOG if n not in BAR_FACTORS)

# factors that fold over a window array row by row
HEAVY = {"MAX_DD_60D", "CALMAR_RATIO_60D", "ULCER_INDEX_20D", "DD_DURATION_60D", "HURST_60D", "PERM_ENTROPY_20D"}

SIDE_FIELDS = ("rzye", "rzmre", "rzche", "rqye", "rqyl", "rqchl", "rqmcl", "unit_nav")


def carry_side_fields(d: DataFrame) -> DataFrame:
    """Side quantities as known on each date: last published value carried forward."""
    carried = {c: R.ffill(c).alias(c) for c in SIDE_FIELDS}
    return d.select(*[carried.get(c, F.col(c)) for c in d.columns])


def factors_wide(panel: DataFrame, names: Iterable[str] = BAR_FACTORS, keep: Iterable[str] = ()) -> DataFrame:
    """(symbol, dt, bar, pool, *keep, one column per factor)."""
    names = list(names)
    needs = set().union(*[CATALOG[n].needs for n in names]) if names else set()
    if HEAVY & set(names):
        panel = R.spread(panel, "symbol")
    d = carry_side_fields(panel) if "side" in needs else panel
    d = with_stage_columns(d)
    if "obv" in needs:
        d = with_obv(d)
    if "pattern" in needs:
        d = d.withColumn("pattern", _pattern_entropy())
    if "hurst" in needs:
        d = R.hurst(d, "r", "hurst", 60)
    if "adx" in needs:
        d = with_adx(d)
    if "market" in needs:
        d = with_market(d)
    return d.select("symbol", "dt", "bar", "pool", *keep, *[CATALOG[n].build().alias(n) for n in names])


def to_long(wide: DataFrame, names: Iterable[str], ids: Iterable[str] = ("dt", "symbol")) -> DataFrame:
    """Long factor table (dt, symbol, factor, value) without the missing values."""
    return wide.unpivot(list(ids), list(names), "factor", "value").where("value is not null")
