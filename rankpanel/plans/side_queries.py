"""F-39..F-56 and the window operators W-01..W-06."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.expr import corr, ratio
from ..functions.ranking import avg_rank
from ..operators import side_factors as S
from ..operators.factors import factors_wide, with_market, with_stage_columns
from ..oracle.base import PANEL, WINDOWS, corr as sql_corr, full, mean, slope, std, total
from ..oracle.factors import SQL, STAGED, _chg
from ..sources.panel import panel
from ..sources.side_tables import load_fx
from ..sources.stages import stage
from ..sources.tables import order_lines
from .registry import query, rounded

SIDE = STAGED + """,
sd AS (SELECT * EXCLUDE (rzye, rzmre, rzche, rqye, rqyl, rqchl, rqmcl, unit_nav), """ + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER u AS {c}" for c in ("rzye", "rzmre", "rzche", "rqye", "rqyl", "rqchl", "rqmcl", "unit_nav")
) + f""" FROM s WINDOW u AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sp AS MATERIALIZED (SELECT *, (close - unit_nav) / unit_nav AS premium, {_chg('fd_share', 5)} AS chg5, close / lag(close, 5) OVER w - 1 AS ret5 FROM sd {WINDOWS})"""

FX = """,
ow AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'USD' WHEN '2-HIGH' THEN 'HKD' END AS pair, CAST(date_trunc('week', o_orderdate) AS DATE) AS dt, o_totalprice FROM orders),
fxq AS (SELECT pair, dt, round(sum(o_totalprice), 2) / count(*) / 1000.0 AS quote FROM ow WHERE pair IS NOT NULL GROUP BY ALL),
fx0 AS (SELECT coalesce(a.dt, b.dt) AS dt, a.quote AS usd, b.quote / 100 AS hkd FROM (SELECT * FROM fxq WHERE pair = 'USD') a FULL JOIN (SELECT * FROM fxq WHERE pair = 'HKD') b ON a.dt = b.dt),
fx AS (SELECT c.dt, last_value(usd IGNORE NULLS) OVER (ORDER BY c.dt) AS usd, last_value(hkd IGNORE NULLS) OVER (ORDER BY c.dt) AS hkd FROM cal c LEFT JOIN fx0 ON c.dt = fx0.dt)"""


def side(spark, sf):
    def build():
        d = S.side_panel(panel(spark, sf))
        return d.withColumn("chg5", S.change("fd_share", 5)).withColumn("ret5", ratio("close", R.lag("close", 5)) - 1)

    return stage(spark, sf, "side", build)


def out(d, cols: dict, digits=6):
    d = d.select("symbol", "dt", *[c.alias(k) for k, c in cols.items()])
    return rounded(d.where(F.coalesce(*[F.col(k) for k in cols]).isNotNull()), digits)


def sql(cols: dict, ctes=SIDE, src="sp", digits=6) -> str:
    inner = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    outer = ", ".join(f"round({k}, {digits}) AS {k}" for k in cols)
    return f"WITH {ctes} SELECT symbol, dt, {outer} FROM (SELECT symbol, dt, {inner} FROM {src} {WINDOWS}) WHERE coalesce({', '.join(cols)}) IS NOT NULL"


def d_(a, b):
    return f"CASE WHEN {b} <> 0 THEN ({a}) / ({b}) END"


@query("f_39_share_change", sql({k: SQL[k.upper()] for k in ("share_chg_5d", "share_chg_10d", "share_chg_20d")}))
def f39(spark, sf):
    return out(side(spark, sf), S.share_changes())


@query("f_40_share_accel", sql({"share_accel": SQL["SHARE_ACCEL"]}))
def f40(spark, sf):
    return out(side(spark, sf), {"share_accel": S.change("fd_share", 5) - S.change("fd_share", 20)})


@query("f_41_margin_change", sql({"margin_chg_10d": _chg("rzye", 10)}))
def f41(spark, sf):
    return out(side(spark, sf), {"margin_chg_10d": S.change("rzye", 10)})


@query("f_42_margin_buy_ratio", sql({"margin_buy_ratio": "CASE WHEN abs(close * volume) > 1e-10 THEN rzmre / (abs(close * volume) + 1e-10) END"}))
def f42(spark, sf):
    from ..operators.factors import CATALOG

    return out(side(spark, sf), {"margin_buy_ratio": CATALOG["MARGIN_BUY_RATIO"].build()})


_RK = SIDE + f""", c10 AS (SELECT symbol, dt, fd_share, volume, {_chg('fd_share', 10)} AS c FROM sp {WINDOWS}),
rk AS (SELECT *, CASE WHEN c IS NOT NULL THEN (rank() OVER (PARTITION BY dt ORDER BY c NULLS LAST) + (count(c) OVER (PARTITION BY dt, c) - 1) / 2.0) / count(c) OVER (PARTITION BY dt) END AS rp FROM c10)"""


@query("f_43_share_turnover_rank_change", sql({
    "share_turnover": d_("abs(fd_share - lag(fd_share) OVER w)", "volume"), "share_rank_chg_10d": "rp - lag(rp, 10) OVER w"}, _RK, "rk"))
def f43(spark, sf):
    d = side(spark, sf).withColumn("share_turnover", S.share_turnover())
    d = S.rank_change(d, S.change("fd_share", 10), 10, "share_rank_chg_10d")
    return out(d, {c: F.col(c) for c in ("share_turnover", "share_rank_chg_10d")})


@query("f_44_margin_levels", sql({
    "margin_long_short": d_("rzye", "rqye"), "margin_net_flow": "rzmre - rzche", "margin_density": d_("rzye", f"(close * ({mean('volume', 20, need=10)}))")}))
def f44(spark, sf):
    return out(side(spark, sf), S.margin_set())


_PS = std("premium", 60, 20)


@query("f_45_premium_zscore_momentum", sql({
    "premium_zscore": f"CASE WHEN ({_PS}) <> 0 THEN (premium - ({mean('premium', 60, need=20)})) / ({_PS}) END", "premium_momentum": slope("premium", 10)}))
def f45(spark, sf):
    return out(side(spark, sf), {"premium_zscore": S.premium_zscore(), "premium_momentum": R.r_slope("premium", 10)})


_FXF = PANEL + FX + """, fr AS (SELECT dt, usd, usd / lag(usd) OVER o - 1 AS ret FROM fx WINDOW o AS (ORDER BY dt)),
ff AS (SELECT dt, usd / lag(usd, 10) OVER o - 1 AS m, usd / lag(usd, 20) OVER o - 1 AS m20, CASE WHEN count(ret) OVER o20 >= 10 THEN stddev_samp(ret) OVER o20 END AS v FROM fr
 WINDOW o AS (ORDER BY dt), o20 AS (ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def fx_long(spark, sf):
    fx = load_fx(spark, sf)
    return fx.select(F.lit("USD").alias("pair"), "dt", F.col("usd").alias("rate"))


@query("f_46_fx_momentum_volatility", f"WITH {_FXF} SELECT p.symbol, p.dt, round(m, 6) AS fx_momentum_10d, round(v, 6) AS fx_vol_20d FROM panel p JOIN ff ON p.dt = ff.dt WHERE coalesce(m, v) IS NOT NULL")
def f46(spark, sf):
    f = S.fx_factors(fx_long(spark, sf))
    return out(panel(spark, sf).join(f, "dt"), {c: F.col(c) for c in ("fx_momentum_10d", "fx_vol_20d")})


@query("f_47_short_side", sql({
    "short_ratio": d_("rqye", "(rzye + rqye)"), "short_intensity": d_("rqmcl", "volume"), "short_cover_speed": "rqchl / (rqmcl + 1e-8)",
    "net_margin_flow": d_("rzmre - rzche", "rzye")}, digits=4))
def f47(spark, sf):
    return out(side(spark, sf), S.short_side(), 4)


def _skew(x, n, need):
    w = f"w{n}"
    return f"CASE WHEN count({x}) OVER {w} >= {need} AND stddev_samp({x}) OVER {w} > 1e-12 THEN skewness({x}) OVER {w} END"


@query("f_48_share_stability_skew", sql({
    "share_stability_10d": f"CASE WHEN ({std('chg5', 10, 5)}) >= 1e-10 THEN 1.0 / ({std('chg5', 10, 5)}) END", "share_skew_10d": _skew("chg5", 10, 5),
    "share_stability_20d": f"CASE WHEN ({std('chg5', 20, 10)}) >= 1e-10 THEN 1.0 / ({std('chg5', 20, 10)}) END", "share_skew_20d": _skew("chg5", 20, 10)}, digits=4))
def f48(spark, sf):
    return out(side(spark, sf), S.share_second_order(), 4)


@query("f_49_cross_source", sql({
    "share_price_div": sql_corr("chg5", "ret5", 20, 10),
    "flow_quality": f"({_chg('fd_share', 10)}) / (volume / (({mean('volume', 20, need=10)}) + 1e-10) + 1e-10)",
    "leverage_flow": f"({_chg('rzye', 10)}) - ({_chg('fd_share', 10)})"}))
def f49(spark, sf):
    return out(side(spark, sf), S.cross_source())


_PM, _PD = mean("premium", 20, need=10), std("premium", 20, 10)


@query("f_50_premium_variants", sql({
    "premium_raw": "premium", "premium_ma5": mean("premium", 5, need=3), "premium_deviation": f"premium - ({_PM})",
    "premium_delta_5d": "premium - lag(premium, 5) OVER w", "premium_zdev": f"(premium - ({_PM})) / (({_PD}) + 1e-8)"}))
def f50(spark, sf):
    return out(side(spark, sf), S.premium_variants())


_SIGNED = "CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END"
_FLOW = PANEL + f""", fl0 AS (SELECT symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS dt,
  round(sum(CASE WHEN l_quantity > 40 THEN {_SIGNED} ELSE 0 END), 2) AS xl_net, round(sum(CASE WHEN l_quantity > 25 AND l_quantity <= 40 THEN {_SIGNED} ELSE 0 END), 2) AS l_net,
  round(sum(CASE WHEN l_quantity <= 10 THEN {_SIGNED} ELSE 0 END), 2) AS s_net, round(sum(l_extendedprice), 2) AS turnover FROM li GROUP BY ALL),
fl1 AS (SELECT symbol, dt, xl_net, s_net, CASE WHEN turnover <> 0 THEN (xl_net + l_net) * 100.0 / turnover END AS main_pct, CASE WHEN turnover <> 0 THEN xl_net * 100.0 / turnover END AS xl_pct,
  CASE WHEN turnover <> 0 THEN l_net * 100.0 / turnover END AS l_pct FROM fl0)"""


@query("f_51_money_flow", sql({
    "main_net_flow_pct": "main_pct", "xl_net_flow_pct": "xl_pct", "smart_money_ratio": "xl_net / (abs(s_net) + 1e6)", "main_flow_5d_sum": full("sum(main_pct)", "main_pct", 5, "w", 3),
    "flow_momentum": f"({mean('main_pct', 5, need=3)}) / (abs({mean('main_pct', 20, need=10)}) + 0.01) - 1", "large_order_pct": "l_pct"}, _FLOW, "fl1"))
def f51(spark, sf):
    return out(S.order_flow(order_lines(spark, sf, "brand").where("l_quantity > 0")), S.money_flow())


def with_rates(spark, sf, d):
    fx = load_fx(spark, sf).select("dt", F.col("usd").alias("rate"), F.col("hkd").alias("long_rate"))
    return d.join(fx, "dt")


def rate_panel(spark, sf):
    def build():
        d = with_market(with_stage_columns(panel(spark, sf)))
        d = with_rates(spark, sf, d)
        return d.withColumn("vol20", R.r_std("r", 20))

    return stage(spark, sf, "rates", build)


_RATES = STAGED + FX + f""", rt0 AS (SELECT s.*, fx.usd AS rate, fx.hkd AS long_rate FROM s JOIN fx ON s.dt = fx.dt),
rt AS (SELECT *, {std('r', 20)} AS vol20 FROM rt0 {WINDOWS})"""

_M = lambda n: f"(close / lag(close, {n}) OVER w - 1) * 100"
BOND_SQL = {
    "yield_momentum_20d": f"-({_M(20)})",
    "duration_proxy_60d": "CASE WHEN abs(rate - lag(rate, 60) OVER w) >= 1e-10 THEN -((close - lag(close, 60) OVER w) / (lag(close, 60) OVER w + 1e-10)) / (rate - lag(rate, 60) OVER w) END",
    "bond_vol_regime": "CASE WHEN count(vol20) OVER w60 = 60 THEN len(list_filter(list(vol20) OVER w60, lambda v: v >= vol20)) / 60.0 END",
    "bond_momentum_score": f"0.4 * {_M(5)} + 0.6 * {_M(20)}",
    "yield_curve_slope": f"({mean('long_rate', 20)}) - ({mean('rate', 20)})",
}
COMMODITY_SQL = {
    "usd_inverse_mom_20d": "-(rate / lag(rate, 20) OVER w - 1) * 100",
    "commodity_trend_20d": f"{_M(20)} * (0.5 + (close - ({full('min(close)', 'close', 20)})) / (({full('max(close)', 'close', 20)}) - ({full('min(close)', 'close', 20)}) + 1e-10))",
    "gold_safe_haven_score": f"CASE WHEN ({sql_corr('r', 'mkt', 20)}) IS NOT NULL THEN greatest(0, least(1, (1 - ({sql_corr('r', 'mkt', 20)})) / 2)) END",
    "commodity_vol_adj_mom": f"({total('r', 20)}) * 100 / (({std('r', 20)}) * sqrt(252) * 100 + 1e-10)",
}
CROSS_SQL = {
    "qdii_momentum_20d": _M(20),
    "fx_adjusted_mom": f"{_M(20)} - (rate / lag(rate, 20) OVER w - 1) * 100",
    "qdii_vol_ratio": f"({std('r', 10)}) / (({std('r', 60)}) + 1e-10)",
    "overnight_gap_score": total("(open - pc) / (pc + 1e-10) * 100", 20),
}


@query("f_52_bond_set", sql(BOND_SQL, _RATES, "rt"))
def f52(spark, sf):
    return out(rate_panel(spark, sf), S.bond_set())


@query("f_53_commodity_set", sql(COMMODITY_SQL, _RATES, "rt"))
def f53(spark, sf):
    return out(rate_panel(spark, sf), S.commodity_set())


@query("f_54_cross_border_set", sql(CROSS_SQL, _RATES, "rt"))
def f54(spark, sf):
    return out(rate_panel(spark, sf), S.cross_border_set())


def _recursion(src: str, x: str, out_expr: str, init: str = "") -> str:
    """Recursive average written as a list fold over the series up to each row."""
    return f"list_reduce(list({x}) OVER u, {out_expr})"


@query("f_55_atr_wilder", f"""WITH {STAGED}, t AS (SELECT symbol, dt, tr, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS i FROM s WHERE tr IS NOT NULL),
 l AS (SELECT symbol, dt, i, list(tr) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM t)
 SELECT symbol, dt, round(list_reduce(list_prepend(list_avg(a[1:14]), a[15:]), lambda p, x: p + (x - p) / 14), 6) AS atr FROM l WHERE i >= 14""")
def f55(spark, sf):
    d = S.atr(with_stage_columns(panel(spark, sf)))
    return rounded(d.where("atr is not null").select("symbol", "dt", "atr"))


def _dispatch(sets):
    return "CASE pool " + " ".join(f"WHEN {k} THEN {v}" for k, v in sets.items()) + " END"


@query("f_56_category_dispatch", f"""WITH {_RATES}, a AS (SELECT symbol, dt, pool, {BOND_SQL['bond_momentum_score']} AS b, {COMMODITY_SQL['commodity_vol_adj_mom']} AS c, {CROSS_SQL['fx_adjusted_mom']} AS q, {SQL['MOM_20D']} AS e FROM rt {WINDOWS}),
 z AS (SELECT symbol, dt, CASE pool WHEN 0 THEN 'BOND' WHEN 1 THEN 'COMMODITY' WHEN 2 THEN 'QDII' ELSE 'EQUITY' END AS category, CASE pool WHEN 0 THEN b WHEN 1 THEN c WHEN 2 THEN q ELSE e END AS value FROM a)
 SELECT symbol, dt, category, round(value, 6) AS value FROM z WHERE value IS NOT NULL""")
def f56(spark, sf):
    d = rate_panel(spark, sf).withColumn("category", S.category_of("pool"))
    c = F.col("category")
    v = (
        F.when(c == "BOND", S.bond_set()["bond_momentum_score"])
        .when(c == "COMMODITY", S.commodity_set()["commodity_vol_adj_mom"])
        .when(c == "QDII", S.cross_border_set()["fx_adjusted_mom"])
        .otherwise((ratio("close", R.lag("close", 20)) - 1) * 100)
    )
    return rounded(d.select("symbol", "dt", "category", v.alias("value")).where("value is not null"))


# ---------------------------------------------------------------- W


@query("w_01_ema", f"""WITH {STAGED}, l AS (SELECT symbol, dt, list(close) OVER v AS a, count(close) OVER v AS n FROM s WHERE close IS NOT NULL
   WINDOW v AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT symbol, dt, round(list_reduce(a, lambda p, x: p + (x - p) * 2 / 13.0), 6) AS ema12, CASE WHEN n >= 14 THEN round(list_reduce(a, lambda p, x: p + (x - p) * 2 / 15.0), 6) END AS ema14,
   round(list_sum(list_transform(a, lambda x, i: x * power(0.5, (n - i) / 5.0))) / list_sum(list_transform(a, lambda x, i: power(0.5, (n - i) / 5.0))), 6) AS ema_half5 FROM l""")
def w01(spark, sf):
    d = panel(spark, sf)
    d = R.ewm_mean(d, "close", "ema12", span=12)
    d = R.ewm_mean(d, "close", "ema14", span=14, min_periods=14)
    d = R.ewm_mean(d, "close", "ema_half5", halflife=5, adjust=True)
    return rounded(d.where("close is not null").select("symbol", "dt", "ema12", "ema14", "ema_half5"))


@query("w_02_running_drawdown", f"WITH {PANEL} SELECT symbol, dt, round(max(close) OVER u, 6) AS peak, round(close / max(close) OVER u - 1, 6) AS drawdown FROM panel {WINDOWS} QUALIFY close IS NOT NULL")
def w02(spark, sf):
    d = panel(spark, sf).where("close is not null")
    return rounded(d.select("symbol", "dt", R.running(F.max("close")).alias("peak"), (F.col("close") / R.running(F.max("close")) - 1).alias("drawdown")))


def timing_overlay(d, value: str, threshold: float, scale: float, lookback: int = 60, high_bearish: bool = True, by="series"):
    """Multiplier per date: `scale` where the share of the previous `lookback` values at or below today's is extreme."""
    past = F.collect_list(value).over(R.ts(by, "dt").rowsBetween(-lookback, -1))
    cur = F.col(value)
    pct = F.try_divide(F.size(F.filter(past, lambda v: v <= cur)).cast("double"), F.size(past).cast("double"))
    old_enough = F.row_number().over(R.ts(by, "dt")) > lookback
    hit = (pct >= threshold) if high_bearish else (pct <= 1.0 - threshold)
    ok = old_enough & (F.size(past) >= 20) & cur.isNotNull()
    return d.select("dt", value, F.when(ok, pct).alias("pct"), F.when(ok & hit, F.lit(scale)).otherwise(F.lit(1.0)).alias("overlay"))


@query("w_03_timing_overlay", f"""WITH {SIDE}, g AS (SELECT dt, avg(c) AS agg FROM (SELECT dt, {_chg('fd_share', 10)} AS c FROM sp {WINDOWS}) GROUP BY dt),
 h AS (SELECT dt, agg, row_number() OVER (ORDER BY dt) AS i, list(agg) FILTER (WHERE agg IS NOT NULL) OVER (ORDER BY dt ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS past FROM g),
 k AS (SELECT dt, agg, CASE WHEN i > 60 AND len(past) >= 20 AND agg IS NOT NULL THEN len(list_filter(past, lambda v: v <= agg)) / len(past) END AS pct FROM h)
 SELECT dt, round(agg, 6) AS agg, round(pct, 6) AS pct, CAST(CASE WHEN pct >= 0.8 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS overlay FROM k""")
def w03(spark, sf):
    d = side(spark, sf).withColumn("c", S.change("fd_share", 10)).groupBy("dt").agg(F.avg("c").alias("agg"))
    return rounded(timing_overlay(d.withColumn("series", F.lit("agg")), "agg", 0.8, 0.5))


@query("w_04_market_state", f"""WITH {STAGED}, px AS (SELECT dt, avg(close) AS p FROM s GROUP BY dt),
 er AS (SELECT dt, CASE WHEN sm > 0 THEN abs(p - p20) / sm END AS er_20d FROM (SELECT dt, p, lag(p, 20) OVER o AS p20, sum(abs(dp)) OVER (ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sm FROM (SELECT dt, p, p - lag(p) OVER (ORDER BY dt) AS dp FROM px) WINDOW o AS (ORDER BY dt))),
 r5 AS (SELECT symbol, dt, r, close / lag(close, 5) OVER w - 1 AS r5, CASE WHEN r IS NOT NULL THEN rank() OVER (PARTITION BY dt ORDER BY r NULLS LAST) + (count(r) OVER (PARTITION BY dt, r) - 1) / 2.0 END AS rk FROM s WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
 pv AS (SELECT *, lag(rk, 5) OVER (PARTITION BY symbol ORDER BY dt) AS pk FROM r5)
 SELECT pv.dt, round(any_value(er_20d), 6) AS er_20d, round(stddev_samp(r5), 6) AS dispersion_5d, CASE WHEN count(CASE WHEN pk IS NOT NULL THEN rk END) > 5 THEN round(corr(CASE WHEN pk IS NOT NULL THEN rk END, pk), 6) END AS rank_persistence
 FROM pv JOIN er ON pv.dt = er.dt GROUP BY pv.dt""")
def w04(spark, sf):
    d = with_stage_columns(panel(spark, sf)).withColumn("r5", ratio("close", R.lag("close", 5)) - 1).withColumn("rk", avg_rank("r", "dt"))
    d = d.withColumn("pk", R.lag("rk", 5))
    both = F.col("rk").isNotNull() & F.col("pk").isNotNull()
    x = d.groupBy("dt").agg(
        F.avg("close").alias("p"),
        F.stddev_samp("r5").alias("dispersion_5d"),
        F.when(F.sum(both.cast("int")) > 5, corr(F.when(both, F.col("rk")), F.when(both, F.col("pk")))).alias("rank_persistence"),
    ).withColumn("series", F.lit("market"))
    k = dict(by="series", order="dt")
    x = x.withColumn("dp", F.abs(F.col("p") - R.lag("p", 1, **k)))
    path = F.sum("dp").over(R.frame(20, **k))
    er = F.when(path > 0, F.abs(F.col("p") - R.lag("p", 20, **k)) / path)
    return rounded(x.select("dt", er.alias("er_20d"), "dispersion_5d", "rank_persistence"))


def islands(d, label: str, by: str = "symbol", order: str = "dt", out: str = "island"):
    """Number of label changes so far: rows of one contiguous run share it."""
    w = R.ts(by, order)
    changed = F.lag(label).over(w).isNull() | (F.lag(label).over(w) != F.col(label))
    return d.withColumn("__chg", changed.cast("int")).withColumn(out, R.running(F.sum("__chg"), by, order)).drop("__chg")


_REG = f"""t AS (SELECT symbol, dt, CASE WHEN close >= ma THEN 'up' ELSE 'down' END AS regime FROM (SELECT symbol, dt, close, {mean('close', 20)} AS ma FROM panel {WINDOWS}) WHERE ma IS NOT NULL)"""


@query("w_05_regime_periods", f"""WITH {PANEL}, {_REG}, c AS (SELECT *, CASE WHEN lag(regime) OVER w IS DISTINCT FROM regime THEN 1 ELSE 0 END AS chg FROM t WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
 g AS (SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY dt) AS island FROM c)
 SELECT symbol, CAST(island AS BIGINT) AS island, regime, min(dt) AS start_dt, max(dt) AS end_dt, count(*) AS bars FROM g GROUP BY symbol, island, regime""")
def w05(spark, sf):
    d = panel(spark, sf).withColumn("ma", R.r_mean("close", 20)).where("ma is not null")
    d = islands(d.withColumn("regime", F.when(F.col("close") >= F.col("ma"), "up").otherwise("down")), "regime")
    return d.groupBy("symbol", "island", "regime").agg(F.min("dt").alias("start_dt"), F.max("dt").alias("end_dt"), F.count(F.lit(1)).alias("bars"))


@query("w_06_longest_streaks", f"""WITH {STAGED}, t AS (SELECT symbol, dt, CASE WHEN r > 0 THEN 'win' ELSE 'loss' END AS side FROM s WHERE r IS NOT NULL),
 c AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) - row_number() OVER (PARTITION BY symbol, side ORDER BY dt) AS g FROM t),
 n AS (SELECT symbol, side, g, count(*) AS n FROM c GROUP BY ALL)
 SELECT symbol, coalesce(max(CASE WHEN side = 'win' THEN n END), 0) AS longest_win, coalesce(max(CASE WHEN side = 'loss' THEN n END), 0) AS longest_loss FROM n GROUP BY symbol""")
def w06(spark, sf):
    d = with_stage_columns(panel(spark, sf)).where("r is not null").withColumn("side", F.when(F.col("r") > 0, "win").otherwise("loss"))
    n = islands(d, "side").groupBy("symbol", "side", "island").agg(F.count(F.lit(1)).alias("n"))
    best = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("n"))), F.lit(0))
    return n.groupBy("symbol").agg(best("win").alias("longest_win"), best("loss").alias("longest_loss"))
