"""G-01..G-07 gates and timing; P-01..P-12 schedule, selection, portfolio returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import position_count
from ..operators import gates as G
from ..operators import portfolio as PF
from ..operators import selection as S
from ..operators.cross_section import composite
from ..operators.factors import with_stage_columns
from ..operators.holding import grid_selection
from ..oracle.base import PANEL
from ..oracle.factors import STAGED
from ..oracle.holding import hysteresis
from ..oracle.research import LONG, avg_rank as rk
from ..sources.panel import panel
from ..sources.stages import stage
from ..sources.tables import FOREIGN_POOL
from .cross_section_queries import CW, combo_table
from .quality_queries import REG, REG_SQL, regimes
from .registry import query, rounded
from .research import std_long

FREQ, K, LOOKBACK = 4, 2, 24
DELTA, MIN_DAYS = 0.10, 9


def index(spark, sf):
    return stage(spark, sf, "index", lambda: G.market_index(panel(spark, sf)))


MI = """mi AS (SELECT dt, avg(close) AS px FROM panel GROUP BY dt), mr AS (SELECT *, px / lag(px) OVER (ORDER BY dt) - 1 AS ret FROM mi),
 mh AS (SELECT *, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w * sqrt(252) * 100 END AS hv FROM mr WINDOW w AS (ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 mv AS (SELECT *, (hv + lag(hv, 5) OVER o) / 2 AS vol, CASE WHEN count(px) OVER a = 20 THEN avg(px) OVER a END AS ma20, CASE WHEN count(px) OVER b = 60 THEN avg(px) OVER b END AS ma60, avg(px) OVER c AS ma200, lag(px, 20) OVER o AS px20
   FROM mh WINDOW o AS (ORDER BY dt), a AS (ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), c AS (ORDER BY dt ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))"""

VT = (150.0, 250.0, 350.0)


def _lad(ex, v="vol", th=VT):
    return f"CASE WHEN {v} >= {th[2]} THEN {ex[3]} WHEN {v} >= {th[1]} THEN {ex[2]} WHEN {v} >= {th[0]} THEN {ex[1]} ELSE {ex[0]} END"


VG = f"CAST({_lad(G.VOL_EXPOSURES)} AS DOUBLE)"


def vol_gate(spark, sf):
    return G.volatility_gate(index(spark, sf), thresholds=VT)


@query("g_01_volatility_gate", f"WITH {PANEL}, {MI} SELECT dt, round(vol, 4) AS vol, {VG} AS exposure, CAST({_lad(G.VOL_EXPOSURES, th=G.THRESHOLDS)} AS DOUBLE) AS default_exposure FROM mv")
def g01(spark, sf):
    d = G.volatility_gate(index(spark, sf)).select("dt", F.col("exposure").alias("default_exposure"))
    return vol_gate(spark, sf).join(d, "dt").select("dt", F.round("vol", 4).alias("vol"), "exposure", "default_exposure")


@query("g_02_trend_volatility_gate", f"WITH {PANEL}, {MI} SELECT dt, coalesce(ma20 >= ma60, false) AS uptrend, CAST(CASE WHEN coalesce(ma20 >= ma60, false) THEN {_lad(G.UP_EXPOSURES)} ELSE {_lad(G.DOWN_EXPOSURES)} END AS DOUBLE) AS exposure FROM mv")
def g02(spark, sf):
    return G.dual_gate(index(spark, sf), thresholds=VT).select("dt", "uptrend", "exposure")


_RM = "dt, round(px, 4) AS market_index, round(rr, 6) AS rolling_return, round(rv, 6) AS rolling_vol, round(rs, 6) AS rolling_sharpe, round(ma20, 4) AS ma20, round(ma60, 4) AS ma60, round(md, 6) AS ma_diff_pct, regime"


def _regime_out(d):
    d = d.select("dt", F.round("px", 4).alias("market_index"), "rolling_return", "rolling_vol", "rolling_sharpe", F.round("ma20", 4).alias("ma20"), F.round("ma60", 4).alias("ma60"), "ma_diff_pct", "regime")
    return rounded(d)


@query("g_03_market_regime", f"WITH {PANEL}, {REG} SELECT {_RM} FROM reg")
def g03(spark, sf):
    return _regime_out(regimes(spark, sf))


@query("g_03_market_regime_default", f"WITH {PANEL}, {REG_SQL.format(0.05, 0.20, 0.5, -0.05, 0.25)} SELECT {_RM} FROM reg")
def g03d(spark, sf):
    return _regime_out(G.market_regime(index(spark, sf)))


_GATES = f"""ga AS (SELECT 'volatility' AS mode, dt, {VG} AS e FROM mv UNION ALL SELECT 'regime', dt, CASE regime WHEN 'bull' THEN 1.0 WHEN 'bear' THEN 0.1 ELSE 0.7 END FROM reg),
 gs AS (SELECT mode, dt, greatest(0, least(1, coalesce(lag(e, 1) OVER (PARTITION BY mode ORDER BY dt), CASE mode WHEN 'volatility' THEN 1.0 ELSE 0.7 END))) AS exposure FROM ga)"""


def gates(spark, sf):
    a = G.shift_gate(vol_gate(spark, sf), 1, 1.0).withColumn("mode", F.lit("volatility"))
    b = G.shift_gate(G.regime_gate(regimes(spark, sf)), 1, 0.7).withColumn("mode", F.lit("regime"))
    return a.unionByName(b)


@query("g_04_gate_dispatch", f"WITH {PANEL}, {MI}, {REG.replace('mi AS', 'mi2 AS').replace('FROM mi)', 'FROM mi2)').replace('mr AS', 'mr2 AS').replace('FROM mr', 'FROM mr2')}, {_GATES} SELECT mode, dt, CAST(exposure AS DOUBLE) AS exposure FROM gs")
def g04(spark, sf):
    return gates(spark, sf).select("mode", "dt", "exposure")


@query("g_04_gate_stats", f"WITH {PANEL}, {MI}, {REG.replace('mi AS', 'mi2 AS').replace('FROM mi)', 'FROM mi2)').replace('mr AS', 'mr2 AS').replace('FROM mr', 'FROM mr2')}, {_GATES} SELECT mode, count(*) AS n, round(avg(exposure), 6) AS mean_exposure, CAST(min(exposure) AS DOUBLE) AS min_exposure, CAST(max(exposure) AS DOUBLE) AS max_exposure, round(avg(CAST(exposure < 1 AS INT)), 6) AS reduced_share FROM gs GROUP BY mode")
def g04s(spark, sf):
    g = gates(spark, sf)
    out = None
    for m in ("volatility", "regime"):
        d = G.gate_stats(g.where(F.col("mode") == m)).withColumn("mode", F.lit(m))
        out = d if out is None else out.unionByName(d)
    return rounded(out)


_LT = "0.4 * CASE WHEN m.px > m.ma200 THEN 1 ELSE -1 END + 0.4 * CASE WHEN m.px20 IS NULL OR m.px > m.px20 THEN 1 ELSE -1 END + 0.2 * CASE WHEN h.close > h.ma THEN 1 ELSE -1 END"


@query("g_05_light_timing", f"""WITH {PANEL}, {MI}, h AS (SELECT dt, close, avg(close) OVER (ORDER BY dt ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS ma FROM panel WHERE symbol = 'Brand#5')
 SELECT m.dt, CAST(round({_LT}, 6) AS DOUBLE) AS score, CAST(CASE WHEN round({_LT}, 6) < -0.4 THEN 0.3 ELSE 1.0 END AS DOUBLE) AS exposure FROM mv m LEFT JOIN h ON m.dt = h.dt""")
def g05(spark, sf):
    haven = panel(spark, sf).where("symbol = 'Brand#5'").select("dt", F.col("close").alias("px"))
    return G.light_timing(index(spark, sf), haven).select("dt", "score", "exposure")


@query("g_06_dual_timing", f"WITH {PANEL}, {MI}, t AS (SELECT symbol, dt, close >= avg(close) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS trend FROM panel WHERE close IS NOT NULL) SELECT symbol, t.dt, trend, CAST(CASE WHEN px > ma200 THEN 1.0 ELSE 0.1 END AS DOUBLE) AS position FROM t JOIN mv ON t.dt = mv.dt")
def g06(spark, sf):
    return G.dual_timing(panel(spark, sf), index(spark, sf))


@query("g_07_shift_signal", f"WITH {PANEL}, {MI} SELECT dt, CAST(coalesce(lag({VG}) OVER (ORDER BY dt), 1.0) AS DOUBLE) AS exposure FROM mv")
def g07(spark, sf):
    return G.shift_gate(vol_gate(spark, sf), 1, 1.0).select("dt", "exposure")


# ---------------------------------------------------------------- P


def days(spark, sf):
    return panel(spark, sf).select("dt", "bar").distinct()


@query("p_01_rebalance_schedule", f"WITH {PANEL} SELECT freq, CAST(bar AS INT) AS bar, dt FROM cal, (VALUES (3), (5), (8)) f(freq) WHERE bar >= {LOOKBACK} + 1 AND bar % freq = 0")
def p01(spark, sf):
    d = days(spark, sf)
    out = None
    for f in (3, 5, 8):
        x = G.schedule(d, f, LOOKBACK).select(F.lit(f).alias("freq"), "bar", "dt")
        out = x if out is None else out.unionByName(x)
    return out


ZONES = [(0.4, 1), (0.7, 2), (1.0, 3)]


@query("p_02_dynamic_position_count", f"WITH {PANEL}, {MI}, g AS (SELECT dt, coalesce(lag({VG}) OVER (ORDER BY dt), 1.0) AS e FROM mv) SELECT g.dt, CAST(e AS DOUBLE) AS exposure, CASE WHEN e <= 0.4 THEN 1 WHEN e <= 0.7 THEN 2 ELSE 3 END AS positions FROM g JOIN cal ON g.dt = cal.dt WHERE bar >= {LOOKBACK} + 1 AND bar % {FREQ} = 0")
def p02(spark, sf):
    g = G.shift_gate(vol_gate(spark, sf), 1, 1.0)
    d = G.schedule(days(spark, sf), FREQ, LOOKBACK).join(g, "dt")
    return d.select("dt", "exposure", position_count("exposure", ZONES, 1, 4).alias("positions"))


def _scores(spark, sf):
    """Composite scores of three combinations on the score row of every rebalance (the bar before it)."""
    s = composite(std_long(spark, sf), combo_table(spark))
    s = s.withColumn("score", F.when(F.round("score", 10) != 0, F.round("score", 10))).join(days(spark, sf), "dt")
    reb = G.schedule(days(spark, sf), FREQ, LOOKBACK).select((F.col("bar") - 1).alias("bar"), (F.col("bar") / FREQ).cast("int").alias("period"))
    pools = panel(spark, sf).select("symbol", "pool").distinct()
    return s.join(reb, "bar").join(pools, "symbol").select("combo", "period", "symbol", "pool", "score")


def scores(spark, sf):
    return stage(spark, sf, "combo_scores", lambda: _scores(spark, sf))


SC = f"""sc AS (SELECT combo, zl.dt, zl.bar, symbol, any_value(pool) AS pool, round(sum(coef * value), 10) AS s FROM zl JOIN cw ON zl.factor = cw.factor GROUP BY combo, zl.dt, zl.bar, symbol),
 sr AS MATERIALIZED (SELECT combo, CAST((bar + 1) // {FREQ} AS INT) AS period, symbol, pool, CASE WHEN s <> 0 THEN s END AS score FROM sc WHERE (bar + 1) % {FREQ} = 0 AND bar + 1 >= {LOOKBACK} + 1),
 hd AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY combo, period ORDER BY score DESC, symbol) AS pos FROM sr WHERE score IS NOT NULL) WHERE pos <= {K})"""


def plain_holdings(spark, sf):
    from ..functions.ranking import ordinal_rank

    d = scores(spark, sf).where("score is not null").withColumn("pos", ordinal_rank("score", ["combo", "period"], descending=True))
    return d.where(F.col("pos") <= K)


@query("p_03_pool_diversified_topk", f"""WITH {LONG}, {CW}, {SC}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY combo, period ORDER BY score DESC, symbol) AS pos FROM sr WHERE score IS NOT NULL) WHERE pos <= 6),
 a AS (SELECT * FROM c WHERE pos = 1), b AS (SELECT c.combo, c.period, coalesce(min(c.pos) FILTER (c.pool <> a.pool), min(c.pos)) AS pos FROM c JOIN a ON c.combo = a.combo AND c.period = a.period AND c.pos > 1 GROUP BY ALL)
 SELECT combo, period, 1 AS pick, symbol, pool, CAST(pos AS INT) AS pos FROM a UNION ALL SELECT c.combo, c.period, 2, c.symbol, c.pool, CAST(c.pos AS INT) FROM c JOIN b ON c.combo = b.combo AND c.period = b.period AND c.pos = b.pos""")
def p03(spark, sf):
    return S.pool_topk(scores(spark, sf), ["combo", "period"], 2, 6)


def held(spark, sf):
    def build():
        c = S.ranked_candidates(scores(spark, sf), ["combo", "period"])
        return grid_selection(c, ["combo"], [(DELTA, MIN_DAYS)], K, FREQ).drop("delta_rank", "min_days")

    return stage(spark, sf, "hysteresis", build)


_HY = hysteresis("sr", "combo", K, str(FREQ), [(DELTA, MIN_DAYS)])


@query("p_04_hysteresis_selection", f"WITH RECURSIVE {LONG}, {CW}, {SC}, {_HY} SELECT combo, period, symbol, hold_days FROM hy")
def p04(spark, sf):
    return held(spark, sf)


def returns_by_period(spark, sf, freq=FREQ, t1=False, gate=True):
    d = with_stage_columns(panel(spark, sf)).select("symbol", "pool", "dt", "bar", "r")
    e = G.shift_gate(vol_gate(spark, sf), 1, 1.0).select("dt", "exposure")
    d = d.join(e, "dt").withColumn("period", F.floor(F.col("bar") / freq).cast("int"))
    if not gate:
        d = d.withColumn("exposure", F.lit(1.0))
    start = d.where(F.col("bar") % freq == 0).select("period", F.col("exposure").alias("start_exposure")).distinct()
    d = d.join(start, "period")
    return d.where(F.col("bar") % freq != 0) if t1 else d


def costs(spark, sf, tier="med"):
    return panel(spark, sf).select("symbol", "pool").distinct().select("symbol", PF.cost_of(F.col("pool") == FOREIGN_POOL, tier).alias("cost"))


EXPO = f"ex AS (SELECT dt, coalesce(lag({VG}) OVER (ORDER BY dt), 1.0) AS e FROM mv), rp AS MATERIALIZED (SELECT s.symbol, s.pool, s.dt, s.bar, s.r, e, CAST(s.bar // {FREQ} AS INT) AS period, first_value(e) OVER (PARTITION BY s.symbol, s.bar // {FREQ} ORDER BY s.bar) AS e0 FROM s JOIN ex ON s.dt = ex.dt)"


def PR(name="pr", t1=False, hold="hd", keys="combo"):
    skip = f"AND r.bar % {FREQ} <> 0" if t1 else ""
    k = ", ".join(f"h.{c}" for c in keys.split(", "))
    on = " AND ".join(f"x.{c} = y.{c}" for c in keys.split(", "))
    return f"""{name}b AS (SELECT {k}, h.period, r.bar, avg(r.r) AS m, any_value(r.e) AS e FROM {hold} h JOIN rp r ON h.period = r.period AND h.symbol = r.symbol {skip} GROUP BY ALL),
 {name}g AS (SELECT {keys}, period, coalesce(exp(sum(ln(1 + m * e))) - 1, 0) AS gross FROM {name}b GROUP BY ALL),
 {name}p AS (SELECT {keys}, period, lag(period) OVER (PARTITION BY {keys} ORDER BY period) AS prev FROM (SELECT DISTINCT {keys}, period FROM {hold})),
 {name}t AS (SELECT {keys}, period, symbol FROM (SELECT {keys}, period, symbol, 1 AS d FROM {hold} UNION ALL SELECT {', '.join('x.' + c for c in keys.split(', '))}, y.period, symbol, -1 FROM {hold} x JOIN {name}p y ON {on} AND x.period = y.prev) GROUP BY ALL HAVING sum(d) <> 0),
 {name}c AS (SELECT {keys}, t.period, sum(CASE WHEN CAST(regexp_extract(t.symbol, '(\\d+)$', 1) AS INT) % 5 = 4 THEN 0.005 ELSE 0.002 END) AS c FROM {name}t t GROUP BY ALL),
 {name}0 AS (SELECT DISTINCT period, e0 FROM rp),
 {name} AS MATERIALIZED (SELECT {', '.join('g.' + c for c in keys.split(', '))}, g.period, gross, coalesce(c, 0) * e0 / {K} AS cost, gross - coalesce(c, 0) * e0 / {K} AS net FROM {name}g g LEFT JOIN {name}c c ON {' AND '.join(f'g.{c} = c.{c}' for c in keys.split(', '))} AND g.period = c.period LEFT JOIN {name}0 z ON g.period = z.period)"""


RETS = f"{LONG}, {CW}, {SC}, {MI}, {EXPO}"


def period_net(spark, sf):
    return stage(spark, sf, "period_net", lambda: PF.period_returns(plain_holdings(spark, sf), returns_by_period(spark, sf), costs(spark, sf), ["combo"], K))


@query("p_05_period_returns", f"WITH {RETS}, {PR()} SELECT combo, period, round(gross, 6) AS gross, round(cost, 6) AS cost, round(net, 6) AS net FROM pr")
def p05(spark, sf):
    return rounded(period_net(spark, sf))


@query("p_05_period_returns_next_open", f"WITH {RETS}, {PR(t1=True)} SELECT combo, period, round(gross, 6) AS gross, round(cost, 6) AS cost, round(net, 6) AS net FROM pr")
def p05t(spark, sf):
    return rounded(PF.period_returns(plain_holdings(spark, sf), returns_by_period(spark, sf, t1=True), costs(spark, sf), ["combo"], K))


@query("p_05_hysteresis_returns", f"WITH RECURSIVE {RETS}, {_HY}, {PR(hold='hy')} SELECT combo, period, round(gross, 6) AS gross, round(cost, 6) AS cost, round(net, 6) AS net FROM pr")
def p05h(spark, sf):
    return rounded(PF.period_returns(held(spark, sf), returns_by_period(spark, sf), costs(spark, sf), ["combo"], K))


@query("p_06_cost_scenarios", f"WITH {PANEL} SELECT symbol, scenario, t1_open, CASE WHEN pool = 4 THEN b ELSE a END AS cost FROM (SELECT DISTINCT symbol, pool FROM panel), (VALUES ('COC@2bp', false, 0.0002, 0.0002), ('T1_OPEN@2bp', true, 0.0002, 0.0002), ('T1_OPEN@low', true, 0.001, 0.003), ('T1_OPEN@med', true, 0.002, 0.005), ('T1_OPEN@high', true, 0.003, 0.008)) v(scenario, t1_open, a, b)".replace("THEN b ELSE a END", "THEN CAST(b AS DOUBLE) ELSE CAST(a AS DOUBLE) END"))
def p06(spark, sf):
    return PF.cost_grid(panel(spark, sf).select("symbol", "pool").distinct(), F.col("pool") == FOREIGN_POOL)


@query("p_07_equal_weight_benchmark", f"WITH {STAGED}, {MI}, ex AS (SELECT dt, coalesce(lag({VG}) OVER (ORDER BY dt), 1.0) AS e FROM mv) SELECT s.dt, round(avg(r) * any_value(e), 6) AS r FROM s JOIN ex ON s.dt = ex.dt GROUP BY s.dt")
def p07(spark, sf):
    d = with_stage_columns(panel(spark, sf))
    return rounded(PF.equal_weight(d, G.shift_gate(vol_gate(spark, sf), 1, 1.0)))


_RND = f"""rs AS (SELECT seed, CAST(bar // {FREQ} AS INT) AS period, symbol, (CAST('0x' || substr(md5(seed || ':' || CAST(dt AS VARCHAR) || ':' || symbol), 1, 12) AS BIGINT) % 1000003) / 1000003.0 AS score FROM panel, range(1, 21) g(seed) WHERE close IS NOT NULL AND bar % {FREQ} = 0 AND bar >= {LOOKBACK} + 1),
 rh AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, period ORDER BY score DESC, symbol) AS pos FROM rs) WHERE pos <= {K})"""
_EQS = f"""qe AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY seed ORDER BY period)) AS eq FROM pr), qd AS (SELECT *, 1 - eq / greatest(1, max(eq) OVER (PARTITION BY seed ORDER BY period)) AS dd FROM qe)
 SELECT seed, count(*) AS periods, round(sum(ln(1 + net)), 6) AS log_return, round(greatest(max(dd), 0), 6) AS max_drawdown, round(CASE WHEN count(*) >= 2 AND stddev_pop(net) > 1e-12 THEN avg(net) / stddev_pop(net) * sqrt(252.0 / {FREQ}) ELSE 0 END, 6) AS sharpe FROM qd GROUP BY seed"""


@query("p_07_random_baseline", f"WITH {RETS}, {_RND}, {PR(hold='rh', keys='seed')}, {_EQS}")
def p07r(spark, sf):
    from ..functions.ranking import ordinal_rank

    reb = G.schedule(days(spark, sf), FREQ, LOOKBACK).select("bar", (F.col("bar") / FREQ).cast("int").alias("period"))
    s = PF.random_scores(panel(spark, sf).where("close is not null"), 20).join(reb, "bar")
    h = s.withColumn("pos", ordinal_rank("score", ["seed", "period"], descending=True)).where(F.col("pos") <= K)
    p = PF.period_returns(h, returns_by_period(spark, sf), costs(spark, sf), ["seed"], K)
    return rounded(PF.equity_stats(p, ["seed"], F.lit(252.0 / FREQ)).withColumn("log_return", F.log1p("total_return")).drop("total_return"))


@query("p_08_trailing_stop_breach", f"""WITH {LONG}, {CW}, {SC}, hb AS (SELECT h.combo, p.symbol, p.dt, p.bar, p.high, p.low FROM hd h JOIN panel p ON h.symbol = p.symbol AND p.bar // {FREQ} = h.period),
 n AS (SELECT *, bar - row_number() OVER (PARTITION BY combo, symbol ORDER BY bar) AS g FROM hb), k AS (SELECT *, dense_rank() OVER (PARTITION BY combo, symbol ORDER BY g) AS spell, max(high) OVER (PARTITION BY combo, symbol, g ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) * (1 - 0.2) AS lvl FROM n)
 SELECT combo, symbol, spell, min(dt) AS breach_dt, round(arg_min(lvl, dt), 6) AS level, round(arg_min(low, dt), 6) AS low FROM k WHERE low < lvl GROUP BY ALL""")
def p08(spark, sf):
    p = panel(spark, sf).select("symbol", "dt", "bar", "high", "low", F.floor(F.col("bar") / FREQ).cast("int").alias("period"))
    hb = plain_holdings(spark, sf).select("combo", "period", "symbol").join(p, ["period", "symbol"])
    return rounded(PF.stop_breaches(PF.spells(hb, ["combo"]), 0.2, ["combo"]))


A, B = "MOM_20D + RET_VOL_20D", "CMF_20D + MOM_20D + VOL_RATIO_20D"


@query("p_09_strategy_overlap", f"""WITH {LONG}, {CW}, {SC}, u AS (SELECT period, symbol, count(*) AS c FROM hd WHERE combo IN ('{A}', '{B}') GROUP BY ALL), o AS (SELECT period, CAST(sum(CAST(c = 2 AS INT)) AS BIGINT) AS common, count(*) AS all_symbols, avg(CAST(c = 2 AS INT)) AS jaccard FROM u GROUP BY period),
 j AS (SELECT a.period, {rk('a.score', 'a.period')} AS x, {rk('b.score', 'a.period')} AS y FROM sr a JOIN sr b ON a.period = b.period AND a.symbol = b.symbol AND a.combo = '{A}' AND b.combo = '{B}' WHERE a.score IS NOT NULL AND b.score IS NOT NULL)
 SELECT o.period, common, all_symbols, round(jaccard, 6) AS jaccard, round(c, 6) AS score_rank_corr FROM o LEFT JOIN (SELECT period, corr(x, y) AS c FROM j GROUP BY period HAVING count(*) >= 5) q ON o.period = q.period""")
def p09(spark, sf):
    from ..operators.quality import rank_ic

    h, s = plain_holdings(spark, sf), scores(spark, sf)
    o = PF.holding_overlap(h.where(F.col("combo") == A), h.where(F.col("combo") == B))
    x = s.where(F.col("combo") == A).select("period", "symbol", F.col("score").alias("a")).join(s.where(F.col("combo") == B).select("period", "symbol", F.col("score").alias("b")), ["period", "symbol"])
    c = rank_ic(x, "b", ("period",), 5, "a").select("period", F.col("ic").alias("score_rank_corr"))
    return rounded(o.join(c, "period", "left"))


@query("p_10_target_weights", f"""WITH {LONG}, {CW}, {SC}, {MI}, ex AS (SELECT dt, coalesce(lag({VG}) OVER (ORDER BY dt), 1.0) AS e FROM mv), px AS (SELECT CAST(bar // {FREQ} AS INT) AS period, symbol, close AS price, e FROM panel JOIN ex ON panel.dt = ex.dt WHERE bar % {FREQ} = 0),
 v AS (SELECT period, symbol, count(*) AS votes FROM hd GROUP BY ALL) SELECT v.period, v.symbol, votes, round(votes / 6.0 * e, 6) AS weight, round(votes / 6.0 * e * 100000000, 2) AS target_value, CAST(floor(floor(votes / 6.0 * e * 100000000 / price) / 100) * 100 AS BIGINT) AS shares FROM v JOIN px ON v.period = px.period AND v.symbol = px.symbol""")
def p10(spark, sf):
    e = G.shift_gate(vol_gate(spark, sf), 1, 1.0).select("dt", "exposure")
    px = panel(spark, sf).where(F.col("bar") % FREQ == 0).join(e, "dt").select((F.col("bar") / FREQ).cast("int").alias("period"), "symbol", F.col("close").alias("price"), "exposure")
    d = PF.target_weights(plain_holdings(spark, sf), 3, K, F.col("exposure"), 1e8, px)
    return d.select("period", "symbol", "votes", F.round("weight", 6).alias("weight"), F.round("target_value", 2).alias("target_value"), "shares")


@query("p_11_pool_diagnostics", f"WITH {LONG}, {CW}, {SC}, p AS (SELECT combo, period, count(DISTINCT pool) AS pools, count(*) AS n FROM hd GROUP BY ALL) SELECT combo, count(*) AS decisions, round(avg(pools), 6) AS avg_pools, round(avg(CAST(pools = 1 AND n > 1 AS INT)), 6) AS same_pool_rate FROM p GROUP BY combo")
def p11(spark, sf):
    return rounded(PF.pool_diagnostics(plain_holdings(spark, sf), ["combo"]))


_VAR = "vs AS (SELECT 'all' AS variant, * FROM sr UNION ALL SELECT 'domestic', * FROM sr WHERE pool <> 4 UNION ALL SELECT 'core', * FROM sr WHERE pool IN (0, 1)), vh AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, combo, period ORDER BY score DESC, symbol) AS pos FROM vs WHERE score IS NOT NULL) WHERE pos <= 2)"


@query("p_12_universe_attribution", f"""WITH {RETS}, {_VAR}, {PR('vp', hold='vh', keys='variant, combo')}, dv AS (SELECT variant, combo, count(DISTINCT period) AS divergent FROM (SELECT variant, combo, period, symbol FROM vh WHERE variant <> 'all' EXCEPT SELECT variant, h.combo, h.period, h.symbol FROM vh h, (VALUES ('domestic'), ('core')) v(variant) WHERE h.variant = 'all') GROUP BY ALL),
 tot AS (SELECT variant, combo, count(*) AS periods, sum(ln(1 + net)) AS total FROM vp GROUP BY ALL)
 SELECT tot.variant, tot.combo, periods, round(total, 6) AS log_growth, coalesce(divergent, 0) AS divergent_periods FROM tot LEFT JOIN dv ON tot.variant = dv.variant AND tot.combo = dv.combo""".replace("vh h, (VALUES ('domestic'), ('core')) v(variant) WHERE h.variant = 'all'", "vh h, (VALUES ('domestic'), ('core')) v(vn) WHERE h.variant = 'all'").replace("EXCEPT SELECT variant, h.combo", "EXCEPT SELECT v.vn, h.combo"))
def p12(spark, sf):
    from ..functions.ranking import ordinal_rank

    s = scores(spark, sf)
    variants = F.array(F.lit("all"), F.when(F.col("pool") != FOREIGN_POOL, "domestic"), F.when(F.col("pool").isin(0, 1), "core"))
    v = s.where("score is not null").withColumn("variant", F.explode(F.array_compact(variants)))
    h = v.withColumn("pos", ordinal_rank("score", ["variant", "combo", "period"], descending=True)).where(F.col("pos") <= K)
    keys = ["variant", "combo"]
    p = PF.period_returns(h, returns_by_period(spark, sf), costs(spark, sf), keys, K)
    base = h.where("variant = 'all'").withColumn("variant", F.explode(F.array(F.lit("domestic"), F.lit("core"))))
    cols = [*keys, "period", "symbol"]
    div = h.where("variant <> 'all'").select(*cols).exceptAll(base.select(*cols)).groupBy(*keys).agg(F.countDistinct("period").alias("d"))
    g = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("periods"), F.sum(F.log1p("net")).alias("log_growth"))
    return rounded(g.join(div, keys, "left").select(*keys, "periods", "log_growth", F.coalesce("d", F.lit(0)).alias("divergent_periods")))
