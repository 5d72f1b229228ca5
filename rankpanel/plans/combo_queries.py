"""C-01..C-22: combinations and walk-forward scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.student import t_upper
from ..operators import enumeration as EN
from ..operators import mining as M
from ..operators import portfolio as PF
from ..operators import search as SR
from ..operators import selection as S
from ..operators import walkforward as WF
from ..operators.factors import CATALOG, with_stage_columns
from ..operators.holding import grid_selection
from ..oracle.base import PANEL
from ..oracle.holding import hysteresis
from ..oracle.research import LONG, ic_cte, t_two_sided as sql_t
from ..sources.panel import panel
from ..sources.stages import stage
from .mining_queries import _ASG, _SURV, ALG, BK_SQL, BUCKETS, bucket_table, survivor_names
from .portfolio_queries import costs
from .registry import query, rounded
from .research import std_long

IS_LEN, OOS_LEN, STEP = 100, 30, 30
FREQS = (3, 5)
FACTORS = ("CMF_20D", "MOM_20D", "PV_CORR_20D", "RET_VOL_20D", "SPREAD_PROXY", "VOL_RATIO_20D")
_FL = ", ".join(f"'{f}'" for f in FACTORS)


def zlong(spark, sf):
    return std_long(spark, sf).where(F.col("factor").isin(*FACTORS))


_NM = f"nm AS (SELECT DISTINCT factor AS f FROM zl WHERE factor IN ({_FL}))"
_C123 = f"{_NM}, cm AS (SELECT a.f || ' + ' || b.f AS combo, [a.f, b.f] AS names, 2 AS size FROM nm a JOIN nm b ON a.f < b.f UNION ALL SELECT a.f || ' + ' || b.f || ' + ' || c.f, [a.f, b.f, c.f], 3 FROM nm a JOIN nm b ON a.f < b.f JOIN nm c ON b.f < c.f)"


def combos(spark, sf):
    return stage(spark, sf, "combos", lambda: WF.enumerate_combos(zlong(spark, sf).select("factor").distinct(), [2, 3]))


@query("c_01_enumerate_combos", f"WITH {LONG}, {_C123} SELECT combo, size FROM cm")
def c01(spark, sf):
    return combos(spark, sf).select("combo", "size")


def traded_buckets(spark, sf):
    """Factors of the five bar buckets whose lookback fits into the panel's history."""
    bars = panel(spark, sf).agg((F.max("bar") + 1).alias("bars"))
    look = F.coalesce(F.try_element_at(F.regexp_extract_all("factor", F.lit(r"(\d+)")), F.lit(1)).cast("int"), F.lit(1))
    b = bucket_table(spark).where(~F.col("bucket").isin("FUND_FLOW", "LEVERAGE")).crossJoin(F.broadcast(bars))  # one row
    return stage(spark, sf, "buckets", lambda: b.where(F.col("bars") > look).select("factor", "bucket"))


_BSQL = f"""{BK_SQL}, b5 AS (SELECT * FROM bk WHERE bucket NOT IN ('FUND_FLOW', 'LEVERAGE')),
 k3 AS (SELECT [a.factor, b.factor, c.factor] AS names, [a.bucket, b.bucket, c.bucket] AS bks FROM b5 a JOIN b5 b ON a.factor < b.factor JOIN b5 c ON b.factor < c.factor),
 k4 AS (SELECT list_append(k.names, d.factor) AS names, list_append(k.bks, d.bucket) AS bks FROM k3 k JOIN b5 d ON k.names[3] < d.factor),
 ka AS (SELECT * FROM k3 UNION ALL SELECT * FROM k4)"""


@query("c_02_bucketed_combos", f"WITH {PANEL}, {_BSQL} SELECT array_to_string(names, ' + ') AS combo, len(names) AS size, len(list_distinct(bks)) AS n_buckets FROM ka WHERE len(list_distinct(bks)) >= 3 AND list_max(list_transform(bks, lambda x: len(list_filter(bks, lambda y: y = x)))) <= 2")
def c02(spark, sf):
    b = traded_buckets(spark, sf)
    d = WF.enumerate_bucketed(b, 3).unionByName(WF.enumerate_bucketed(b, 4))
    return d.select("combo", "size", "n_buckets")


def _grow(src: str, most: int, per_bucket: int = 0, per_parent: int = 0) -> str:
    """Combinations as lists, grown one larger name at a time."""
    cond = f" AND len(list_filter(bks, lambda x: x = n.bucket)) < {per_bucket}" if per_bucket else ""
    if per_parent:
        cond += f" AND len(list_filter(ps, lambda x: x = n.parents[1])) < {per_parent} AND (len(n.parents) = 1 OR len(list_filter(ps, lambda x: x = n.parents[2])) < {per_parent})"
    return f"""grow AS (SELECT [name] AS names, [bucket] AS bks, parents AS ps, 1 AS size FROM {src} UNION ALL
   SELECT list_append(names, n.name), list_append(bks, n.bucket), list_concat(ps, n.parents), size + 1 FROM grow JOIN {src} n ON n.name > names[-1] WHERE size < {most}{cond})"""


SIZES = tuple(range(2, 8))
_B17 = f"{BK_SQL}, n17 AS (SELECT factor AS name, bucket, [factor] AS parents FROM bk WHERE bucket NOT IN ('FUND_FLOW', 'LEVERAGE') AND (SELECT max(bar) + 1 FROM cal) > CAST(coalesce(nullif(regexp_extract(factor, '(\\d+)', 1), ''), '1') AS INT))"


@query("c_01_enumerate_combos_sizes", f"WITH RECURSIVE {PANEL}, {_B17}, {_grow('n17', 7)} SELECT array_to_string(names, ' + ') AS combo, size FROM grow WHERE size >= 2")
def c01s(spark, sf):
    """All sizes from 2 to 7 over the traded factors, by number."""
    return EN.combinations(traded_buckets(spark, sf), SIZES).select("combo", "size")


@query("c_02_bucketed_combos_sizes", f"WITH RECURSIVE {PANEL}, {_B17}, {_grow('n17', 7, 2)} SELECT array_to_string(names, ' + ') AS combo, size, len(list_distinct(bks)) AS n_buckets FROM grow WHERE size >= 2 AND len(list_distinct(bks)) >= least(3, size)")
def c02s(spark, sf):
    return EN.combinations(traded_buckets(spark, sf), SIZES, 3, 2).select("combo", "size", "n_buckets")


def survivor_buckets(spark, sf):
    """Survivors of the mining gates with the buckets that m_07 gives them."""
    return stage(spark, sf, "survivor_buckets", lambda: M.assign_buckets(survivor_names(spark, sf), bucket_table(spark)).select(F.col("name").alias("factor"), "bucket"))


_SV = f"""{ALG}, {ic_cte('ic', 'zl', 'fwd1')}, {_SURV}, {_ASG},
 sv AS MATERIALIZED (SELECT DISTINCT name, bucket, CASE WHEN len(string_split(name, '__')) = 3 THEN list_distinct([split_part(name, '__', 1), split_part(name, '__', 3)]) ELSE [name] END AS parents FROM asg WHERE bucket IS NOT NULL)"""


@query("c_02_survivor_combos", f"WITH RECURSIVE {_SV}, {_grow('sv', 3, 2, 2)} SELECT array_to_string(names, ' + ') AS combo, size, len(list_distinct(bks)) AS n_buckets FROM grow WHERE size = 3 AND len(list_distinct(bks)) >= 3")
def c02v(spark, sf):
    """Mined factors and plain ones together: bucket and parent limits."""
    return EN.combinations(survivor_buckets(spark, sf), [3], 3, 2, 2).select("combo", "size", "n_buckets")


@query("c_02_survivor_combo_counts", f"WITH RECURSIVE {_SV}, {_grow('sv', 5, 2, 2)} SELECT size, len(list_distinct(bks)) AS n_buckets, count(*) AS combos, min(array_to_string(names, ' + ')) AS first_combo, max(array_to_string(names, ' + ')) AS last_combo FROM grow WHERE size >= 3 AND len(list_distinct(bks)) >= 3 GROUP BY ALL")
def c02n(spark, sf):
    """How many there are of each size up to 5, with the first and the last of each."""
    d = EN.combinations(survivor_buckets(spark, sf), [3, 4, 5], 3, 2, 2)
    return d.groupBy("size", "n_buckets").agg(F.count(F.lit(1)).alias("combos"), F.min("combo").alias("first_combo"), F.max("combo").alias("last_combo"))


def n_bars(spark, sf):
    return panel(spark, sf).agg(F.max("bar")).first()[0] + 1


def windows(spark, sf):
    return WF.window_table(spark, n_bars(spark, sf), IS_LEN, OOS_LEN, STEP)


WIN = f"wn AS (SELECT CAST(k AS INT) AS win, k * {STEP} AS is_start, k * {STEP} + {IS_LEN} AS is_end, k * {STEP} + {IS_LEN} AS oos_start, k * {STEP} + {IS_LEN + OOS_LEN} AS oos_end FROM range(0, 1000) g(k) WHERE k * {STEP} + {IS_LEN + OOS_LEN} <= (SELECT max(bar) + 1 FROM cal))"


@query("c_03_walk_forward_windows", f"WITH {PANEL}, {WIN} SELECT win, a.dt AS is_start_dt, b.dt AS oos_start_dt, c.dt AS last_dt FROM wn JOIN cal a ON a.bar = is_start JOIN cal b ON b.bar = oos_start JOIN cal c ON c.bar = oos_end - 1")
def c03(spark, sf):
    cal = panel(spark, sf).select("bar", "dt").distinct()
    w = windows(spark, sf)
    at = lambda c, out: cal.select(F.col("bar").alias(c), F.col("dt").alias(out))
    w = w.withColumn("last", F.col("oos_end") - 1)
    w = w.join(at("is_start", "is_start_dt"), "is_start").join(at("oos_start", "oos_start_dt"), "oos_start").join(at("last", "last_dt"), "last")
    return w.select("win", "is_start_dt", "oos_start_dt", "last_dt")


_ISS = f"""od AS MATERIALIZED (SELECT factor, bar, round(corr(a, b), 12) AS ic FROM (SELECT factor, bar, row_number() OVER (PARTITION BY factor, bar ORDER BY value, symbol) AS a, row_number() OVER (PARTITION BY factor, bar ORDER BY r, symbol) AS b FROM zl WHERE r IS NOT NULL AND factor IN ({_FL})) GROUP BY factor, bar HAVING count(*) >= 3),
 iss AS MATERIALIZED (SELECT win, factor, avg(ic) AS ic FROM wn JOIN od ON bar >= is_start AND bar < is_end GROUP BY ALL)"""
_WGT = f"""e AS (SELECT combo, size, unnest(names) AS factor FROM cm), wt AS MATERIALIZED (SELECT combo, size, win, e.factor, ic, CASE WHEN sum(abs(ic)) OVER x > 0 THEN abs(ic) / sum(abs(ic)) OVER x ELSE 1.0 / size END AS weight, CASE WHEN abs(ic) < 0.01 OR ic >= 0 THEN 1.0 ELSE -1.0 END AS sgn FROM e JOIN iss ON e.factor = iss.factor WINDOW x AS (PARTITION BY combo, win))"""
_DEC = f"""fq(freq) AS (VALUES {', '.join(f'({f})' for f in FREQS)}), dc AS MATERIALIZED (SELECT win, freq, CAST(p AS INT) AS period, oos_start + p * freq - 1 AS sig_bar, oos_start + p * freq AS start_bar, least(oos_start + (p + 1) * freq, oos_end) AS end_bar FROM wn, fq, range(1, 100) g(p) WHERE p * freq < {OOS_LEN} AND least((p + 1) * freq, {OOS_LEN}) - p * freq >= 2)"""
_SIG = "sg AS MATERIALIZED (SELECT combo, wt.win, zl.bar AS sig_bar, symbol, round(sum(weight * sgn * value) / sum(weight), 12) AS signal FROM wt JOIN zl ON wt.factor = zl.factor JOIN (SELECT DISTINCT win, sig_bar FROM dc) d ON d.win = wt.win AND d.sig_bar = zl.bar GROUP BY ALL HAVING sum(weight) > 0)"
_CMP = "pc AS MATERIALIZED (SELECT win, freq, period, symbol, round(exp(coalesce(sum(ln(1 + r)), 0)) - 1, 12) AS c FROM dc JOIN s ON s.bar >= start_bar AND s.bar < end_bar GROUP BY ALL)"
_RIC = """ri0 AS (SELECT combo, sg.win, dc.freq, dc.period, row_number() OVER (PARTITION BY combo, sg.win, dc.freq, dc.period ORDER BY signal, sg.symbol) AS a, row_number() OVER (PARTITION BY combo, sg.win, dc.freq, dc.period ORDER BY c, sg.symbol) AS b FROM sg JOIN dc ON sg.win = dc.win AND sg.sig_bar = dc.sig_bar JOIN pc ON pc.win = dc.win AND pc.freq = dc.freq AND pc.period = dc.period AND pc.symbol = sg.symbol),
 ri1 AS (SELECT combo, win, freq, period, round(corr(a, b), 12) AS ic FROM ri0 GROUP BY ALL HAVING count(*) > 2),
 ri AS MATERIALIZED (SELECT combo, win, freq, avg(ic) AS mean_ic, CASE WHEN stddev_pop(ic) > 1e-12 THEN avg(ic) / stddev_pop(ic) ELSE 0 END AS ir, avg(CAST(ic > 0 AS INT)) AS positive_rate, count(*) AS n_periods FROM ri1 GROUP BY ALL)"""
_BST = "bs AS MATERIALIZED (SELECT combo, win, arg_max(freq, (round(mean_ic, 10), -freq)) AS freq, arg_max(mean_ic, (round(mean_ic, 10), -freq)) AS mean_ic, arg_max(ir, (round(mean_ic, 10), -freq)) AS ir, arg_max(positive_rate, (round(mean_ic, 10), -freq)) AS positive_rate FROM ri GROUP BY ALL)"
WFO = f"{LONG}, {_C123}, {WIN}, {_ISS}, {_WGT}, {_DEC}, {_SIG}, {_CMP}, {_RIC}, {_BST}"


def is_stats(spark, sf):
    return stage(spark, sf, "is_stats", lambda: WF.is_statistics(zlong(spark, sf), IS_LEN, OOS_LEN, STEP))


@query("c_04_in_sample_statistics", f"WITH {LONG}, {WIN}, {_ISS} SELECT win, factor, round(ic, 6) AS ic FROM iss")
def c04(spark, sf):
    return rounded(is_stats(spark, sf))


def weights(spark, sf):
    return stage(spark, sf, "weights", lambda: WF.combo_weights(combos(spark, sf), is_stats(spark, sf)))


@query("c_05_combo_weights", f"WITH {LONG}, {_C123}, {WIN}, {_ISS}, {_WGT} SELECT combo, win, factor, round(weight, 6) AS weight, CAST(sgn AS DOUBLE) AS sign FROM wt")
def c05(spark, sf):
    return rounded(weights(spark, sf).select("combo", "win", "factor", "weight", "sign"))


def decisions(spark, sf):
    return stage(spark, sf, "decisions", lambda: WF.decision_table(windows(spark, sf), FREQS))


def returns_panel(spark, sf):
    return with_stage_columns(panel(spark, sf)).select("symbol", "dt", "bar", "pool", "r")


def compounded(spark, sf):
    return stage(spark, sf, "compounded", lambda: WF.period_compound(returns_panel(spark, sf), decisions(spark, sf)))


def rebalanced(spark, sf):
    def build():
        sig = WF.combo_signals(weights(spark, sf), zlong(spark, sf), decisions(spark, sf))
        return WF.rebalanced_ic(sig, decisions(spark, sf), compounded(spark, sf))

    return stage(spark, sf, "rebalanced", build)


_RC = "round(mean_ic, 6) AS mean_ic, round(ir, 6) AS ir, round(positive_rate, 6) AS positive_rate"


@query("c_06_out_of_sample_ic", f"WITH {WFO} SELECT combo, win, freq, {_RC}, n_periods FROM ri")
def c06(spark, sf):
    return rounded(rebalanced(spark, sf))


@query("c_06_out_of_sample_ic_blocks", f"WITH {WFO} SELECT combo, win, freq, {_RC}, n_periods FROM ri")
def c06m(spark, sf):
    return rounded(WF.matrix_ic(combos(spark, sf), weights(spark, sf), zlong(spark, sf), decisions(spark, sf), compounded(spark, sf), FACTORS))


def best(spark, sf):
    return stage(spark, sf, "best_freq", lambda: WF.best_frequency(rebalanced(spark, sf)))


@query("c_07_best_frequency", f"WITH {WFO} SELECT combo, win, freq, {_RC} FROM bs")
def c07(spark, sf):
    return rounded(best(spark, sf).select("combo", "win", "freq", "mean_ic", "ir", "positive_rate"))


TOP, DELTA, MIN_DAYS = 2, 0.10, 9


def warm_candidates(spark, sf):
    """Ranked scores of every decision from the start of each window, at the window's best frequency."""

    def build():
        dec = WF.decision_table(windows(spark, sf), FREQS, with_is=True)
        b = best(spark, sf).select("combo", "win", "freq")
        rows = dec.join(b.select("win", "freq").distinct(), ["win", "freq"])
        sig = WF.combo_signals(weights(spark, sf), zlong(spark, sf), rows).join(b, ["combo", "win"])
        sig = sig.join(dec.select("win", "freq", "period", "sig_bar"), ["win", "freq", "sig_bar"]).withColumnRenamed("signal", "score")
        return S.ranked_candidates(sig, ["combo", "win", "period"])

    return stage(spark, sf, "warm_candidates", build)


def grid_periods(spark, sf, cand, points, keys=("combo", "win", "freq")):
    """Out-of-sample period returns of every strategy at every (delta, min_days), positions warmed up in sample."""
    dec = WF.decision_table(windows(spark, sf), FREQS, with_is=True)
    r = WF.period_bars(dec).join(returns_panel(spark, sf).select("symbol", "bar", "r"), "bar")
    r = r.select("win", "freq", "period", "symbol", "bar", "r", F.lit(1.0).alias("exposure"), F.lit(1.0).alias("start_exposure"))
    hold = grid_selection(cand, keys, points, TOP)
    p = PF.period_returns(hold, r, costs(spark, sf), [*keys, "delta_rank", "min_days"], TOP, ["win", "freq"])
    return p.join(dec.where("oos").select("win", "freq", "period"), ["win", "freq", "period"], "left_semi")


def oos_periods(spark, sf, delta=DELTA, min_days=MIN_DAYS):
    """Out-of-sample period returns at each window's best frequency, positions warmed up in sample."""
    return stage(spark, sf, f"oos_periods:{delta}:{min_days}", lambda: grid_periods(spark, sf, warm_candidates(spark, sf), [(delta, min_days)]).drop("delta_rank", "min_days"))


def oos_perf(spark, sf):
    return stage(spark, sf, "oos_perf", lambda: PF.equity_stats(oos_periods(spark, sf), ["combo", "win", "freq"], 252.0 / F.col("freq")))


_DEC2 = f"d2 AS MATERIALIZED (SELECT win, freq, CAST(p AS INT) AS period, is_start + p * freq - 1 AS sig_bar, is_start + p * freq AS start_bar, least(is_start + (p + 1) * freq, oos_end) AS end_bar, is_start + p * freq >= oos_start AS oos FROM wn, fq, range(1, 100) g(p) WHERE p * freq < {IS_LEN + OOS_LEN} AND least((p + 1) * freq, {IS_LEN + OOS_LEN}) - p * freq >= 2)"
_Q2 = f"{_DEC2}, q2 AS MATERIALIZED (SELECT wt.combo, wt.win, d2.freq, d2.period, d2.start_bar, d2.end_bar, d2.oos, zl.symbol, round(sum(weight * sgn * value) / sum(weight), 12) AS signal FROM wt JOIN zl ON wt.factor = zl.factor JOIN bs ON bs.combo = wt.combo AND bs.win = wt.win JOIN d2 ON d2.win = wt.win AND d2.freq = bs.freq AND d2.sig_bar = zl.bar GROUP BY ALL)"


def _net(hold: str, keys: str = "combo, win, freq") -> str:
    """Net period returns `n2` of the holdings `hold` (keys, period, symbol, start_bar, end_bar, oos)."""
    of = lambda a: ", ".join(f"{a}.{c}" for c in keys.split(", "))
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys.split(", "))
    return f"""b2 AS (SELECT {keys}, period, s.bar, avg(s.r) AS m FROM {hold} h JOIN s ON s.symbol = h.symbol AND s.bar >= start_bar AND s.bar < end_bar WHERE oos GROUP BY ALL), g2 AS (SELECT {keys}, period, coalesce(exp(sum(ln(1 + m))) - 1, 0) AS gross FROM b2 GROUP BY ALL),
 p2 AS (SELECT *, lag(period) OVER (PARTITION BY {keys} ORDER BY period) AS prev FROM (SELECT DISTINCT {keys}, period FROM {hold})),
 t2 AS (SELECT {keys}, period, symbol FROM (SELECT {keys}, period, symbol, 1 AS d FROM {hold} UNION ALL SELECT {of('a')}, b.period, a.symbol, -1 FROM {hold} a JOIN p2 b ON {on('a', 'b')} AND b.prev = a.period) GROUP BY ALL HAVING sum(d) <> 0),
 k2 AS (SELECT {keys}, period, sum(CASE WHEN CAST(regexp_extract(symbol, '(\\d+)$', 1) AS INT) % 5 = 4 THEN 0.005 ELSE 0.002 END) / {TOP} AS c FROM t2 GROUP BY ALL),
 n2 AS MATERIALIZED (SELECT g2.*, gross - coalesce(c, 0) AS net FROM g2 LEFT JOIN k2 ON {on('g2', 'k2')} AND g2.period = k2.period)"""


_PLAIN = f"{_Q2}, h2 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY combo, win, period ORDER BY signal DESC, symbol) AS pos FROM q2) WHERE pos <= {TOP}), {_net('h2')}"
_SRC2 = "q3 AS (SELECT combo, win, freq, period, symbol, signal AS score FROM q2)"


def _warm(points, keys="combo, win, freq") -> str:
    """Holdings under hysteresis with their bars, and their net returns."""
    return f"{_Q2}, {_SRC2}, {hysteresis('q3', 'combo, win, freq', TOP, 'd.freq', points)}, h3 AS MATERIALIZED (SELECT hy.*, start_bar, end_bar, oos FROM hy JOIN d2 ON d2.win = hy.win AND d2.freq = hy.freq AND d2.period = hy.period), {_net('h3', keys)}"


def _stats(keys: str = "combo, win, freq") -> str:
    return f"""e2 AS (SELECT *, exp(sum(ln(1 + net)) OVER w) AS eq FROM n2 WINDOW w AS (PARTITION BY {keys} ORDER BY period)),
 f2 AS (SELECT *, 1 - eq / greatest(1, max(eq) OVER (PARTITION BY {keys} ORDER BY period)) AS dd FROM e2),
 st2 AS MATERIALIZED (SELECT {keys}, count(*) AS periods, exp(sum(ln(1 + net))) - 1 AS total_return, greatest(max(dd), 0) AS max_drawdown, CASE WHEN count(*) >= 2 AND stddev_pop(net) > 1e-12 THEN avg(net) / stddev_pop(net) * sqrt(252.0 / freq) ELSE 0 END AS sharpe FROM f2 GROUP BY {keys})"""


_OOS = f"{_warm([(DELTA, MIN_DAYS)])}, {_stats()}"
_R3 = "round(ln(1 + total_return), 6) AS log_return, round(max_drawdown, 6) AS max_drawdown, round(sharpe, 6) AS sharpe"


@query("c_08_out_of_sample_returns", f"WITH RECURSIVE {WFO}, {_OOS} SELECT combo, win, freq, periods, {_R3} FROM st2")
def c08(spark, sf):
    """Growth as a logarithm: long compounding leaves no digits after the point to compare."""
    return rounded(oos_perf(spark, sf).withColumn("log_return", F.log1p("total_return")).drop("total_return"))


@query("c_08_out_of_sample_returns_plain", f"WITH {WFO}, {_PLAIN} SELECT combo, win, freq, count(*) AS periods, round(sum(ln(1 + net)), 6) AS log_growth, round(CASE WHEN count(*) >= 2 AND stddev_pop(net) > 1e-12 THEN avg(net) / stddev_pop(net) * sqrt(252.0 / freq) ELSE 0 END, 6) AS sharpe FROM n2 GROUP BY combo, win, freq")
def c08p(spark, sf):
    p = oos_periods(spark, sf, 0.0, 0)
    st = PF.equity_stats(p, ["combo", "win", "freq"], 252.0 / F.col("freq")).select("combo", "win", "freq", "periods", "sharpe")
    g = p.groupBy("combo", "win", "freq").agg(F.sum(F.log1p("net")).alias("log_growth"))
    return rounded(st.join(g, ["combo", "win", "freq"]))


@query("c_09_consensus_direction", f"""WITH {LONG}, {_C123}, {WIN}, {_ISS}, {_WGT}, g AS (SELECT combo, factor, avg(ic) AS m, greatest(coalesce(stddev_samp(ic), 0), 0.01) AS sd, abs(avg(sign(ic))) AS st FROM wt GROUP BY ALL)
 SELECT combo, factor, CASE WHEN st < 0.8 THEN 1 WHEN m < 0 THEN -1 ELSE 1 END AS consensus_sign, round(st, 6) AS sign_stability, round(m / sd, 6) AS icir FROM g""")
def c09(spark, sf):
    return rounded(WF.consensus(weights(spark, sf)))


_COL = """co AS (SELECT combo, count(*) AS windows, avg(mean_ic) AS mean_oos_ic, stddev_pop(mean_ic) AS oos_ic_std, stddev_samp(mean_ic) AS s1, avg(ir) AS mean_oos_ir, avg(positive_rate) AS mean_positive_rate FROM bs GROUP BY combo),
 fm AS (SELECT combo, arg_max(freq, (c, -w)) AS best_freq FROM (SELECT combo, freq, count(*) AS c, min(win) AS w FROM bs GROUP BY ALL) GROUP BY combo),
 cl AS MATERIALIZED (SELECT co.*, best_freq, len(string_split(co.combo, ' + ')) AS size, 0.5 * mean_oos_ic + 0.3 * mean_oos_ir + 0.2 * mean_positive_rate - 0.1 * oos_ic_std - 0.01 * len(string_split(co.combo, ' + ')) AS stability_score FROM co JOIN fm ON co.combo = fm.combo)"""


def collapsed(spark, sf):
    return stage(spark, sf, "collapsed", lambda: WF.collapse(best(spark, sf), None))


@query("c_10_combo_aggregates", f"WITH {WFO}, {_COL} SELECT combo, windows, round(mean_oos_ic, 6) AS mean_oos_ic, round(oos_ic_std, 6) AS oos_ic_std, round(mean_oos_ir, 6) AS mean_oos_ir, round(mean_positive_rate, 6) AS mean_positive_rate, best_freq FROM cl")
def c10(spark, sf):
    return rounded(collapsed(spark, sf).select("combo", "windows", "mean_oos_ic", "oos_ic_std", "mean_oos_ir", "mean_positive_rate", "best_freq"))


_PERF = "cp AS MATERIALIZED (SELECT st2.combo, avg(total_return) AS mean_oos_return, exp(sum(ln(1 + total_return))) - 1 AS cum_oos_return, avg(sharpe) AS mean_oos_sharpe, avg(max_drawdown) AS mean_oos_maxdd FROM st2 GROUP BY st2.combo)"


@query("c_10_combo_performance", f"WITH RECURSIVE {WFO}, {_OOS}, {_PERF} SELECT combo, round(ln(1 + mean_oos_return), 6) AS log_mean_return, round(ln(1 + cum_oos_return), 6) AS log_cum_return, round(mean_oos_sharpe, 6) AS mean_oos_sharpe, round(mean_oos_maxdd, 6) AS mean_oos_maxdd FROM cp")
def c10p(spark, sf):
    d = WF.collapse(best(spark, sf), oos_perf(spark, sf).drop("freq"))
    return rounded(d.select("combo", F.log1p("mean_oos_return").alias("log_mean_return"), F.log1p("cum_oos_return").alias("log_cum_return"), "mean_oos_sharpe", "mean_oos_maxdd"))


@query("c_11_stability_score", f"WITH {WFO}, {_COL} SELECT combo, size, round(stability_score, 6) AS stability_score FROM cl")
def c11(spark, sf):
    return rounded(collapsed(spark, sf).select("combo", "size", "stability_score"))


_SG = f"""tt AS (SELECT combo, mean_oos_ic / (s1 / sqrt(windows)) AS t, windows FROM cl), pv AS (SELECT combo, round(CASE WHEN t >= 0 THEN {sql_t('t', '(windows - 1)')} / 2 ELSE 1 - {sql_t('t', '(windows - 1)')} / 2 END, 10) AS p_value FROM tt), po AS (SELECT *, row_number() OVER (ORDER BY p_value, combo) AS i, count(*) OVER () AS n FROM pv),
 pq AS (SELECT combo, p_value, least(1.0, min(p_value * n / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value FROM po)"""


@query("c_12_significance", f"WITH {WFO}, {_COL}, {_SG} SELECT combo, round(p_value, 6) AS p_value, round(q_value, 6) AS q_value, q_value < 0.05 AS is_significant FROM pq")
def c12(spark, sf):
    d = collapsed(spark, sf)
    t = F.try_divide(F.col("mean_oos_ic"), F.col("s1") / F.sqrt("windows"))
    d = d.select("combo", F.when(F.col("windows") < 2, F.lit(1.0)).otherwise(F.round(t_upper(t, F.col("windows") - 1), 10)).alias("p_value"))
    q = M.benjamini_hochberg(d, "p_value", "combo")
    return rounded(q.select("combo", "p_value", "q_value", (F.col("q_value") < 0.05).alias("is_significant")))


_RU = lambda c, hi=True: f"{'' if hi else '1 - '}((rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 - 1) / greatest(count(*) OVER () - 1, 1))"
_RP = lambda c, hi=True: f"{'' if hi else '1 - '}((rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ())"
_R10 = "cr AS (SELECT combo, size, round(mean_oos_ic, 10) AS a, round(mean_oos_ir, 10) AS b, round(oos_ic_std, 10) AS c, round(mean_positive_rate, 10) AS d, round(stability_score, 10) AS st FROM cl)"


def rounded10(spark, sf):
    d = collapsed(spark, sf)
    return d.select("combo", "size", *[F.round(c, 10).alias(o) for c, o in (("mean_oos_ic", "a"), ("mean_oos_ir", "b"), ("oos_ic_std", "c"), ("mean_positive_rate", "d"), ("stability_score", "st"))])


@query("c_13_execution_score", f"WITH {WFO}, {_COL}, {_R10} SELECT combo, round(0.4 * {_RU('a')} + 0.3 * {_RU('b')} + 0.3 * ({_RU('c', False)}), 6) AS execution_score FROM cr")
def c13(spark, sf):
    d = SR.rank_scores(rounded10(spark, sf), [("a", 0.4, True), ("b", 0.3, True), ("c", 0.3, False)], "execution_score")
    return rounded(d.select("combo", "execution_score"))


@query("c_13_execution_score_returns", f"WITH RECURSIVE {WFO}, {_OOS}, {_PERF}, ce AS (SELECT combo, round(ln(1 + mean_oos_return), 8) AS x, round(mean_oos_sharpe, 8) AS y, round(mean_oos_maxdd, 8) AS z FROM cp) SELECT combo, round(0.4 * {_RU('x')} + 0.3 * {_RU('y')} + 0.3 * ({_RU('z', False)}), 6) AS execution_score FROM ce")
def c13r(spark, sf):
    d = WF.collapse(best(spark, sf), oos_perf(spark, sf).drop("freq"))
    d = d.select("combo", F.round(F.log1p("mean_oos_return"), 8).alias("mean_oos_return"), *[F.round(c, 8).alias(c) for c in ("mean_oos_sharpe", "mean_oos_maxdd")])
    d = SR.rank_scores(d, [("mean_oos_return", 0.4, True), ("mean_oos_sharpe", 0.3, True), ("mean_oos_maxdd", 0.3, False)], "execution_score")
    return rounded(d.select("combo", "execution_score"))


@query("c_14_composite_score", f"WITH {WFO}, {_COL}, {_R10} SELECT combo, round(0.4 * {_RP('a')} + 0.3 * {_RP('b')} + 0.3 * ({_RP('c', False)}), 6) AS composite_score, round(0.45 * {_RP('a')} + 0.2 * {_RP('b')} + 0.2 * {_RP('d')} + 0.15 * ({_RP('c', False)}), 6) AS production_score FROM cr")
def c14(spark, sf):
    d = SR.rank_scores(rounded10(spark, sf), [("a", 0.4, True), ("b", 0.3, True), ("c", 0.3, False)], "composite_score", "pct")
    d = SR.rank_scores(d, [("a", 0.45, True), ("b", 0.2, True), ("d", 0.2, True), ("c", 0.15, False)], "production_score", "pct")
    return rounded(d.select("combo", "composite_score", "production_score"))


@query("c_15_threshold_gates", f"WITH {WFO}, {_COL}, {_R10}, q AS (SELECT quantile_cont(a, 0.5) AS qa, quantile_cont(c, 0.7) AS qc FROM cr) SELECT combo, a > 0.05 OR d > 0.55 AS basic_gate, a >= qa AND c <= qc AS quantile_gate, CASE WHEN a > 0.1 AND d > 0.6 THEN 'ultra' WHEN a > 0.05 AND d > 0.55 THEN 'strict' WHEN a > 0 THEN 'relaxed' ELSE 'none' END AS preset FROM cr, q")
def c15(spark, sf):
    d = SR.with_quantiles(rounded10(spark, sf), [("a", 0.5), ("c", 0.7)])
    a, dd = F.col("a"), F.col("d")
    preset = F.when((a > 0.1) & (dd > 0.6), "ultra").when((a > 0.05) & (dd > 0.55), "strict").when(a > 0, "relaxed").otherwise("none")
    return d.select("combo", ((a > 0.05) | (dd > 0.55)).alias("basic_gate"), ((a >= F.col("a_q0")) & (F.col("c") <= F.col("c_q1"))).alias("quantile_gate"), preset.alias("preset"))


def calibration(spark, sf):
    """One row per combination in as few files as its size asks for: every job of a fit reads it again."""

    def build():
        d = rounded10(spark, sf).join(WF.collapse(best(spark, sf), oos_perf(spark, sf).drop("freq")).select("combo", "mean_oos_sharpe"), "combo")
        return d.withColumn("size", F.col("size").cast("double")).hint("rebalance")

    return stage(spark, sf, "calibration", build)


def _calibrated(spark, sf, model):
    fitted, scored = SR.calibrate(calibration(spark, sf), "combo", ["a", "b", "c", "d", "size"], "mean_oos_sharpe", model)
    return rounded(scored.select("combo", "prediction", F.col("mean_oos_sharpe").alias("actual"), F.lit(min(fitted.avgMetrics)).alias("cv_rmse")), 4)


@query("c_16_calibrated_ranking_ridge")
def c16(spark, sf):
    return _calibrated(spark, sf, "ridge")


@query("c_16_calibrated_ranking_trees")
def c16t(spark, sf):
    return _calibrated(spark, sf, "gbt")


def named(spark, sf):
    from ..functions.expr import names_of

    return rounded10(spark, sf).withColumn("names", names_of("combo"))


@query("c_17_diverse_top")
def c17(spark, sf):
    return SR.chosen_frame(spark, SR.diverse_top(named(spark, sf), "st", 5, 0.4), "st")


@query("c_18_greedy_basket")
def c18(spark, sf):
    # one return series per combination: windows follow each other in time
    p = oos_periods(spark, sf, 0.0, 0).select("combo", F.format_string("%010d.%010d", "win", "period").alias("period"), "net")
    return SR.chosen_frame(spark, SR.basket(named(spark, sf), p, "st", 4, 0.1, 0.1, 0.5, 0.95), "objective")


@query("c_19_subset_scores")
def c19(spark, sf):
    from .portfolio_queries import plain_holdings, scores  # noqa: F401

    top = named(spark, sf)  # every combination enters the exhaustive score
    last = S.ranked_candidates(
        WF.combo_signals(weights(spark, sf), zlong(spark, sf), decisions(spark, sf)).withColumnRenamed("signal", "score").where(F.col("win") == n_windows_last(spark, sf)),
        ["combo", "sig_bar"],
    ).where("pos <= 2")
    picks = last.groupBy("combo").agg(F.array_sort(F.collect_set("symbol")).alias("picks"))
    items = top.join(picks, "combo").select("combo", F.col("st").alias("quality"), "names", "picks")
    return rounded(SR.subset_scores(items, 3, 0.1, 0.1))


def n_windows_last(spark, sf):
    return WF.n_windows(n_bars(spark, sf), IS_LEN, OOS_LEN, STEP) - 1


_TG = "jn AS (SELECT combo, a, b, c, d FROM cr), g1 AS (SELECT *, a > 0 AS g_train, d >= 0.5 AS g_roll, b > 0 AS g_hold FROM jn)"


@query("c_20_triple_gate", f"""WITH {WFO}, {_COL}, {_R10}, {_TG}, f AS (SELECT * FROM g1 WHERE g_train AND g_roll AND g_hold), r AS (SELECT combo, round(0.3 * {_RP('a')} + 0.4 * {_RP('d')} + 0.3 * {_RP('b')}, 6) AS composite_score FROM f)
 SELECT g1.combo, CASE WHEN NOT g_train THEN 'train' WHEN NOT g_roll THEN 'rolling' WHEN NOT g_hold THEN 'holdout' ELSE 'passed' END AS stopped_at, composite_score FROM g1 LEFT JOIN r ON g1.combo = r.combo""")
def c20(spark, sf):
    d = rounded10(spark, sf)
    g = [F.col("a") > 0, F.col("d") >= 0.5, F.col("b") > 0]
    stop = F.when(~g[0], "train").when(~g[1], "rolling").when(~g[2], "holdout").otherwise("passed")
    d = d.withColumn("stopped_at", stop)
    f = SR.rank_scores(d.where("stopped_at = 'passed'").select("combo", "a", "b", "d"), [("a", 0.3, True), ("d", 0.4, True), ("b", 0.3, True)], "composite_score", "pct")
    return rounded(d.select("combo", "stopped_at").join(f.select("combo", "composite_score"), "combo", "left"))


@query("c_20_triple_gate_funnel", f"WITH {WFO}, {_COL}, {_R10}, {_TG} " + " UNION ALL ".join(f"SELECT {i} AS position, '{n}' AS gate, CAST(sum(CAST({b} AND NOT {c} AS INT)) AS BIGINT) AS eliminated, CAST(sum(CAST({b} AND {c} AS INT)) AS BIGINT) AS remaining FROM g1" for i, (n, b, c) in enumerate((("train", "true", "g_train"), ("rolling", "g_train", "g_roll"), ("holdout", "g_train AND g_roll", "g_hold")))))
def c20f(spark, sf):
    d = rounded10(spark, sf)
    return M.gate_cascade(d, [("train", F.col("a") > 0), ("rolling", F.col("d") >= 0.5), ("holdout", F.col("b") > 0)])


_AR = lambda c, desc: f"(rank() OVER (ORDER BY {c}{' DESC' if desc else ''}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query("c_21_grades", f"WITH {WFO}, {_COL}, {_R10}, w AS (SELECT combo, round(0.4 * {_AR('a', True)} + 0.3 * {_AR('b', True)} + 0.3 * {_AR('c', False)}, 8) AS score_rank FROM cr), p AS (SELECT *, row_number() OVER (ORDER BY score_rank, combo) AS pos, count(*) OVER () AS n FROM w) SELECT combo, score_rank, CASE WHEN pos <= floor(n * 0.1) THEN 'A' WHEN pos <= floor(n * 0.3) THEN 'B' WHEN pos <= floor(n * 0.6) THEN 'C' ELSE 'D' END AS grade FROM p")
def c21(spark, sf):
    d = SR.rank_scores(rounded10(spark, sf), [("a", 0.4, True), ("b", 0.3, True), ("c", 0.3, False)], "score_rank", "rank")
    return SR.grades(d.select("combo", F.round("score_rank", 8).alias("score_rank")), "score_rank")


DELTAS, HOLDS = (0.0, 0.05, 0.10, 0.20), (0, 6, 9, 18)
GRID = [(d, m) for d in DELTAS for m in HOLDS]
_MED = "count(*) AS n, round(median(total_return), 6) AS median_return, round(median(sharpe), 6) AS median_sharpe, round(median(max_drawdown), 6) AS median_drawdown"


def _medians(st, *by):
    return rounded(st.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median("total_return").alias("median_return"), F.median("sharpe").alias("median_sharpe"), F.median("max_drawdown").alias("median_drawdown")))


@query("c_22_parameter_grid", f"WITH RECURSIVE {WFO}, {_warm(GRID, 'combo, win, freq, dl, md')}, {_stats('combo, win, freq, dl, md')} SELECT dl AS delta_rank, md AS min_days, {_MED} FROM st2 GROUP BY ALL")
def c22(spark, sf):
    """Hysteresis gap x minimum hold over all combinations and windows, folded together; medians per grid point."""
    p = grid_periods(spark, sf, warm_candidates(spark, sf), GRID)
    return _medians(PF.equity_stats(p, ["combo", "win", "freq", "delta_rank", "min_days"], 252.0 / F.col("freq")), "delta_rank", "min_days")


_Q2F = _Q2.replace(" JOIN bs ON bs.combo = wt.combo AND bs.win = wt.win", "").replace(" AND d2.freq = bs.freq", "")
_F3 = [(0.0, 0), (DELTA, MIN_DAYS)]


@query("c_22_parameter_grid_frequency", f"WITH RECURSIVE {WFO}, {_warm(_F3, 'combo, win, freq, dl, md').replace(_Q2, _Q2F)}, {_stats('combo, win, freq, dl, md')} SELECT freq, dl AS delta_rank, md AS min_days, {_MED} FROM st2 GROUP BY freq, dl, md")
def c22f(spark, sf):
    """Frequency x hysteresis: every combination and window at every frequency, not only at its best one."""

    def build():
        dec = WF.decision_table(windows(spark, sf), FREQS, with_is=True)
        sig = WF.combo_signals(weights(spark, sf), zlong(spark, sf), dec).join(dec.select("win", "freq", "period", "sig_bar"), ["win", "sig_bar"])
        return S.ranked_candidates(sig.withColumnRenamed("signal", "score"), ["combo", "win", "freq", "period"])

    p = grid_periods(spark, sf, stage(spark, sf, "grid_candidates", build), _F3)
    return _medians(PF.equity_stats(p, ["combo", "win", "freq", "delta_rank", "min_days"], 252.0 / F.col("freq")), "freq", "delta_rank", "min_days")
