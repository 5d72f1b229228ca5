"""R-01..R-24 on five return series (one per pool, a tenth of the mean log return)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import compound, corr, ratio
from ..operators import gates as G
from ..operators import paths as PT
from ..operators import portfolio as PF
from ..operators import risk as R
from ..operators.factors import with_stage_columns
from ..oracle.factors import STAGED
from ..sources.panel import panel
from ..sources.stages import stage
from ..sources.tables import table
from .portfolio_queries import EXPO, FREQ, K, MI, RETS, PR, days, period_net, plain_holdings, vol_gate
from .registry import query, rounded
from .relational_queries import RUNS_SQL, runs
from .side_queries import islands

SER = STAGED + """, ser AS MATERIALIZED (SELECT 'pool_' || pool AS combo, dt, bar, round(exp(0.1 * avg(ln(1 + r))) - 1, 12) AS r FROM s WHERE r IS NOT NULL GROUP BY pool, dt, bar),
 eq AS MATERIALIZED (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY combo ORDER BY dt)) AS eq FROM ser)"""
CUT = "1999-10-01"


def series(spark, sf):
    d = with_stage_columns(panel(spark, sf)).where("r is not null")
    return stage(spark, sf, "series", lambda: d.groupBy(F.concat(F.lit("pool_"), F.col("pool")).alias("combo"), "dt", "bar").agg(F.round(F.exp(0.1 * F.avg(F.log1p("r"))) - 1, 12).alias("r")))


def curves(spark, sf):
    return R.equity(series(spark, sf))


def WM(src, keys):
    k = keys
    return f"""SELECT {k}, n, total_return, max_drawdown, CASE WHEN sd > 1e-12 THEN m / sd * sqrt(252) END AS sharpe, CASE WHEN max_drawdown < -1e-10 THEN (power(1 + total_return, 252.0 / k_) - 1) / abs(max_drawdown) END AS calmar FROM (
 SELECT {k}, count(*) AS n, arg_max(eq, dt) / arg_min(eq, dt) - 1 AS total_return, min(dd) AS max_drawdown, avg(ret) AS m, stddev_samp(ret) AS sd, count(ret) AS k_ FROM (
 SELECT *, eq / max(eq) OVER (PARTITION BY {k} ORDER BY dt) - 1 AS dd, eq / lag(eq) OVER (PARTITION BY {k} ORDER BY dt) - 1 AS ret FROM {src}) GROUP BY {k})"""


WC = "n, round(total_return, 6) AS total_return, round(max_drawdown, 6) AS max_drawdown, round(sharpe, 6) AS sharpe, round(calmar, 4) AS calmar"


def wm(d, keys):
    return rounded(R.window_metrics(d, keys).withColumn("calmar", F.round("calmar", 4)))


@query("r_01_window_metrics", f"WITH {SER} SELECT combo, {WC} FROM ({WM('eq', 'combo')})")
def r01(spark, sf):
    return wm(curves(spark, sf), ["combo"])


_TS = """SELECT combo, count(r) AS n, round(avg(r), 8) AS mean, round(stddev_samp(r), 8) AS std, round(max(r), 6) AS best, round(min(r), 6) AS worst, round(avg(CAST(r > 0 AS INT)), 6) AS win_rate, round(avg(r) FILTER (r > 0), 6) AS avg_win, round(avg(r) FILTER (r <= 0), 6) AS avg_loss,
 round(abs(sum(r) FILTER (r > 0) / sum(r) FILTER (r <= 0)), 6) AS profit_factor, round(abs(avg(r) FILTER (r > 0) / avg(r) FILTER (r <= 0)), 6) AS payoff, round(avg(r), 6) AS expectancy, round(stddev_samp(r) * sqrt(252), 6) AS annual_vol"""
_POP = "round((avg(power(r, 3)) - 3 * avg(r) * avg(r * r) + 2 * power(avg(r), 3)) / power(stddev_pop(r), 3), 5) AS skew, round((avg(power(r, 4)) - 4 * avg(r) * avg(power(r, 3)) + 6 * power(avg(r), 2) * avg(r * r) - 3 * power(avg(r), 4)) / power(stddev_pop(r), 4) - 3, 5) AS kurt"
TS_ALL = f"WITH {SER} {_TS}, {_POP} FROM ser GROUP BY combo"


def stats(spark, sf):
    d = R.trade_statistics(series(spark, sf))
    return rounded(d.withColumn("mean", F.round("mean", 8)).withColumn("std", F.round("std", 8)).withColumn("skew", F.round("skew", 5)).withColumn("kurt", F.round("kurt", 5)), 8).select(
        "combo", "n", "mean", "std", *[F.round(c, 6).alias(c) for c in ("best", "worst", "win_rate", "avg_win", "avg_loss", "profit_factor", "payoff", "expectancy", "annual_vol")], "skew", "kurt")


@query("r_02_full_metrics", f"WITH {RETS}, {PR()} SELECT combo, count(*) AS periods, round(avg(CAST(net > 0 AS INT)), 6) AS win_rate, round(sum(gross) - sum(net), 6) AS cost_drag, round(sum(cost), 6) AS total_cost, round(CASE WHEN sum(net) FILTER (net <= 0) <> 0 THEN abs(sum(net) FILTER (net > 0) / sum(net) FILTER (net <= 0)) END, 4) AS profit_factor FROM pr GROUP BY combo")
def r02(spark, sf):
    n = F.col("net")
    lo = F.sum(F.when(n <= 0, n))
    return rounded(period_net(spark, sf).groupBy("combo").agg(
        F.count(F.lit(1)).alias("periods"), F.avg((n > 0).cast("double")).alias("win_rate"), (F.sum("gross") - F.sum("net")).alias("cost_drag"), F.sum("cost").alias("total_cost"),
        F.round(F.when(lo != 0, F.abs(F.sum(F.when(n > 0, n)) / lo)), 4).alias("profit_factor")))


@query("r_02_annual_metrics", f"WITH {RETS}, {PR()}, tc AS (SELECT combo, count(*) AS changes FROM prt GROUP BY combo) SELECT pr.combo, round(sum(ln(1 + net)) * (252.0 / {FREQ}) / count(*), 6) AS log_annual_return, round(stddev_samp(net) * sqrt(252.0 / {FREQ}), 6) AS annual_volatility, round(any_value(changes) / (2.0 * {K} * count(*)), 6) AS turnover FROM pr JOIN tc ON tc.combo = pr.combo GROUP BY pr.combo")
def r02a(spark, sf):
    """Annual growth (as a logarithm), volatility, and the share of positions exchanged at a decision."""
    changes = PF.turnover(plain_holdings(spark, sf), ["combo"]).groupBy("combo").agg(F.count(F.lit(1)).alias("changes"))
    g = period_net(spark, sf).groupBy("combo").agg(F.count(F.lit(1)).alias("n"), F.sum(F.log1p("net")).alias("growth"), F.stddev_samp("net").alias("s"))
    year = 252.0 / FREQ
    return rounded(g.join(changes, "combo").select("combo", (F.col("growth") * year / F.col("n")).alias("log_annual_return"), (F.col("s") * year**0.5).alias("annual_volatility"), (F.col("changes") / (2.0 * K * F.col("n"))).alias("turnover")))


@query("r_03_calendar_segments", f"WITH {SER}, q AS (SELECT *, CAST(date_trunc('quarter', dt) AS DATE) AS segment FROM eq), g AS ({WM('q', 'combo, segment')}) SELECT g.combo, g.segment, {WC}, h.first_dt > DATE '{CUT}' AS holdout FROM g JOIN (SELECT combo, segment, min(dt) AS first_dt FROM q GROUP BY ALL) h ON g.combo = h.combo AND g.segment = h.segment")
def r03(spark, sf):
    return segments(spark, sf)


def segments(spark, sf):
    d = curves(spark, sf).withColumn("segment", F.to_date(F.date_trunc("quarter", "dt")))
    first = d.groupBy("combo", "segment").agg((F.min("dt") > F.to_date(F.lit(CUT))).alias("holdout"))
    return wm(d, ["combo", "segment"]).join(first, ["combo", "segment"])


@query("r_04_segment_summary", f"WITH {SER}, q AS (SELECT *, CAST(date_trunc('quarter', dt) AS DATE) AS segment FROM eq), g AS ({WM('q', 'combo, segment')}) SELECT combo, count(*) AS segments, round(avg(CAST(total_return > 0 AS INT)), 6) AS positive_rate, round(min(total_return), 6) AS worst_return, round(median(total_return), 6) AS median_return FROM g GROUP BY combo")
def r04(spark, sf):
    d = curves(spark, sf).withColumn("segment", F.to_date(F.date_trunc("quarter", "dt")))
    m = R.window_metrics(d, ["combo", "segment"])
    return rounded(m.groupBy("combo").agg(F.count(F.lit(1)).alias("segments"), F.avg((F.col("total_return") > 0).cast("double")).alias("positive_rate"), F.min("total_return").alias("worst_return"), F.median("total_return").alias("median_return")))


@query("r_05_holdout_metrics", f"WITH {SER}, q AS (SELECT *, CASE WHEN dt >= DATE '{CUT}' THEN 'holdout' ELSE 'train' END AS part FROM eq) SELECT combo, part, {WC} FROM ({WM('q', 'combo, part')})")
def r05(spark, sf):
    return wm(curves(spark, sf).withColumn("part", F.when(F.col("dt") >= F.to_date(F.lit(CUT)), "holdout").otherwise("train")), ["combo", "part"])


@query("r_06_rolling_windows", f"WITH {SER}, i AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY dt) - 1 AS i FROM eq), q AS (SELECT i.*, CAST(k AS INT) AS win FROM i, range(0, 200) g(k) WHERE i >= k * 21 AND i < k * 21 + 126 AND k * 21 + 126 <= (SELECT max(i) + 1 FROM i)) SELECT combo, win, {WC} FROM ({WM('q', 'combo, win')})")
def r06(spark, sf):
    from pyspark.sql import Window as W

    d = curves(spark, sf).withColumn("i", F.row_number().over(W.partitionBy("combo").orderBy("dt")) - 1)
    return wm(R.overlapping_windows(d, 126, 21), ["combo", "win"])


@query("r_06_worst_month", f"WITH {SER}, m AS (SELECT combo, CAST(date_trunc('month', dt) AS DATE) AS month, round(exp(sum(ln(1 + r))) - 1, 10) AS r FROM ser GROUP BY ALL) SELECT combo, count(*) AS months, arg_min(month, (r, month)) AS worst_month, round(min(r), 6) AS worst_return, round(avg(CAST(r > 0 AS INT)), 6) AS positive_rate FROM m GROUP BY combo")
def r06m(spark, sf):
    m = series(spark, sf).groupBy("combo", F.to_date(F.date_trunc("month", "dt")).alias("month")).agg(F.round(compound("r"), 10).alias("r"))
    return rounded(m.groupBy("combo").agg(F.count(F.lit(1)).alias("months"), F.min_by("month", F.struct("r", "month")).alias("worst_month"), F.min("r").alias("worst_return"), F.avg((F.col("r") > 0).cast("double")).alias("positive_rate")))


@query("r_07_period_pnl", f"WITH {SER} SELECT combo, CAST(bar // 5 AS BIGINT) AS period, count(*) AS bars, round(exp(sum(ln(1 + r))) - 1, 6) AS pnl FROM ser GROUP BY ALL")
def r07(spark, sf):
    return rounded(series(spark, sf).groupBy("combo", F.floor(F.col("bar") / 5).alias("period")).agg(F.count(F.lit(1)).alias("bars"), compound("r").alias("pnl")))


@query("r_08_pnl_concentration", f"""WITH {SER}, o AS (SELECT combo, r, count(*) OVER c AS n, row_number() OVER (PARTITION BY combo ORDER BY r DESC, dt) AS t, row_number() OVER (PARTITION BY combo ORDER BY abs(r), dt) AS i FROM ser WINDOW c AS (PARTITION BY combo))
 SELECT combo, any_value(n) AS n, round(sum(r) FILTER (t <= greatest(1, ceil(n * 0.2))) / sum(r), 5) AS top20_share, round(sum((2 * i - n - 1) * abs(r)) / (any_value(n) * sum(abs(r))), 6) AS gini FROM o GROUP BY combo""")
def r08(spark, sf):
    d = R.concentration(series(spark, sf))
    return rounded(d.withColumn("top20_share", F.round("top20_share", 5)))


@query("r_08_streaks", f"""WITH {SER}, c AS (SELECT *, CASE WHEN r > 0 THEN 'win' ELSE 'loss' END AS side FROM ser), g AS (SELECT combo, side, row_number() OVER (PARTITION BY combo ORDER BY dt) - row_number() OVER (PARTITION BY combo, side ORDER BY dt) AS g FROM c), n AS (SELECT combo, side, g, count(*) AS n FROM g GROUP BY ALL)
 SELECT combo, max(n) FILTER (side = 'win') AS longest_win, max(n) FILTER (side = 'loss') AS longest_loss FROM n GROUP BY combo""")
def r08s(spark, sf):
    d = series(spark, sf).withColumn("side", F.when(F.col("r") > 0, "win").otherwise("loss"))
    n = islands(d, "side", "combo").groupBy("combo", "side", "island").agg(F.count(F.lit(1)).alias("n"))
    top = lambda s: F.max(F.when(F.col("side") == s, F.col("n")))
    return n.groupBy("combo").agg(top("win").alias("longest_win"), top("loss").alias("longest_loss"))


@query("r_09_trade_statistics", TS_ALL)
def r09(spark, sf):
    return stats(spark, sf)


# two-sided and power quantiles of the normal distribution; fixed values
Z = {0.05: 1.959963984540054, 0.01: 2.5758293035489004}
ZB = 0.8416212335729143


@query("r_10_required_sample", f"WITH {SER}, o AS (SELECT combo, abs(avg(r) / stddev_samp(r)) * sqrt(50.4) AS sh FROM ser GROUP BY combo) SELECT combo, alpha, target, CAST(ceil(power(z + {ZB}, 2) * 50.4 / power(CASE WHEN target = 0 THEN greatest(sh, 0.1) ELSE target END, 2)) AS BIGINT) AS trades FROM o, (VALUES (0.05, {Z[0.05]}), (0.01, {Z[0.01]})) a(alpha, z), (VALUES (0.0), (0.5), (1.0), (1.5)) t(target)".replace("combo, alpha, target", "combo, CAST(alpha AS DOUBLE) AS alpha, CAST(target AS DOUBLE) AS target"))
def r10(spark, sf):
    o = series(spark, sf).groupBy("combo").agg((F.abs(F.avg("r") / F.stddev_samp("r")) * F.sqrt(F.lit(50.4))).alias("sh"))
    rows = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(z).alias("z"), F.lit(t).alias("target")) for a, z in Z.items() for t in (0.0, 0.5, 1.0, 1.5)])
    d = o.select("combo", "sh", F.inline(rows))
    eff = F.when(F.col("target") == 0, F.greatest("sh", F.lit(0.1))).otherwise(F.col("target"))
    return d.select("combo", "alpha", "target", F.ceil(F.pow(F.col("z") + ZB, 2) * 50.4 / (eff * eff)).alias("trades"))


@query("r_11_drawdown_episodes", f"""WITH {SER}, d AS (SELECT *, eq / max(eq) OVER (PARTITION BY combo ORDER BY dt) - 1 AS dd FROM eq), n AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY combo ORDER BY dt) AS run FROM d), f AS (SELECT *, min(CASE WHEN dd < -0.05 THEN dt END) OVER (PARTITION BY combo, run) AS fst FROM n),
 e AS (SELECT combo, run, min(dt) AS start_dt, arg_min(dt, dd) AS trough_dt, round(min(dd), 6) AS depth, count(*) AS bars FROM f WHERE fst IS NOT NULL AND dt >= fst AND dd < 0 GROUP BY ALL) SELECT e.combo, start_dt, trough_dt, n.dt AS end_dt, depth, bars FROM e LEFT JOIN n ON n.combo = e.combo AND n.run = e.run + 1 AND n.dd >= 0""")
def r11(spark, sf):
    return rounded(R.episodes(curves(spark, sf)))


def _draws(n_boot: int, block: int, seed: int, size: str = "n") -> str:
    """Every draw written out row by row: `bt` with one row of path statistics for each (combo, boot)."""
    start = f"CAST('0x' || substr(md5('{seed}:' || boot || ':' || blk), 1, 12) AS BIGINT) % (n - {block} + 1)"
    return f"""bn AS (SELECT combo, count(*) AS n, least({size}, count(*)) AS len FROM ser GROUP BY combo), bp AS (SELECT combo, row_number() OVER (PARTITION BY combo ORDER BY dt) - 1 AS pos, r FROM ser),
 bd AS (SELECT combo, boot, blk, len, {start} AS start FROM (SELECT *, unnest(range(CAST(ceil(len / {block}.0) AS BIGINT))) AS blk FROM (SELECT *, unnest(range(1, {n_boot + 1})) AS boot FROM bn))),
 br AS (SELECT bd.combo, boot, len, blk * {block} + k AS i, r FROM bd, range(0, {block}) g(k) JOIN bp ON bp.combo = bd.combo AND bp.pos = bd.start + k WHERE blk * {block} + k < len),
 bf AS (SELECT *, e / max(e) OVER (PARTITION BY combo, boot ORDER BY i) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY combo, boot ORDER BY i)) AS e FROM br)),
 bt AS (SELECT combo, boot, arg_max(e, i) - 1 AS total_return, power(arg_max(e, i), 252.0 / count(*)) - 1 AS annual_return, (power(arg_max(e, i), 252.0 / count(*)) - 1) / (stddev_samp(r) * sqrt(252)) AS sharpe, min(dd) AS max_drawdown FROM bf GROUP BY combo, boot)"""


_PCT = lambda c, out: ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {out}_p{int(p * 100)}" for p in (0.05, 0.5, 0.95))


@query("r_12_block_bootstrap", f"WITH {SER}, {_draws(200, 10, 7)} SELECT combo, count(*) AS draws, {_PCT('total_return', 'return')}, {_PCT('annual_return', 'annual')}, round(avg(sharpe), 6) AS mean_sharpe, round(quantile_cont(max_drawdown, 0.01), 6) AS drawdown_p1 FROM bt GROUP BY combo")
def r12(spark, sf):
    b = PT.bootstrap(series(spark, sf), 200, 10, 7)
    pct = lambda c, out: [F.percentile(c, p).alias(f"{out}_p{int(p * 100)}") for p in (0.05, 0.5, 0.95)]
    return rounded(b.groupBy("combo").agg(
        F.count(F.lit(1)).alias("draws"), *pct("total_return", "return"), *pct("annual_return", "annual"),
        F.avg("sharpe").alias("mean_sharpe"), F.percentile("max_drawdown", 0.01).alias("drawdown_p1")))


@query("r_12_block_bootstrap_half_year", f"WITH {SER}, {_draws(200, 10, 11, '126')} SELECT combo, count(*) AS draws, round(avg(total_return), 6) AS mean_return, round(quantile_cont(max_drawdown, 0.01), 6) AS drawdown_p1 FROM bt GROUP BY combo")
def r12h(spark, sf):
    b = PT.bootstrap(series(spark, sf), 200, 10, 11, 126)
    return rounded(b.groupBy("combo").agg(F.count(F.lit(1)).alias("draws"), F.avg("total_return").alias("mean_return"), F.percentile("max_drawdown", 0.01).alias("drawdown_p1")))


def _falls(src: str, keys: str, order: str) -> str:
    """Falls below 5 % of the rows `src` (keys, order, dd)."""
    k, on = (f"{keys}, ", "".join(f" AND x.{c} = y.{c}" for c in keys.split(", "))) if keys else ("", "")
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""fa AS MATERIALIZED (SELECT *, sum(CAST(dd >= 0 AS INT)) OVER ({part}ORDER BY {order}) AS run, row_number() OVER ({part}ORDER BY {order}) AS no FROM {src}),
 fp AS (SELECT {k}run, {order} AS peak, no AS peak_no FROM fa WHERE dd >= 0), fl AS (SELECT {k}run, min(dd) AS depth, arg_min({order}, (dd, {order})) AS trough, arg_min(no, (dd, {order})) AS trough_no, max(no) AS last_no, min({order}) FILTER (dd < -0.05) AS below FROM fa WHERE dd < 0 GROUP BY ALL HAVING min(dd) < -0.05),
 fe AS (SELECT {''.join(f'x.{c}, ' for c in keys.split(', ')) if keys else ''}y.peak, below, trough, z.peak AS recovery, depth, trough_no - y.peak_no AS bars_down, z.peak_no - trough_no AS bars_up, last_no - y.peak_no AS bars_under
   FROM fl x JOIN fp y ON x.run = y.run{on} LEFT JOIN fp z ON z.run = x.run + 1{on.replace('y.', 'z.')})"""


@query("r_11_largest_drawdown", f"WITH {SER}, dq AS (SELECT combo, dt, eq / max(eq) OVER (PARTITION BY combo ORDER BY dt) - 1 AS dd FROM eq), {_falls('dq', 'combo', 'dt')} SELECT combo, peak AS peak_dt, trough AS trough_dt, recovery AS recovery_dt, round(depth, 6) AS depth, bars_down, bars_up, bars_under FROM fe QUALIFY row_number() OVER (PARTITION BY combo ORDER BY depth, peak) = 1")
def r11l(spark, sf):
    """Peak, trough and recovery of the deepest fall of each series, the series cut into ranges."""
    d = PT.drawdowns(PT.running_drawdown(series(spark, sf).select("combo", "dt", "r")))
    best = d.groupBy("combo").agg(F.min_by(F.struct(*[c for c in d.columns if c != "combo"]), F.struct("depth", "peak")).alias("x"))
    return rounded(best.select("combo", F.col("x.peak").alias("peak_dt"), F.col("x.trough").alias("trough_dt"), F.col("x.recovery").alias("recovery_dt"), "x.depth", "x.bars_down", "x.bars_up", "x.bars_under"))


# one long series: every event in order, its value as a small return
_EV = "ev AS (SELECT event_id, (value - 50) / 5000 AS r FROM events WHERE value IS NOT NULL), ee AS (SELECT *, exp(sum(ln(1 + r)) OVER (ORDER BY event_id)) AS eq FROM ev), ed AS MATERIALIZED (SELECT event_id, eq, max(eq) OVER (ORDER BY event_id) AS high, eq / max(eq) OVER (ORDER BY event_id) - 1 AS dd FROM ee)"


def event_curve(spark, sf):
    d = table(spark, sf, "events").where("value IS NOT NULL").select("event_id", ((F.col("value") - 50) / 5000).alias("r"))
    return stage(spark, sf, "event_curve", lambda: PT.running_drawdown(d, [], ["event_id"]))


@query("w_02_running_drawdown_long", f"WITH {_EV} SELECT event_id, round(eq, 6) AS eq, round(high, 6) AS high, round(dd, 6) AS dd FROM ed")
def w02l(spark, sf):
    return rounded(event_curve(spark, sf).select("event_id", "eq", "high", "dd"))


@query("r_11_drawdown_episodes_long", f"WITH {_EV}, {_falls('ed', '', 'event_id')} SELECT peak, below, trough, recovery, round(depth, 6) AS depth, bars_down, bars_up, bars_under FROM fe")
def r11g(spark, sf):
    return rounded(PT.drawdowns(event_curve(spark, sf), [], order="event_id"))


@query("w_06_longest_streaks_long", "WITH s AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events), n AS (SELECT event_type, count(*) AS length, min(event_id) AS first_event FROM s GROUP BY event_type, g) SELECT event_type, max(length) AS longest, arg_min(first_event, (-length, first_event)) AS first_event, count(*) AS streaks FROM n GROUP BY event_type")
def w06l(spark, sf):
    """Longest runs of one event type in the order of all events."""
    d = PT.streaks(table(spark, sf, "events"), [], ["event_id"], F.col("event_type"))
    d = d.select(F.col("kind").alias("event_type"), "length", F.col("first.event_id").alias("first_event"))
    return d.groupBy("event_type").agg(F.max("length").alias("longest"), F.min_by("first_event", F.struct((-F.col("length")).alias("l"), "first_event")).alias("first_event"), F.count(F.lit(1)).alias("streaks"))


@query("r_13_live_consistency", f"""WITH {SER}, h AS (SELECT combo, avg(r) FILTER (dt < DATE '2001-07-01') AS mu, stddev_samp(r) FILTER (dt < DATE '2001-07-01') AS sg, exp(sum(ln(1 + r)) FILTER (dt >= DATE '2001-07-01')) - 1 AS live, count(*) FILTER (dt >= DATE '2001-07-01') AS k FROM ser GROUP BY combo)
 SELECT combo, round(live, 6) AS live_return, round(power(1 + mu, k) - 1, 6) AS expected, round((live - (power(1 + mu, k) - 1)) / (sg * sqrt(k)), 6) AS z_score, CASE WHEN live < power(1 + mu, k) - 1 - 1.96 * sg * sqrt(k) THEN 'UNDERPERFORMING' WHEN live > power(1 + mu, k) - 1 + 1.96 * sg * sqrt(k) THEN 'OUTPERFORMING' ELSE 'CONSISTENT' END AS assessment FROM h""")
def r13(spark, sf):
    live = F.col("dt") >= F.to_date(F.lit("2001-07-01"))
    h = series(spark, sf).groupBy("combo").agg(
        F.avg(F.when(~live, F.col("r"))).alias("mu"), F.stddev_samp(F.when(~live, F.col("r"))).alias("sg"), compound(F.when(live, F.col("r"))).alias("live_return"), F.count(F.when(live, 1)).alias("k"))
    h = h.withColumn("expected", F.pow(1 + F.col("mu"), F.col("k")) - 1).withColumn("sd", F.col("sg") * F.sqrt("k"))
    z = F.try_divide(F.col("live_return") - F.col("expected"), F.col("sd"))
    word = F.when(z < -1.96, "UNDERPERFORMING").when(z > 1.96, "OUTPERFORMING").otherwise("CONSISTENT")
    return rounded(h.select("combo", "live_return", "expected", z.alias("z_score"), word.alias("assessment")))


@query("r_13_stopping_boundaries", f"WITH {SER}, n AS (SELECT combo, avg(r) / (stddev_samp(r) / sqrt(count(*))) AS z, count(*) AS k FROM ser GROUP BY combo) SELECT combo, CAST(look AS INT) AS look, CAST(ceil(k * look / 4.0) AS BIGINT) AS rows_at_look, round({Z[0.05]} / sqrt(look / 4.0), 3) AS z_boundary, abs(z) > {Z[0.05]} / sqrt(look / 4.0) AS stopped FROM n, range(1, 5) g(look)")
def r13b(spark, sf):
    n = series(spark, sf).groupBy("combo").agg((F.avg("r") / (F.stddev_samp("r") / F.sqrt(F.count("r")))).alias("z"), F.count("r").alias("k"))
    d = n.withColumn("look", F.explode(F.sequence(F.lit(1), F.lit(4))))
    b = F.lit(Z[0.05]) / F.sqrt(F.col("look") / 4.0)
    return d.select("combo", "look", F.ceil(F.col("k") * F.col("look") / 4.0).alias("rows_at_look"), F.round(b, 3).alias("z_boundary"), (F.abs("z") > b).alias("stopped"))


@query("r_14_period_returns", f"WITH {SER}, m AS (SELECT combo, CAST(date_trunc('month', dt) AS DATE) AS month, exp(sum(ln(1 + r))) - 1 AS ret FROM ser GROUP BY ALL) SELECT combo, year(month) AS yr, " + ", ".join(f"round(max(ret) FILTER (month(month) = {k}), 6) AS m{k:02d}" for k in range(1, 13)) + ", round(exp(sum(ln(1 + ret))) - 1, 6) AS year_return, round(avg(CAST(ret > 0 AS INT)), 6) AS win_rate FROM m GROUP BY ALL")
def r14(spark, sf):
    m = series(spark, sf).groupBy("combo", F.year("dt").alias("yr"), F.date_format("dt", "'m'MM").alias("mm")).agg(compound("r").alias("ret"))
    wide = m.groupBy("combo", "yr").pivot("mm", [f"m{k:02d}" for k in range(1, 13)]).agg(F.max("ret"))
    tot = m.groupBy("combo", "yr").agg(compound("ret").alias("year_return"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))
    return rounded(wide.join(tot, ["combo", "yr"]))


@query("r_15_half_year_chunks", f"WITH {SER}, i AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY dt) - 1 AS i FROM ser) SELECT combo, CAST(i // 126 AS BIGINT) AS chunk, count(*) AS bars, round(exp(sum(ln(1 + r))) - 1, 6) AS ret FROM i GROUP BY ALL")
def r15(spark, sf):
    from pyspark.sql import Window as W

    d = series(spark, sf).withColumn("i", F.row_number().over(W.partitionBy("combo").orderBy("dt")) - 1)
    return rounded(d.groupBy("combo", F.floor(F.col("i") / 126).alias("chunk")).agg(F.count(F.lit(1)).alias("bars"), compound("r").alias("ret")))


@query("r_16_pair_risk", f"""WITH {SER}, dd AS (SELECT *, eq / max(eq) OVER (PARTITION BY combo ORDER BY dt) - 1 AS dd FROM eq), m AS (SELECT dt, avg(r) AS rm FROM ser GROUP BY dt), j AS (SELECT a.dt, a.r AS ra, a.dd AS da, b.r AS rb, b.dd AS db, rm FROM dd a JOIN dd b ON a.dt = b.dt AND a.combo = 'pool_0' AND b.combo = 'pool_1' JOIN m ON m.dt = a.dt),
 q AS (SELECT quantile_cont(ra, 0.1) AS qa, quantile_cont(rb, 0.1) AS qb, quantile_cont(rm, 0.1) AS qm, regr_slope(ra, rm) AS ba, regr_intercept(ra, rm) AS ia, regr_slope(rb, rm) AS bb, regr_intercept(rb, rm) AS ib FROM j),
 g AS (SELECT count(*) AS n, count(*) FILTER (da < -0.02 AND db < -0.02) / count(*) FILTER (da < -0.02 OR db < -0.02) AS dd_sync, avg(CAST(ra <= qa AND rb <= qb AS INT)) AS jl, avg(CAST(ra <= qa AS INT)) * avg(CAST(rb <= qb AS INT)) AS pi, avg(CAST(ra < 0 AND rb < 0 AS INT)) AS joint_loss, count(*) FILTER (rm <= qm) AS mn, count(*) FILTER (rm <= qm AND ra < 0 AND rb < 0) AS mk, corr(ra, rb) AS fc, corr(ra - ba * rm - ia, rb - bb * rm - ib) AS rc FROM j, q)
 SELECT n, round(dd_sync, 6) AS dd_sync, round(jl, 6) AS joint_left, round(jl / pi, 6) AS co_crash_ratio, round(joint_loss, 6) AS joint_loss, mn AS mkt_left_n, mk AS mkt_left_k, round(fc, 6) AS full_corr, round(rc, 6) AS residual_corr, round(mk / mn, 6) AS loss_given_mkt_left,
  round((mk / mn + 3.8416 / (2 * mn) + 1.96 * sqrt(mk / mn * (1 - mk / mn) / mn + 3.8416 / (4 * mn * mn))) / (1 + 3.8416 / mn), 6) AS wilson_upper FROM g""")
def r16(spark, sf):
    s = series(spark, sf)
    m = s.groupBy("dt").agg(F.avg("r").alias("r"))
    pick = lambda c: s.where(F.col("combo") == c).select("dt", "r")
    return rounded(R.pair_risk(pick("pool_0"), pick("pool_1"), m))


@query("r_17_segment_contingency", f"""WITH {SER}, c AS (SELECT combo, bar // 20 AS seg, exp(sum(ln(1 + r))) - 1 AS ret FROM ser GROUP BY ALL), j AS (SELECT a.ret AS x, b.ret AS y FROM c a JOIN c b ON a.seg = b.seg AND a.combo = 'pool_0' AND b.combo = 'pool_1')
 SELECT count(*) AS segments, round(corr(x, y), 6) AS corr, count(*) FILTER (x > 0 AND y > 0) AS both_win, count(*) FILTER (x > 0 AND y <= 0) AS only_a, count(*) FILTER (x <= 0 AND y > 0) AS only_b, count(*) FILTER (x <= 0 AND y <= 0) AS both_fail, round(count(*) FILTER (x <= 0 AND y <= 0) / count(*), 6) AS p_both_fail FROM j""")
def r17(spark, sf):
    c = series(spark, sf).groupBy("combo", F.floor(F.col("bar") / 20).alias("seg")).agg(compound("r").alias("ret"))
    j = c.where("combo = 'pool_0'").select("seg", F.col("ret").alias("x")).join(c.where("combo = 'pool_1'").select("seg", F.col("ret").alias("y")), "seg")
    x, y = F.col("x") > 0, F.col("y") > 0
    k = lambda e: F.count(F.when(e, 1))
    return rounded(j.agg(F.count(F.lit(1)).alias("segments"), corr("x", "y").alias("corr"), k(x & y).alias("both_win"), k(x & ~y).alias("only_a"), k(~x & y).alias("only_b"), k(~x & ~y).alias("both_fail"), F.avg((~x & ~y).cast("double")).alias("p_both_fail")))


_VGX = EXPO.split(", rp AS")[0]


@query("r_18_gate_uplift", f"WITH {SER}, {MI}, {_VGX}, u AS (SELECT combo, 'off' AS gate, ser.dt, r FROM ser UNION ALL SELECT combo, 'on', ser.dt, r * e FROM ser JOIN ex ON ser.dt = ex.dt), g AS (SELECT combo, year(dt) AS yr, gate, exp(sum(ln(1 + r))) - 1 AS ret FROM u GROUP BY ALL) SELECT combo, yr, round(max(ret) FILTER (gate = 'off'), 6) AS gate_off, round(max(ret) FILTER (gate = 'on'), 6) AS gate_on, round(max(ret) FILTER (gate = 'on') - max(ret) FILTER (gate = 'off'), 6) AS uplift FROM g GROUP BY ALL")
def r18(spark, sf):
    s = series(spark, sf)
    e = G.shift_gate(vol_gate(spark, sf), 1, 1.0).select("dt", "exposure")
    on = s.join(e, "dt").select("combo", "dt", (F.col("r") * F.col("exposure")).alias("r"), F.lit("on").alias("gate"))
    u = s.select("combo", "dt", "r", F.lit("off").alias("gate")).unionByName(on)
    g = u.groupBy("combo", F.year("dt").alias("yr"), "gate").agg(compound("r").alias("ret"))
    w = g.groupBy("combo", "yr").pivot("gate", ["off", "on"]).agg(F.max("ret"))
    return rounded(w.select("combo", "yr", F.col("off").alias("gate_off"), F.col("on").alias("gate_on"), (F.col("on") - F.col("off")).alias("uplift")))


@query("r_19_run_alignment", f"WITH {RUNS_SQL}, j AS (SELECT score, vec_score, vec_score - score AS d FROM wfo JOIN vec USING (combo)) SELECT count(*) AS n, round(avg(d), 6) AS mean_diff, round(median(abs(d)), 6) AS median_abs, round(quantile_cont(abs(d), 0.95), 6) AS p95_abs, round(max(abs(d)), 6) AS max_abs, count(*) FILTER (abs(d) / score > 0.05) AS over_5pct, round(avg(vec_score / score), 6) AS mean_ratio FROM j")
def r19(spark, sf):
    a, b, _ = runs(spark, sf)
    d = a.join(b, "combo").withColumn("d", F.col("vec_score") - F.col("score"))
    ab = F.abs("d")
    return rounded(d.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"), F.median(ab).alias("median_abs"), F.percentile(ab, 0.95).alias("p95_abs"), F.max(ab).alias("max_abs"), F.count(F.when(ab / F.col("score") > 0.05, 1)).alias("over_5pct"), F.avg(F.col("vec_score") / F.col("score")).alias("mean_ratio")))


@query("r_20_score_distribution", f"WITH {RUNS_SQL} SELECT split_part(combo, ' + ', 2) AS cohort, count(*) AS n, round(avg(score), 6) AS mean_score, round(quantile_cont(score, 0.25), 6) AS p25, round(median(score), 6) AS p50, round(quantile_cont(score, 0.75), 6) AS p75 FROM wfo GROUP BY 1")
def r20(spark, sf):
    a, _, _ = runs(spark, sf)
    return rounded(a.groupBy(F.split("combo", r" \+ ")[1].alias("cohort")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.percentile("score", 0.25).alias("p25"), F.median("score").alias("p50"), F.percentile("score", 0.75).alias("p75")))


PERIODS = (("early", "1995-01-01", "1996-12-31"), ("middle", "1997-01-01", "1999-12-31"), ("late", "2000-01-01", "2001-12-31"))
_PV = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS)
_SYP = f"SELECT s.symbol, name AS period, arg_max(close, dt) / arg_min(close, dt) - 1 AS total_return, stddev_samp(r) AS vol FROM s, (VALUES {_PV}) p(name, a, b) WHERE dt BETWEEN a AND b AND close IS NOT NULL GROUP BY ALL"


def _symbol_periods(spark, sf):
    d = with_stage_columns(panel(spark, sf)).where("close is not null")
    p = None
    for n, a, b in PERIODS:
        c = F.col("dt").between(F.to_date(F.lit(a)), F.to_date(F.lit(b)))
        p = F.when(c, n) if p is None else p.when(c, n)
    return d.withColumn("period", p).where("period is not null").groupBy("symbol", "period").agg((F.max_by("close", "dt") / F.min_by("close", "dt") - 1).alias("total_return"), F.stddev_samp("r").alias("vol"))


@query("r_21_symbol_periods", f"WITH {STAGED}, g AS ({_SYP}) SELECT symbol, period, round(total_return, 6) AS total_return, round(vol, 6) AS vol, row_number() OVER (PARTITION BY period ORDER BY round(total_return, 10) DESC, symbol) AS place FROM g")
def r21(spark, sf):
    from pyspark.sql import Window as W

    d = _symbol_periods(spark, sf)
    return rounded(d.withColumn("place", F.row_number().over(W.partitionBy("period").orderBy(F.round("total_return", 10).desc(), "symbol"))))


@query("r_21_breadth", f"WITH {STAGED}, g AS ({_SYP}) SELECT period, count(*) AS n, round(avg(CAST(total_return > 0 AS INT)), 6) AS up, round(avg(CAST(total_return > 0.1 AS INT)), 6) AS up10, round(avg(CAST(total_return > 0.2 AS INT)), 6) AS up20 FROM g GROUP BY period")
def r21b(spark, sf):
    t = F.col("total_return")
    return rounded(_symbol_periods(spark, sf).groupBy("period").agg(F.count(F.lit(1)).alias("n"), *[F.avg((t > v).cast("double")).alias(n) for n, v in (("up", 0), ("up10", 0.1), ("up20", 0.2))]))


@query("r_22_return_histogram", f"WITH {SER} SELECT combo, CAST(least(greatest(floor((r + 0.1) / 0.02), -1), 10) AS BIGINT) AS bin, count(*) AS n, round(min(r), 6) AS lo, round(max(r), 6) AS hi FROM ser GROUP BY ALL")
def r22(spark, sf):
    b = F.least(F.greatest(F.floor((F.col("r") + 0.1) / 0.02), F.lit(-1)), F.lit(10))
    return rounded(series(spark, sf).groupBy("combo", b.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")))


@query("r_23_trailing_window", f"WITH {SER}, q AS (SELECT * FROM eq WHERE dt >= (SELECT max(dt) FROM ser) - 365) SELECT combo, {WC} FROM ({WM('q', 'combo')}) WHERE n >= 5")
def r23(spark, sf):
    d = curves(spark, sf)
    last = d.agg(F.max("dt").alias("last"))
    d = d.crossJoin(F.broadcast(last)).where(F.col("dt") >= F.date_sub("last", 365))  # one row
    return wm(d.drop("last"), ["combo"]).where("n >= 5")


@query("r_24_pool_concentration", f"""WITH {RETS}, {PR()}, c AS (SELECT combo, period, count(DISTINCT pool) AS pools FROM hd GROUP BY ALL), q AS (SELECT combo, quantile_cont(net, 0.2) AS cut FROM pr GROUP BY combo)
 SELECT pr.combo, count(*) AS periods, round(avg(CAST(pools = 1 AS INT)), 6) AS same_pool_rate, round(avg(CAST(pools = 1 AS INT)) FILTER (net <= cut), 6) AS same_pool_in_worst FROM pr JOIN c ON pr.combo = c.combo AND pr.period = c.period JOIN q ON pr.combo = q.combo GROUP BY pr.combo""")
def r24(spark, sf):
    from .portfolio_queries import plain_holdings

    c = plain_holdings(spark, sf).groupBy("combo", "period").agg(F.countDistinct("pool").alias("pools"))
    p = period_net(spark, sf)
    q = p.groupBy("combo").agg(F.percentile("net", 0.2).alias("cut"))
    d = p.join(c, ["combo", "period"]).join(q, "combo")
    same = (F.col("pools") == 1).cast("double")
    return rounded(d.groupBy("combo").agg(F.count(F.lit(1)).alias("periods"), F.avg(same).alias("same_pool_rate"), F.avg(F.when(F.col("net") <= F.col("cut"), same)).alias("same_pool_in_worst")))
