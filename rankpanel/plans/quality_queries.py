"""A-01..A-30: predictive power and factor quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import corr, ratio
from ..functions.rolling import lead
from ..operators import gates as G
from ..operators import quality as Q
from ..operators.factors import CATALOG, with_stage_columns
from ..oracle.base import PANEL
from ..oracle.research import HOR, IC, LONG, NAMES, RAW, SUMMARY_COLS, WIDE, avg_rank as rk, ic_cte, summary
from ..sources.panel import panel
from ..sources.stages import stage
from ..sources.tables import FOREIGN_POOL, pool_of
from .registry import query, rounded
from .research import daily_ic, raw_wide, std_long, std_wide
from .side_queries import side

CUT = "1999-10-01"
HO = f"dt >= DATE '{CUT}'"
FREQ = 3
REGIME_ARGS = dict(bull=(0.0, 10.0, 0.0), bear=(-0.02, 2.0))
PAIRS = Q.pair_columns(NAMES)


def bars(spark, sf):
    return panel(spark, sf).groupBy("dt").agg(F.first("bar").alias("bar"))


def holdout():
    return F.col("dt") >= F.to_date(F.lit(CUT))


@query("a_01_forward_return", f"WITH {PANEL} SELECT symbol, dt, " + ", ".join(f"round(lead(close, {h}) OVER w / close - 1, 6) AS fwd{h}" for h in HOR) + " FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY dt)")
def a01(spark, sf):
    return rounded(panel(spark, sf).select("symbol", "dt", *[(ratio(lead("close", h), "close") - 1).alias(f"fwd{h}") for h in HOR]))


@query("a_02_rank_ic", f"WITH {IC} SELECT factor, dt, round(ic, 6) AS ic, n FROM ic")
def a02(spark, sf):
    return rounded(daily_ic(spark, sf))


@query("a_03_rank_ic_legacy", f"""WITH {LONG}, a AS (SELECT factor, dt, {rk('value', 'factor, dt')} AS a, CASE WHEN fwd1 IS NOT NULL THEN rank() OVER (PARTITION BY factor, dt ORDER BY fwd1 NULLS LAST) + (count(fwd1) OVER (PARTITION BY factor, dt, fwd1) - 1) / 2.0 END AS b FROM zl),
 c AS (SELECT factor, dt, a - avg(a) OVER x AS a, b - avg(b) OVER x AS b FROM a WINDOW x AS (PARTITION BY factor, dt)),
 g AS (SELECT factor, dt, sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb, count(a + b) AS n FROM c GROUP BY factor, dt) SELECT factor, dt, round(ab / sqrt(aa * bb), 6) AS ic, n FROM g WHERE n >= 5 AND aa * bb > 0""")
def a03(spark, sf):
    return rounded(Q.rank_ic_legacy(std_long(spark, sf), "fwd1"))


@query("a_04_ordinal_ic", f"""WITH {LONG}, o AS (SELECT factor, dt, row_number() OVER (PARTITION BY factor, dt ORDER BY value, symbol) AS a, row_number() OVER (PARTITION BY factor, dt ORDER BY fwd1, symbol) AS b FROM zl WHERE fwd1 IS NOT NULL),
 d AS (SELECT factor, dt, round(corr(a, b), 12) AS ic FROM o GROUP BY factor, dt HAVING count(*) > 2) SELECT factor, round(avg(ic), 6) AS mean_ic, count(*) AS n_dates FROM d GROUP BY factor""")
def a04(spark, sf):
    d = Q.ordinal_ic(std_long(spark, sf), "fwd1")
    return rounded(d.groupBy("factor").agg(F.avg("ic").alias("mean_ic"), F.count(F.lit(1)).alias("n_dates")))


@query("a_05_ic_summary", f"WITH {IC} SELECT factor, {SUMMARY_COLS} FROM ({summary()})")
def a05(spark, sf):
    return rounded(Q.summarise(daily_ic(spark, sf)))


_SPLIT = f"""sp2 AS (SELECT factor, avg(ic) FILTER (NOT {HO}) AS train_ic, stddev_samp(ic) FILTER (NOT {HO}) AS train_std, count(ic) FILTER (NOT {HO}) AS train_n, avg(CAST(ic > 0 AS INT)) FILTER (NOT {HO}) AS train_hit,
 avg(ic) FILTER ({HO}) AS ho_ic, stddev_samp(ic) FILTER ({HO}) AS ho_std, count(ic) FILTER ({HO}) AS ho_n, avg(CAST(ic > 0 AS INT)) FILTER ({HO}) AS ho_hit FROM ic GROUP BY factor),
 spl AS (SELECT *, CASE WHEN train_std > 1e-10 THEN train_ic / train_std END AS train_icir, CASE WHEN ho_std > 1e-10 THEN ho_ic / ho_std END AS ho_icir FROM sp2)"""
_SC = ", ".join(f"round({s}_{c}, 6) AS {s}_{c}" for s in ("train", "ho") for c in ("ic", "std", "hit", "icir")) + ", train_n, ho_n"


@query("a_06_train_holdout", f"WITH {IC}, {_SPLIT} SELECT factor, {_SC} FROM spl")
def a06(spark, sf):
    return rounded(Q.two_sided_trains(daily_ic(spark, sf), holdout()))


def _sp3(a, b, c):
    h = lambda x, y: f"(CASE WHEN {x} > {y} THEN 1.0 WHEN {x} = {y} THEN 0.5 ELSE 0.0 END)"
    return f"(({h(c, a)} + {h(c, b)}) - ({h(a, b)} + {h(a, c)}))", f"(power({h(a, b)} + {h(a, c)} - 1, 2) + power({h(b, a)} + {h(b, c)} - 1, 2) + power({h(c, a)} + {h(c, b)} - 1, 2))"


_N, _D = _sp3("t1", "t2", "t3")
_TER = f"""tp AS (SELECT factor, dt, fwd1, {rk('value', 'factor, dt')} / count(*) OVER (PARTITION BY factor, dt) AS p FROM zl),
 td AS (SELECT factor, dt, avg(fwd1) FILTER (p < 1/3) AS m1, avg(fwd1) FILTER (p >= 1/3 AND p < 2/3) AS m2, avg(fwd1) FILTER (p >= 2/3) AS m3 FROM tp WHERE fwd1 IS NOT NULL GROUP BY factor, dt HAVING count(*) >= 6),
 tg AS (SELECT factor, coalesce(avg(m1), 0) AS t1, coalesce(avg(m2), 0) AS t2, coalesce(avg(m3), 0) AS t3 FROM td GROUP BY factor),
 ter AS (SELECT *, CASE WHEN {_D} > 0 THEN abs({_N} / sqrt(2 * {_D})) ELSE 0 END AS monotonicity FROM tg)"""


@query("a_07_tercile_monotonicity", f"WITH {LONG}, {_TER} SELECT factor, round(t1, 6) AS tercile_1, round(t2, 6) AS tercile_2, round(t3, 6) AS tercile_3, round(monotonicity, 6) AS monotonicity FROM ter")
def a07(spark, sf):
    return rounded(Q.terciles(std_long(spark, sf), "fwd1"))


_G5 = ", ".join(f"avg(fwd1) FILTER (g = {k}) AS g{k}" for k in range(1, 6))
_LAY = f"""ly AS (SELECT factor, dt, fwd1, least(5, ceil({rk('value', 'factor, dt')} / count(*) OVER (PARTITION BY factor, dt) * 5)) AS g, count(*) OVER (PARTITION BY factor, dt) AS c FROM zl WHERE fwd1 IS NOT NULL),
 lyd AS (SELECT factor, dt, {_G5} FROM ly WHERE c >= 5 GROUP BY factor, dt)"""


@query("a_08_layered_returns", f"WITH {LONG}, {_LAY} SELECT factor, " + ", ".join(f"round(avg(g{k}), 6) AS group_{k}" for k in range(1, 6)) + ", round(avg(g5) - avg(g1), 6) AS long_short FROM lyd GROUP BY factor")
def a08(spark, sf):
    return rounded(Q.layered(std_long(spark, sf), "fwd1"))


@query("a_09_quartile_spread", f"""WITH {LONG}, c AS (SELECT factor, dt, quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM zl WHERE fwd1 IS NOT NULL GROUP BY factor, dt HAVING count(*) >= 8)
 SELECT zl.factor, zl.dt, round(avg(fwd1) FILTER (value >= hi) - avg(fwd1) FILTER (value <= lo), 6) AS spread FROM zl JOIN c ON zl.factor = c.factor AND zl.dt = c.dt WHERE fwd1 IS NOT NULL GROUP BY zl.factor, zl.dt""")
def a09(spark, sf):
    return rounded(Q.quartile_spread(std_long(spark, sf), "fwd1"))


_ROLL = "rl2 AS (SELECT factor, CASE WHEN count(ic) OVER w = 120 THEN avg(ic) OVER w END AS m FROM ic WINDOW w AS (PARTITION BY factor ORDER BY dt ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)), roll AS (SELECT factor, avg(m) AS rolling_ic_mean, avg(CAST(m > 0 AS INT)) AS rolling_ic_positive_rate, count(m) AS n FROM rl2 WHERE m IS NOT NULL GROUP BY factor)"


@query("a_10_rolling_ic", f"WITH {IC}, {_ROLL} SELECT factor, round(rolling_ic_mean, 6) AS rolling_ic_mean, round(rolling_ic_positive_rate, 6) AS rolling_ic_positive_rate, n FROM roll")
def a10(spark, sf):
    return rounded(Q.rolling_mean_ic(daily_ic(spark, sf)))


_ICH = ", ".join(ic_cte(f"ic{h}", "zl", f"fwd{h}") for h in HOR)
_DEC = " UNION ALL ".join(f"SELECT factor, {h} AS h, avg(ic) AS m FROM ic{h} GROUP BY factor" for h in HOR)


@query("a_11_ic_decay", f"WITH {LONG}, {_ICH}, d AS ({_DEC}) SELECT factor, " + ", ".join(f"round(coalesce(max(m) FILTER (h = {h}), 0), 6) AS ic_{h}" for h in HOR) + ", arg_max(h, (round(abs(m), 10), -h)) AS best_horizon FROM d GROUP BY factor")
def a11(spark, sf):
    return rounded(Q.decay(std_long(spark, sf), HOR))


_PCT = f"pr AS (SELECT factor, symbol, bar, dt, {rk('value', 'factor, dt')} / count(*) OVER (PARTITION BY factor, dt) AS p FROM zl)"
_AUTO = f"""{_PCT}, pj AS (SELECT a.factor, a.p, b.p AS q FROM pr a JOIN pr b ON a.factor = b.factor AND a.symbol = b.symbol AND a.bar = b.bar + {FREQ}),
 pk AS (SELECT factor, {rk('p', 'factor')} AS a, {rk('q', 'factor')} AS b FROM pj), aut AS (SELECT factor, count(*) AS n_pairs, corr(a, b) AS rank_autocorr FROM pk GROUP BY factor HAVING count(*) >= 100)"""


@query("a_12_rank_autocorrelation", f"WITH {LONG}, {_AUTO} SELECT factor, n_pairs, round(rank_autocorr, 6) AS rank_autocorr FROM aut")
def a12(spark, sf):
    return rounded(Q.rank_autocorrelation(std_long(spark, sf), FREQ).select("factor", "n_pairs", "rank_autocorr"))


@query("a_13_rank_autocorrelation_by_symbol", f"""WITH {LONG}, {_PCT}, c AS (SELECT a.factor, a.symbol, corr(a.p, b.p) AS c FROM pr a JOIN pr b ON a.factor = b.factor AND a.symbol = b.symbol AND a.bar = b.bar + 1 GROUP BY ALL HAVING count(*) >= 30),
 d AS (SELECT a.factor, a.dt, corr(a.p, b.p) AS c FROM pr a JOIN pr b ON a.factor = b.factor AND a.symbol = b.symbol AND a.bar = b.bar + {FREQ} GROUP BY ALL HAVING count(*) >= 10)
 SELECT s.factor, round(s.m, 6) AS by_symbol, round(t.m, 6) AS by_date FROM (SELECT factor, avg(c) AS m FROM c GROUP BY factor) s JOIN (SELECT factor, avg(c) AS m FROM d GROUP BY factor) t ON s.factor = t.factor""")
def a13(spark, sf):
    from ..functions.ranking import pct_rank

    d = std_long(spark, sf).select("factor", "symbol", "dt", "bar", pct_rank("value", ["factor", "dt"]).alias("p"))

    def lagged(k):
        past = d.select("factor", "symbol", (F.col("bar") + k).alias("bar"), F.col("p").alias("q"))
        return d.join(past, ["factor", "symbol", "bar"])

    def mean(x, key, need, out):
        g = x.groupBy("factor", key).agg(corr("p", "q").alias("c"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= need)
        return g.groupBy("factor").agg(F.avg("c").alias(out))

    return rounded(mean(lagged(1), "symbol", 30, "by_symbol").join(mean(lagged(FREQ), "dt", 10, "by_date"), "factor"))


REG_SQL = """mi AS (SELECT dt, avg(close) AS px, row_number() OVER (ORDER BY dt) - 1 AS i FROM panel GROUP BY dt), mr AS (SELECT *, px / lag(px) OVER (ORDER BY dt) - 1 AS ret FROM mi),
 mm AS (SELECT dt, px, i, px / lag(px, 60) OVER o - 1 AS rr, CASE WHEN count(ret) OVER w60 = 60 THEN stddev_samp(ret) OVER w60 * sqrt(252) END AS rv, CASE WHEN count(ret) OVER w60 = 60 THEN avg(ret) OVER w60 * 252 END AS mr,
   CASE WHEN count(px) OVER w20 = 20 THEN avg(px) OVER w20 END AS ma20, CASE WHEN count(px) OVER w60 = 60 THEN avg(px) OVER w60 END AS ma60 FROM mr
   WINDOW o AS (ORDER BY dt), w20 AS (ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w60 AS (ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
 reg AS (SELECT *, mr / (rv + 1e-10) AS rs, (ma20 - ma60) / ma60 AS md, CASE WHEN i < 60 OR rr IS NULL OR rv IS NULL THEN 'sideways' WHEN rr > {0} AND rv < {1} AND mr / (rv + 1e-10) > {2} THEN 'bull' WHEN rr < {3} OR (rr < 0 AND rv > {4}) THEN 'bear' ELSE 'sideways' END AS regime FROM mm)"""
REG = REG_SQL.format(0.0, 10.0, 0.0, -0.02, 2.0)


def regimes(spark, sf):
    return stage(spark, sf, "regimes", lambda: G.market_regime(G.market_index(panel(spark, sf)), **REGIME_ARGS))


@query("a_14_ic_by_regime_and_pool", f"""WITH {IC}, {REG}, {ic_cte('icp', 'zl', 'fwd1', 'factor, pool, dt', 5)}, {ic_cte('icd', "(SELECT *, pool = 4 AS foreign_pool FROM zl)", 'fwd1', 'factor, foreign_pool, dt')}
 SELECT factor, 'regime' AS split, regime AS part, round(avg(ic), 6) AS mean_ic, count(*) AS n FROM ic JOIN reg ON ic.dt = reg.dt GROUP BY ALL
 UNION ALL SELECT factor, 'pool', CAST(pool AS VARCHAR), round(avg(ic), 6), count(*) FROM icp GROUP BY ALL UNION ALL SELECT factor, 'market', CASE WHEN foreign_pool THEN 'foreign' ELSE 'domestic' END, round(avg(ic), 6), count(*) FROM icd GROUP BY ALL""")
def a14(spark, sf):
    agg = [F.avg("ic").alias("mean_ic"), F.count(F.lit(1)).alias("n")]
    long = std_long(spark, sf)
    r = daily_ic(spark, sf).drop("n").join(regimes(spark, sf).select("dt", "regime"), "dt")
    a = r.groupBy("factor", F.lit("regime").alias("split"), F.col("regime").alias("part")).agg(*agg)
    p = Q.rank_ic(long, "fwd1", ("factor", "pool", "dt")).drop("n").groupBy("factor", F.lit("pool").alias("split"), F.col("pool").cast("string").alias("part")).agg(*agg)
    m = long.withColumn("side", F.when(F.col("pool") == FOREIGN_POOL, "foreign").otherwise("domestic"))
    m = Q.rank_ic(m, "fwd1", ("factor", "side", "dt")).drop("n").groupBy("factor", F.lit("market").alias("split"), F.col("side").alias("part")).agg(*agg)
    return rounded(a.unionByName(p).unionByName(m))


_FOLD = ", ".join(f"avg(ic) FILTER (fold <> {k}) AS train_{k}, avg(ic) FILTER (fold = {k}) AS test_{k}" for k in range(3))
_ALLC = [f"{s}_{k}" for k in range(3) for s in ("train", "test")]
_CV = f"cvf AS (SELECT factor, ic, least(c.bar // ((SELECT max(bar) + 1 FROM cal) // 3), 2) AS fold FROM ic JOIN cal c ON ic.dt = c.dt), cv AS (SELECT factor, {_FOLD} FROM cvf GROUP BY factor)"
_CVP = "(" + " AND ".join(f"coalesce({c} > 0.02, true)" for c in _ALLC) + ") OR (" + " AND ".join(f"coalesce({c} < -0.02, true)" for c in _ALLC) + ")"


@query("a_15_time_series_folds", f"WITH {IC}, {_CV} SELECT factor, " + ", ".join(f"round({c}, 6) AS {c}" for c in _ALLC) + f", {_CVP} AS cv_passed FROM cv")
def a15(spark, sf):
    return rounded(Q.time_folds(daily_ic(spark, sf), bars(spark, sf)))


_COV = " UNION ALL ".join(f"SELECT '{n}' AS factor, count({n}) AS n, count(*) AS a FROM fw GROUP BY dt" for n in NAMES)


@query("a_16_coverage", f"WITH {WIDE}, c AS ({_COV}) SELECT factor, round(1 - sum(n) / sum(a), 6) AS null_rate, min(n) AS min_valid, round(avg(n), 6) AS mean_valid FROM c GROUP BY factor")
def a16(spark, sf):
    return rounded(Q.coverage(raw_wide(spark, sf), NAMES))


_DIR = ", ".join(f"('{n}', '{CATALOG[n].direction}')" for n in NAMES)
_QS = f"""covd AS ({_COV}), cov AS (SELECT factor, 1 - sum(n) / sum(a) AS null_rate FROM covd GROUP BY factor), dir(factor, direction) AS (VALUES {_DIR}), sm AS ({summary()}),
 q0 AS (SELECT sm.factor, mean_ic, ic_ir, p_value, monotonicity, rolling_ic_positive_rate, rank_autocorr, null_rate, direction,
   CASE WHEN p_value < 0.01 THEN 2.0 WHEN p_value < 0.05 THEN 1.0 ELSE 0 END + CASE WHEN monotonicity >= 0.8 THEN 1.0 ELSE 0 END + CASE WHEN coalesce(rolling_ic_positive_rate, 0) > 0.55 THEN 1.0 ELSE 0 END
   + CASE WHEN coalesce(rank_autocorr, 0) > 0.7 THEN 0.5 ELSE 0 END + CASE WHEN direction = 'neutral' OR (direction = 'high_is_good' AND mean_ic > 0) OR (direction = 'low_is_good' AND mean_ic < 0) THEN 1.0 ELSE 0 END AS quality_score
   FROM sm JOIN ter ON sm.factor = ter.factor LEFT JOIN roll ON sm.factor = roll.factor LEFT JOIN aut ON sm.factor = aut.factor JOIN cov ON sm.factor = cov.factor JOIN dir ON sm.factor = dir.factor)"""
QUALITY_SQL = f"{IC}, {_TER}, {_ROLL}, {_AUTO}, {_QS}"


def quality_table(spark, sf):
    def build():
        ic, long = daily_ic(spark, sf), std_long(spark, sf)
        d = Q.summarise(ic)
        d = d.join(Q.terciles(long, "fwd1").select("factor", "monotonicity"), "factor")
        d = d.join(Q.rolling_mean_ic(ic).select("factor", "rolling_ic_positive_rate"), "factor", "left")
        d = d.join(Q.rank_autocorrelation(long, FREQ).select("factor", "rank_autocorr"), "factor", "left")
        d = d.join(Q.coverage(raw_wide(spark, sf), NAMES).select("factor", "null_rate"), "factor")
        direction = F.create_map(*[x for n in NAMES for x in (F.lit(n), F.lit(CATALOG[n].direction))])
        d = d.withColumn("direction", direction[F.col("factor")]).withColumn("production_ready", F.lit(True))
        return Q.quality_score(d)

    return stage(spark, sf, "quality", build)


@query("a_17_quality_score", f"WITH {QUALITY_SQL} SELECT factor, round(mean_ic, 6) AS mean_ic, round(ic_ir, 6) AS ic_ir, round(p_value, 6) AS p_value, round(monotonicity, 6) AS monotonicity, round(rolling_ic_positive_rate, 6) AS rolling_ic_positive_rate, round(rank_autocorr, 6) AS rank_autocorr, round(null_rate, 6) AS null_rate, direction, CAST(quality_score AS DOUBLE) AS quality_score, quality_score >= 2 AND null_rate <= 0.3 AS passed FROM q0")
def a17(spark, sf):
    return rounded(quality_table(spark, sf).select(
        "factor", "mean_ic", "ic_ir", "p_value", "monotonicity", "rolling_ic_positive_rate", "rank_autocorr", "null_rate", "direction", "quality_score", "passed"))


@query("a_18_quick_screen", f"WITH {RAW}, {ic_cte('ic', 'rl', 'fwd1')} SELECT factor, round(mean_ic, 6) AS mean_ic, round(p_value, 6) AS p_value FROM ({summary()})")
def a18(spark, sf):
    from .research import raw_long

    return rounded(Q.summarise(Q.rank_ic(raw_long(spark, sf), "fwd1")).select("factor", "mean_ic", "p_value"))


@query("a_19_direction_stability", f"""WITH {IC}, {_SPLIT}, d AS (SELECT *, CASE WHEN abs(train_ic) < 0.02 THEN 'neutral' WHEN train_ic > 0 THEN 'positive' ELSE 'negative' END AS direction, CASE WHEN abs(train_ic) < 0.02 OR abs(ho_ic) < 0.02 THEN true ELSE train_ic * ho_ic > 0 END AS direction_stable FROM spl)
 SELECT factor, round(train_ic, 6) AS train_ic, round(ho_ic, 6) AS ho_ic, direction, direction_stable, abs(train_ic) >= 0.02 AND abs(train_icir) >= 0.1 AND abs(ho_ic) >= 0.02 AND direction = 'negative' AND direction_stable AS flip_recommended, round(CASE WHEN train_ic < 0 THEN -ho_ic ELSE ho_ic END, 6) AS flipped_ho_ic FROM d""")
def a19(spark, sf):
    d = Q.directions(Q.two_sided_trains(daily_ic(spark, sf), holdout()))
    return rounded(d.select("factor", "train_ic", "ho_ic", "direction", "direction_stable", "flip_recommended", "flipped_ho_ic"))


@query("a_20_topk_precision", f"""WITH {LONG}, c AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY factor, dt) AS n FROM zl WHERE fwd1 IS NOT NULL) WHERE n >= 10),
 o AS (SELECT *, row_number() OVER (PARTITION BY factor, dt ORDER BY value DESC, symbol) AS pf, row_number() OVER (PARTITION BY factor, dt ORDER BY fwd1 DESC, symbol) AS pr FROM c),
 d AS (SELECT factor, dt, count(*) FILTER (pf <= 2 AND pr <= 2) / 2 AS p, CASE WHEN count(*) FILTER (pf <= 2 AND pr <= 5) > 0 THEN 1 ELSE 0 END AS h FROM o GROUP BY factor, dt), {ic_cte('bi', 'o', 'fwd1', where='AND pf <= 10')}
 SELECT d.factor, round(avg(p), 6) AS top_precision, round(avg(h), 6) AS top_hit_rate, count(*) AS n_dates, round(any_value(b.m), 6) AS boundary_ic FROM d LEFT JOIN (SELECT factor, avg(ic) AS m FROM bi GROUP BY factor) b ON d.factor = b.factor GROUP BY d.factor""")
def a20(spark, sf):
    return rounded(Q.topk_precision(std_long(spark, sf), "fwd1"))


@query("a_21_rank_stability", f"""WITH {LONG}, o AS (SELECT factor, symbol, bar, {rk('value', 'factor, bar')} AS rk, row_number() OVER (PARTITION BY factor, bar ORDER BY value DESC, symbol) AS pos, count(*) OVER (PARTITION BY factor, bar) AS n FROM zl WHERE bar % {FREQ} = 0),
 j AS (SELECT a.factor, a.bar, a.rk, b.rk AS rk2, a.pos, b.pos AS pos2 FROM o a JOIN o b ON a.factor = b.factor AND a.symbol = b.symbol AND b.bar = a.bar + {FREQ}), {ic_cte('rc', 'j', 'rk2', 'factor, bar', 4, value='rk')},
 stay AS (SELECT factor, bar, count(*) FILTER (pos <= 2 AND pos2 <= 2) / 2 AS s FROM j GROUP BY ALL), v AS (SELECT factor, symbol, stddev_pop((rk - 1) / (n - 1)) AS v FROM o WHERE n > 1 GROUP BY ALL)
 SELECT a.factor, round(a.m, 6) AS rank_autocorr, round(b.m, 6) AS top_persistence, round(c.m, 6) AS rank_volatility FROM (SELECT factor, avg(ic) AS m FROM rc GROUP BY factor) a JOIN (SELECT factor, avg(s) AS m FROM stay GROUP BY factor) b ON a.factor = b.factor JOIN (SELECT factor, avg(v) AS m FROM v GROUP BY factor) c ON a.factor = c.factor""")
def a21(spark, sf):
    return rounded(Q.rank_stability(std_long(spark, sf), FREQ))


@query("a_22_window_stability", f"""WITH {IC}, e AS (SELECT factor, win, ic FROM ic JOIN cal c ON ic.dt = c.dt, range(0, 100) g(win) WHERE c.bar >= win * 30 AND c.bar < win * 30 + 120 AND win * 30 < (SELECT max(bar) + 1 FROM cal) - 120),
 m AS (SELECT factor, win, avg(ic) AS m FROM e GROUP BY ALL), g AS (SELECT factor, count(*) AS windows, avg(m) AS a, stddev_pop(m) AS s, avg(CAST(m > 0 AS INT)) AS p, (avg(power(m, 3)) - 3 * avg(m) * avg(m * m) + 2 * power(avg(m), 3)) / power(stddev_pop(m), 3) AS sk FROM m GROUP BY factor HAVING count(*) >= 3)
 SELECT factor, windows, round(a, 6) AS ic_mean, round(s, 6) AS ic_std, round(sk, 4) AS ic_skew, round(p, 6) AS positive_rate, round(0.4 * a + 0.3 * p - 0.3 * s, 6) AS stability_score, a >= 0 AND s <= 0.2 AND p >= 0.5 AS is_stable FROM g""")
def a22(spark, sf):
    d = Q.window_stability(daily_ic(spark, sf), bars(spark, sf), 120, 30)
    return rounded(d.withColumn("ic_skew", F.round("ic_skew", 4)))


@query("a_23_verdict", f"""WITH {QUALITY_SQL}, {_CV}, {_LAY}, ls AS (SELECT factor, avg(g5 - g1) / stddev_samp(g5 - g1) * sqrt(252) AS ls_sharpe FROM lyd GROUP BY factor), cvp AS (SELECT factor, {_CVP} AS ok FROM cv),
 v AS (SELECT q0.factor, ls_sharpe, ok AS cv_passed, CASE WHEN p_value < 0.01 THEN 3 WHEN p_value < 0.05 THEN 2 WHEN p_value < 0.1 THEN 1 ELSE 0 END + CASE WHEN ls_sharpe > 1 THEN 3 WHEN ls_sharpe > 0.5 THEN 2 WHEN ls_sharpe > 0 THEN 1 ELSE 0 END + CASE WHEN ok THEN 2 ELSE 0 END
  + CASE WHEN rank_autocorr > 0.8 THEN 1 ELSE 0 END + CASE WHEN direction = 'neutral' THEN 0.5 WHEN (direction = 'high_is_good' AND mean_ic > 0) OR (direction = 'low_is_good' AND mean_ic < 0) THEN 1 ELSE 0 END AS score FROM q0 JOIN ls ON q0.factor = ls.factor JOIN cvp ON q0.factor = cvp.factor)
 SELECT factor, round(ls_sharpe, 6) AS ls_sharpe, cv_passed, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 6 THEN 'strong' WHEN score >= 3 THEN 'medium' WHEN score >= 1 THEN 'weak' ELSE 'invalid' END AS verdict FROM v""")
def a23(spark, sf):
    q = quality_table(spark, sf)
    cv = Q.time_folds(daily_ic(spark, sf), bars(spark, sf)).select("factor", "cv_passed")
    ls = long_short_daily(std_long(spark, sf)).groupBy("factor").agg((F.avg("ls") / F.stddev_samp("ls") * F.sqrt(F.lit(252.0))).alias("ls_sharpe"))
    d = q.join(cv, "factor").join(ls, "factor")
    p, s = F.col("p_value"), F.col("ls_sharpe")
    good = ((F.col("direction") == "high_is_good") & (F.col("mean_ic") > 0)) | ((F.col("direction") == "low_is_good") & (F.col("mean_ic") < 0))
    score = (
        F.when(p < 0.01, 3.0).when(p < 0.05, 2.0).when(p < 0.1, 1.0).otherwise(0.0) + F.when(s > 1, 3.0).when(s > 0.5, 2.0).when(s > 0, 1.0).otherwise(0.0)
        + F.when(F.col("cv_passed"), 2.0).otherwise(0.0) + F.when(F.col("rank_autocorr") > 0.8, 1.0).otherwise(0.0)
        + F.when(F.col("direction") == "neutral", 0.5).when(good, 1.0).otherwise(0.0)
    )
    verdict = F.when(F.col("score") >= 6, "strong").when(F.col("score") >= 3, "medium").when(F.col("score") >= 1, "weak").otherwise("invalid")
    return rounded(d.withColumn("score", score).select("factor", "ls_sharpe", "cv_passed", "score", verdict.alias("verdict")))


def long_short_daily(long, groups=5):
    from pyspark.sql import Window as W

    from ..functions.ranking import pct_rank

    keys = ["factor", "dt"]
    d = long.where("fwd1 is not null").withColumn("p", pct_rank("value", keys)).withColumn("c", F.count(F.lit(1)).over(W.partitionBy(*keys))).where(F.col("c") >= groups)
    g = F.least(F.lit(groups), F.ceil(F.col("p") * groups))
    return d.groupBy(*keys).agg((F.avg(F.when(g == groups, F.col("fwd1"))) - F.avg(F.when(g == 1, F.col("fwd1")))).alias("ls")).where("ls is not null")


_RKW = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN rank() OVER (PARTITION BY dt ORDER BY {n} NULLS LAST) + (count({n}) OVER (PARTITION BY dt, {n}) - 1) / 2.0 END AS {n}" for n in NAMES)
ZW = ", zw AS (PIVOT (SELECT dt, symbol, factor, value FROM zl) ON factor IN (" + ", ".join(f"'{n}'" for n in NAMES) + ") USING any_value(value) GROUP BY dt, symbol)"


@query("a_24_factor_correlation", f"""WITH {LONG}, r AS (SELECT dt, symbol, factor, {rk('value', 'factor, dt')} AS v FROM zl), d AS (SELECT a.factor AS a, b.factor AS b, a.dt, corr(a.v, b.v) AS c FROM r a JOIN r b ON a.dt = b.dt AND a.symbol = b.symbol AND a.factor < b.factor GROUP BY ALL HAVING count(*) >= 5),
 m AS (SELECT a, b, avg(c) AS c FROM d GROUP BY ALL) SELECT a, b, round(c, 6) AS corr, CASE WHEN abs(c) > 0.6 THEN 'high' WHEN abs(c) > 0.4 THEN 'medium' ELSE 'low' END AS level FROM m""")
def a24(spark, sf):
    names = sorted(NAMES)
    d = Q.factor_correlations(std_wide(spark, sf), names)
    level = F.when(F.abs("corr") > 0.6, "high").when(F.abs("corr") > 0.4, "medium").otherwise("low")
    return rounded(d.withColumn("level", level))


@query("a_25_pooled_correlation", f"""WITH {LONG}, r AS (SELECT factor, dt, symbol, {rk('value', 'factor')} AS v FROM zl)
 SELECT a.factor AS a, b.factor AS b, round(corr(a.v, b.v), 6) AS corr, count(*) AS n_pairs FROM r a JOIN r b ON a.dt = b.dt AND a.symbol = b.symbol AND a.factor < b.factor GROUP BY ALL""")
def a25(spark, sf):
    return rounded(pooled_matrix(std_wide(spark, sf), sorted(NAMES)))


def pooled_matrix(wide, names):
    """Pooled average ranks per factor (each factor's own distribution), correlated pairwise in one aggregate."""
    from pyspark.sql import Window as W

    long = wide.select("dt", "symbol", *names).unpivot(["dt", "symbol"], names, "factor", "value").where("value is not null")
    n = long.groupBy("factor", "value").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy("factor").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    n = n.select("factor", "value", (F.sum("c").over(w) - (F.col("c") - 1) / F.lit(2.0)).alias("rk"))
    r = long.join(n, ["factor", "value"]).groupBy("dt", "symbol").pivot("factor", names).agg(F.first("rk"))
    out = []
    for a, b in Q.pair_columns(names):
        ok = F.col(a).isNotNull() & F.col(b).isNotNull()
        out.append(F.struct(corr(F.when(ok, F.col(a)), F.when(ok, F.col(b))).alias("corr"), F.count(F.when(ok, 1)).alias("n_pairs")).alias(f"{a}|{b}"))
    cols = [f"{a}|{b}" for a, b in Q.pair_columns(names)]
    d = r.agg(*out).unpivot([], [F.col(f"`{c}`") for c in cols], "pair", "s")
    return d.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "s.corr", "s.n_pairs")


ACTIVE = ("MOM_20D", "RET_VOL_20D", "RSI_14")


@query("a_26_max_correlation_to_active", f"""WITH {WIDE}, c AS (SELECT dt, symbol, count(*) OVER (PARTITION BY dt) AS s, {_RKW} FROM fw), r AS (SELECT dt, symbol, {', '.join(f'coalesce({n}, (s + 1) / 2.0) AS {n}' for n in NAMES)} FROM c),
 l AS (UNPIVOT r ON {', '.join(NAMES)} INTO NAME factor VALUE v), d AS (SELECT a.factor, b.factor AS act, a.dt, CASE WHEN min(a.v) = max(a.v) OR min(b.v) = max(b.v) THEN 0 ELSE corr(a.v, b.v) END AS c FROM l a JOIN l b ON a.dt = b.dt AND a.symbol = b.symbol AND b.factor IN ({', '.join(f"'{a}'" for a in ACTIVE)}) AND a.factor <> b.factor GROUP BY ALL),
 m AS (SELECT factor, act, abs(avg(c)) AS c FROM d GROUP BY ALL) SELECT factor, round(max(c), 6) AS max_abs_corr FROM m GROUP BY factor""")
def a26(spark, sf):
    return rounded(Q.max_correlation(raw_wide(spark, sf), NAMES, ACTIVE))


@query("a_27_ic_series_correlation", f"WITH {IC} SELECT a.factor AS a, b.factor AS b, round(corr(a.ic, b.ic), 6) AS corr, count(*) AS n FROM ic a JOIN ic b ON a.dt = b.dt AND a.factor < b.factor GROUP BY ALL")
def a27(spark, sf):
    names = sorted(NAMES)
    w = daily_ic(spark, sf).groupBy("dt").pivot("factor", names).agg(F.first("ic"))
    out, cols = [], []
    for a, b in Q.pair_columns(names):
        ok = F.col(a).isNotNull() & F.col(b).isNotNull()
        out.append(F.struct(corr(F.when(ok, F.col(a)), F.when(ok, F.col(b))).alias("corr"), F.count(F.when(ok, 1)).alias("n")).alias(f"{a}|{b}"))
        cols.append(f"{a}|{b}")
    d = w.agg(*out).unpivot([], [F.col(f"`{c}`") for c in cols], "pair", "s")
    return rounded(d.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "s.corr", "s.n"))


from .side_queries import SIDE  # noqa: E402


@query("a_28_premium_correlation", f"""WITH {SIDE}, p AS (SELECT symbol, dt, premium, close / lag(close, 20) OVER w - 1 AS mom FROM sp WINDOW w AS (PARTITION BY symbol ORDER BY dt)), d AS (SELECT dt, corr(mom, premium) AS c FROM p WHERE mom IS NOT NULL AND premium IS NOT NULL GROUP BY dt HAVING count(*) >= 5)
 SELECT count(*) AS n, round(avg(c), 6) AS mean_corr, round(stddev_samp(c), 6) AS std_corr, round(median(c), 6) AS median_corr, round(max(abs(c)), 6) AS max_abs_corr FROM d""")
def a28(spark, sf):
    from ..functions.rolling import lag

    d = side(spark, sf).select("dt", "premium", (ratio("close", lag("close", 20)) - 1).alias("mom")).where("mom is not null and premium is not null")
    g = d.groupBy("dt").agg(corr("mom", "premium").alias("c"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    return rounded(g.agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean_corr"), F.stddev_samp("c").alias("std_corr"), F.median("c").alias("median_corr"), F.max(F.abs("c")).alias("max_abs_corr")))


@query("a_29_principal_component_share")
def a29(spark, sf):
    d = Q.principal_shares(with_stage_columns(panel(spark, sf)))
    return rounded(d.groupBy(F.year("dt").alias("yr")).agg(
        F.avg("pc1").alias("pc1_mean"), F.median("pc1").alias("pc1_median"), F.min("pc1").alias("pc1_min"), F.max("pc1").alias("pc1_max"), F.avg("pc2").alias("pc2_mean")))


@query("a_30_domain_comparison", f"WITH {LONG} SELECT factor, pool, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS std_value, count(*) AS n FROM zl GROUP BY factor, pool")
def a30(spark, sf):
    return rounded(std_long(spark, sf).groupBy("factor", "pool").agg(F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("std_value"), F.count(F.lit(1)).alias("n")))
