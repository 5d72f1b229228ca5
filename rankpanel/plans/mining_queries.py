"""M-01..M-15: factor mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.student import t_two_sided
from ..operators import mining as M
from ..operators import portfolio as PF
from ..operators import quality as Q
from ..operators import walkforward as WF
from ..operators.factors import CATALOG, to_long, with_stage_columns
from ..oracle.base import PANEL, SUPPLIER_PANEL, WINDOWS, corr, full, mean, slope, std
from ..oracle.factors import STAGED
from ..oracle.research import IC, LONG, NAMES, RAW, SUMMARY_COLS, avg_rank as rk, ic_cte, summary, t_two_sided as sql_t
from ..sources.panel import panel
from ..sources.stages import stage
from .quality_queries import QUALITY_SQL, quality_table
from .registry import query, rounded
from .research import daily_ic, raw_wide, std_long, std_wide, with_forward

# factor buckets; fixed values
BUCKETS = {
    "TREND_MOMENTUM": ("MOM_20D", "SHARPE_RATIO_20D", "SLOPE_20D", "VORTEX_14D", "BREAKOUT_20D", "PRICE_POSITION_20D"),
    "SUSTAINED_POSITION": ("PRICE_POSITION_120D", "CALMAR_RATIO_60D"),
    "VOLUME_CONFIRMATION": ("OBV_SLOPE_10D", "UP_DOWN_VOL_RATIO_20D", "CMF_20D"),
    "MICROSTRUCTURE": ("PV_CORR_20D", "AMIHUD_ILLIQUIDITY", "GK_VOL_RATIO_20D"),
    "TREND_STRENGTH_RISK": ("ADX_14D", "CORRELATION_TO_MARKET_20D", "MAX_DD_60D", "VOL_RATIO_20D"),
    "FUND_FLOW": ("SHARE_CHG_5D", "SHARE_CHG_10D", "SHARE_CHG_20D", "SHARE_ACCEL"),
    "LEVERAGE": ("MARGIN_CHG_10D", "MARGIN_BUY_RATIO"),
}
BK_SQL = "bk(factor, bucket) AS (VALUES " + ", ".join(f"('{f}', '{b}')" for b, fs in BUCKETS.items() for f in fs) + ")"


def bucket_table(spark):
    return spark.createDataFrame([(f, b) for b, fs in BUCKETS.items() for f in fs], "factor string, bucket string")


CANDS = M.algebra_names(NAMES)
IC_MIN = 0.01


def _op(op, a, b):
    return {"add": f"{a} + {b}", "sub": f"{a} - {b}", "mul": f"{a} * {b}", "div": f"CASE WHEN {b} <> 0 THEN {a} / {b} END",
            "max": f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a}, {b}) END", "min": f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({a}, {b}) END"}[op]


_PIV = "zw AS MATERIALIZED (PIVOT (SELECT dt, symbol, bar, fwd1, factor, value FROM zl) ON factor IN (" + ", ".join(f"'{n}'" for n in NAMES) + ") USING any_value(value) GROUP BY dt, symbol, bar, fwd1)"
_AL = "al0 AS (SELECT dt, symbol, bar, fwd1, " + ", ".join(f'round({_op(op, a, b)}, 10) AS "{n}"' for n, op, a, b in CANDS) + " FROM zw), al AS MATERIALIZED (UNPIVOT al0 ON " + ", ".join(f'"{n}"' for n, *_ in CANDS) + " INTO NAME factor VALUE value)"
ALG = f"{LONG}, {_PIV}, {_AL}, {ic_cte('ica', 'al', 'fwd1')}, vr AS (SELECT factor, count(*) / (SELECT count(*) FROM panel) AS valid_rate FROM al GROUP BY factor), asum AS ({summary('ica')})"


def algebra(spark, sf):
    def build():
        wide = std_wide(spark, sf)
        ic = M.algebra_ic(wide, CANDS, "fwd1")
        return Q.summarise(ic)

    return stage(spark, sf, "algebra", build)


def algebra_values(spark, sf):
    return M.algebra_long(std_wide(spark, sf), CANDS, ["dt", "symbol", "bar", "fwd1"])


@query("m_01_algebraic_search", f"WITH {ALG} SELECT a.factor, split_part(a.factor, '__', 1) AS parent_a, split_part(a.factor, '__', 3) AS parent_b, split_part(a.factor, '__', 2) AS op, round(valid_rate, 6) AS valid_rate, round(mean_ic, 6) AS mean_ic, round(p_value, 6) AS p_value FROM asum a JOIN vr ON a.factor = vr.factor WHERE valid_rate >= 0.5 AND abs(mean_ic) >= {IC_MIN}")
def m01(spark, sf):
    cells = panel(spark, sf).count()
    d = algebra(spark, sf).join(M.valid_rates(algebra_values(spark, sf), cells), "factor").where((F.col("valid_rate") >= 0.5) & (F.abs("mean_ic") >= IC_MIN))
    part = F.split("factor", "__")
    return rounded(d.select("factor", part[0].alias("parent_a"), part[2].alias("parent_b"), part[1].alias("op"), "valid_rate", "mean_ic", "p_value"))


@query("m_01_algebraic_ic_relational", f"WITH {ALG} SELECT factor, round(mean_ic, 6) AS mean_ic, n_obs FROM asum")
def m01r(spark, sf):
    d = Q.summarise(Q.rank_ic(algebra_values(spark, sf), "fwd1"))
    return rounded(d.select("factor", "mean_ic", "n_obs"))


CROSS_A, CROSS_B = ("MOM_20D", "RET_VOL_20D"), ("SHARE_CHG_10D", "MARGIN_CHG_10D")
CROSS = M.algebra_names(CROSS_A, CROSS_B)


def cross_wide(spark, sf):
    from ..operators.cross_section import zscore
    from ..operators.factors import factors_wide

    d = factors_wide(panel(spark, sf), [*CROSS_A, *CROSS_B], keep=("close",))
    return stage(spark, sf, "cross_wide", lambda: zscore(with_forward(d), [*CROSS_A, *CROSS_B], winsorise=True))


from ..oracle.factors import SQL as FSQL, _chg  # noqa: E402

_XS = {**{n: FSQL[n] for n in CROSS_A}, "SHARE_CHG_10D": _chg("fd_share", 10), "MARGIN_CHG_10D": _chg("rzye_c", 10)}
_XW = STAGED + f""", xs0 AS (SELECT *, last_value(rzye IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rzye_c FROM s),
 xs AS (SELECT symbol, dt, bar, {', '.join(f'{v} AS {k}' for k, v in _XS.items())}, lead(close) OVER w / close - 1 AS fwd1 FROM xs0 {WINDOWS}),
 xz AS MATERIALIZED (SELECT xs.symbol, xs.dt, xs.bar, fwd1, {', '.join(f'CASE WHEN {k} IS NOT NULL AND {k}s >= 1e-10 THEN (greatest({k}l, least({k}h, {k})) - {k}m) / {k}s END AS {k}' for k in _XS)} FROM xs JOIN (SELECT dt, {', '.join(f'avg({k}) AS {k}m, stddev_samp({k}) AS {k}s, quantile_cont({k}, 0.025) AS {k}l, quantile_cont({k}, 0.975) AS {k}h' for k in _XS)} FROM xs GROUP BY dt) g ON xs.dt = g.dt),
 xl0 AS (SELECT dt, symbol, bar, fwd1, {', '.join(f'round({_op(op, a, b)}, 10) AS "{n}"' for n, op, a, b in CROSS)} FROM xz), xl AS MATERIALIZED (UNPIVOT xl0 ON {', '.join(f'"{n}"' for n, *_ in CROSS)} INTO NAME factor VALUE value), {ic_cte('icx', 'xl', 'fwd1')},
 xp AS (SELECT factor, symbol, bar, {rk('value', 'factor, bar')} / count(*) OVER (PARTITION BY factor, bar) AS p FROM xl), xj AS (SELECT a.factor, a.p, b.p AS q FROM xp a JOIN xp b ON a.factor = b.factor AND a.symbol = b.symbol AND a.bar = b.bar + 3), xk AS (SELECT factor, {rk('p', 'factor')} AS a, {rk('q', 'factor')} AS b FROM xj), xa AS (SELECT factor, corr(a, b) AS ac FROM xk GROUP BY factor)"""


@query("m_02_cross_source_search", f"WITH {_XW} SELECT s.factor, round(mean_ic, 6) AS mean_ic, round(ac, 6) AS rank_autocorr, abs(mean_ic) >= {IC_MIN} AS pass_ic, ac >= 0.7 AS pass_rank FROM ({summary('icx')}) s JOIN xa ON s.factor = xa.factor")
def m02(spark, sf):
    long = M.algebra_long(cross_wide(spark, sf), CROSS, ["dt", "symbol", "bar", "fwd1"])
    d = Q.summarise(Q.rank_ic(long, "fwd1")).join(Q.rank_autocorrelation(long, 3).select("factor", "rank_autocorr"), "factor")
    return rounded(d.select("factor", "mean_ic", "rank_autocorr", (F.abs("mean_ic") >= IC_MIN).alias("pass_ic"), (F.col("rank_autocorr") >= 0.7).alias("pass_rank")))


_WN = (5, 10, 20, 40, 60, 120)


def _variant_sql():
    w = {}
    for n in _WN:
        f = lambda a, x, k=n: full(a, x, k)
        w[f"MOM_{n}D_V"] = f"close / lag(close, {n}) OVER w - 1"
        w[f"SLOPE_{n}D_V"] = slope("close", n)
        w[f"RET_VOL_{n}D_V"] = f"({std('r', n)}) * sqrt(252)"
        w[f"VOL_RATIO_{n}D_V"] = f"({mean('volume', n)}) / ({mean('volume', 3 * n)})"
        w[f"PV_CORR_{n}D_V"] = corr("r", "dvol", n)
        w[f"SHARPE_RATIO_{n}D_V"] = f"CASE WHEN ({std('r', n)}) <> 0 THEN ({mean('r', n)}) * 252 / (({std('r', n)}) * sqrt(252)) END"
        w[f"TSMOM_{n}D_V"] = f"close / lag(close, {n}) OVER w - 1"
        w[f"BREAKOUT_{n}D_V"] = f"CASE WHEN ({f('max(close)', 'close')}) <> ({f('min(close)', 'close')}) THEN (close - ({f('min(close)', 'close')})) / (({f('max(close)', 'close')}) - ({f('min(close)', 'close')})) END"
    return w


_VW = WINDOWS + ", " + ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (15, 30, 180, 360))
_VS = _variant_sql()


@query("m_03_window_variants", f"WITH {STAGED}, v0 AS (SELECT symbol, dt, lead(close) OVER w / close - 1 AS fwd1, {', '.join(f'round({e}, 10) AS {n}' for n, e in _VS.items())} FROM s {_VW}), v AS MATERIALIZED (UNPIVOT v0 ON {', '.join(_VS)} INTO NAME factor VALUE value), {ic_cte('icv', 'v', 'fwd1')} SELECT factor, round(mean_ic, 6) AS mean_ic, round(p_value, 6) AS p_value, n_obs FROM ({summary('icv')})")
def m03(spark, sf):
    d = with_forward(with_stage_columns(panel(spark, sf)))
    v = M.window_variants(_WN)
    wide = d.select("dt", "symbol", "fwd1", *[F.round(c, 10).alias(n) for n, c in v.items()])
    long = to_long(wide, list(v), ("dt", "symbol", "fwd1"))
    return rounded(Q.summarise(Q.rank_ic(long, "fwd1")).select("factor", "mean_ic", "p_value", "n_obs"))


_DEFAULT, _VALID = 20, 0.5
_VN = [n for n in _VS if f"_{_DEFAULT}D_" not in n]


@query("m_03_window_variants_valid", f"WITH {STAGED}, v0 AS (SELECT symbol, dt, lead(close) OVER w / close - 1 AS fwd1, {', '.join(f'round({_VS[n]}, 10) AS {n}' for n in _VN)} FROM s {_VW}), v AS MATERIALIZED (UNPIVOT v0 ON {', '.join(_VN)} INTO NAME factor VALUE value), vv AS (SELECT factor, count(*) / CAST((SELECT count(*) FROM panel) AS DOUBLE) AS valid_rate FROM v GROUP BY factor), {ic_cte('icv', 'v', 'fwd1')} SELECT u.factor, round(valid_rate, 6) AS valid_rate, round(mean_ic, 6) AS mean_ic, round(p_value, 6) AS p_value, n_obs FROM ({summary('icv')}) u JOIN vv ON vv.factor = u.factor WHERE valid_rate >= {_VALID}")
def m03v(spark, sf):
    """Without the default window, and only variants that are present in half of the panel."""
    d = with_forward(with_stage_columns(panel(spark, sf)))
    v = {n: c for n, c in M.window_variants(_WN).items() if n in _VN}
    long = to_long(d.select("dt", "symbol", "fwd1", *[F.round(c, 10).alias(n) for n, c in v.items()]), list(v), ("dt", "symbol", "fwd1"))
    long = stage(spark, sf, "window_variants", lambda: long)
    rates = M.valid_rates(long, panel(spark, sf).count()).where(F.col("valid_rate") >= _VALID)
    return rounded(Q.summarise(Q.rank_ic(long, "fwd1")).join(rates, "factor").select("factor", "valid_rate", "mean_ic", "p_value", "n_obs"))


_TR = f"""tr0 AS (SELECT dt, symbol, fwd1, factor, value, {rk('value', 'factor, dt')} / count(*) OVER (PARTITION BY factor, dt) AS rnk FROM zl),
 tr AS MATERIALIZED (SELECT dt, symbol, fwd1, factor || '__' || t AS factor, round(CASE t WHEN 'rank' THEN rnk WHEN 'log1p' THEN sign(value) * ln(1 + abs(value)) WHEN 'sqrt' THEN sign(value) * sqrt(abs(value)) WHEN 'sign' THEN sign(value) ELSE abs(value) END, 10) AS value FROM tr0, (VALUES ('rank'), ('log1p'), ('sqrt'), ('sign'), ('abs')) v(t))"""


@query("m_04_transform_search", f"WITH {LONG}, {_TR}, {ic_cte('ict', 'tr', 'fwd1')} SELECT factor, round(mean_ic, 6) AS mean_ic, round(p_value, 6) AS p_value FROM ({summary('ict')})")
def m04(spark, sf):
    long = M.transforms_long(std_long(spark, sf).select("dt", "symbol", "fwd1", "factor", "value"))
    return rounded(Q.summarise(Q.rank_ic(long, "fwd1")).select("factor", "mean_ic", "p_value"))


@query("m_04_transform_search_valid", f"WITH {LONG}, {_TR}, tv AS (SELECT factor, count(*) / CAST((SELECT count(*) FROM panel) AS DOUBLE) AS valid_rate FROM tr GROUP BY factor), {ic_cte('ict', 'tr', 'fwd1')} SELECT u.factor, round(valid_rate, 6) AS valid_rate, round(mean_ic, 6) AS mean_ic, round(p_value, 6) AS p_value FROM ({summary('ict')}) u JOIN tv ON tv.factor = u.factor WHERE valid_rate >= {_VALID}")
def m04v(spark, sf):
    long = stage(spark, sf, "transforms", lambda: M.transforms_long(std_long(spark, sf).select("dt", "symbol", "fwd1", "factor", "value")))
    rates = M.valid_rates(long, panel(spark, sf).count()).where(F.col("valid_rate") >= _VALID)
    return rounded(Q.summarise(Q.rank_ic(long, "fwd1")).join(rates, "factor").select("factor", "valid_rate", "mean_ic", "p_value"))


def supplier_tests(spark, sf):
    """One t-test per supplier: is its mean bar return different from 0?"""
    d = with_stage_columns(panel(spark, sf, "supplier", side=False)).where("r is not null").groupBy("symbol").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.count("r").alias("n")).where("n >= 30")
    d = d.withColumn("t", F.try_divide(F.col("m"), F.col("s") / F.sqrt("n")))
    return stage(spark, sf, "supplier_tests", lambda: d.select("symbol", F.round(t_two_sided("t", F.col("n") - 1), 10).alias("p_value")))


_BH = f"""WITH {SUPPLIER_PANEL}, a AS (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS r FROM panel), b AS (SELECT symbol, avg(r) / (stddev_samp(r) / sqrt(count(r))) AS t, count(r) AS n FROM a WHERE r IS NOT NULL GROUP BY symbol HAVING count(r) >= 30),
 p AS (SELECT symbol, round({sql_t('t', '(n - 1)')}, 10) AS p_value FROM b), o AS (SELECT *, row_number() OVER (ORDER BY p_value, symbol) AS i, count(*) OVER () AS n FROM p),
 q AS (SELECT symbol, p_value, least(1.0, min(p_value * n / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value, least(1.0, p_value * n) AS p_bonferroni FROM o)
 SELECT symbol, round(p_value, 6) AS p_value, round(q_value, 6) AS q_value, round(p_bonferroni, 6) AS p_bonferroni, q_value <= 0.05 AS reject FROM q"""


@query("m_05_false_discovery_control", _BH)
def m05(spark, sf):
    return rounded(M.benjamini_hochberg(supplier_tests(spark, sf), "p_value", "symbol"))


@query("m_05_false_discovery_control_split", _BH)
def m05s(spark, sf):
    """The same through the split ranking and block-wise suffix minimum (block of 10 here)."""
    return rounded(M.benjamini_hochberg(supplier_tests(spark, sf), "p_value", "symbol", limit=10))


def gates():
    return [
        ("valid", F.col("n_obs") >= 300), ("significant", F.col("p_value") < 0.6), ("hit_rate", F.col("hit_rate") >= 0.45), ("strength", F.abs(F.col("mean_ic")) >= 0.005),
    ]


_GC = ["n_obs >= 300", "p_value < 0.6", "hit_rate >= 0.45", "abs(mean_ic) >= 0.005"]
_GN = ["valid", "significant", "hit_rate", "strength"]
_CAS = " UNION ALL ".join(
    f"SELECT {i} AS position, '{_GN[i]}' AS gate, (SELECT count(*) FROM asum {'WHERE ' + ' AND '.join(_GC[:i]) if i else ''}) - count(*) AS eliminated, count(*) AS remaining FROM asum WHERE {' AND '.join(_GC[: i + 1])}" for i in range(4)
)


@query("m_06_gate_cascade", f"WITH {ALG} {_CAS}")
def m06(spark, sf):
    return M.gate_cascade(algebra(spark, sf), gates())


_SURV = f"surv AS (SELECT factor FROM asum WHERE {' AND '.join(_GC)} UNION ALL SELECT factor FROM ({summary('ic')}) WHERE p_value <= 1)"
_ASG = f"""{BK_SQL}, pl AS (SELECT s.factor AS name, bucket FROM surv s JOIN bk ON s.factor = bk.factor), ct AS (SELECT bucket, count(*) AS c FROM pl GROUP BY bucket),
 de AS (SELECT factor AS name FROM surv WHERE factor NOT IN (SELECT factor FROM bk)), pa AS (SELECT name, unnest(CASE WHEN name LIKE '%\\_\\_%\\_\\_%' ESCAPE '\\' THEN [split_part(name, '__', 1), split_part(name, '__', 3)] ELSE [name] END) AS parent FROM de),
 pb AS (SELECT name, arg_min(bk.bucket, (coalesce(c, 0), bk.bucket)) AS bucket FROM pa JOIN bk ON pa.parent = bk.factor LEFT JOIN ct ON bk.bucket = ct.bucket GROUP BY name), asg AS (SELECT name, bucket FROM pl UNION ALL SELECT de.name, pb.bucket FROM de LEFT JOIN pb ON de.name = pb.name)"""


def survivor_names(spark, sf):
    a = M.survivors(algebra(spark, sf), gates()).select("factor")
    return a.unionByName(Q.summarise(daily_ic(spark, sf)).select("factor"))


@query("m_07_bucket_assignment", f"WITH {ALG}, {ic_cte('ic', 'zl', 'fwd1')}, {_SURV}, {_ASG} SELECT name, bucket FROM asg")
def m07(spark, sf):
    return M.assign_buckets(survivor_names(spark, sf), bucket_table(spark))


@query("m_07_bucket_coverage", f"WITH {ALG}, {ic_cte('ic', 'zl', 'fwd1')}, {_SURV}, {_ASG}, n AS (SELECT bucket, count(*) AS n FROM asg WHERE bucket IS NOT NULL GROUP BY bucket) SELECT b.bucket, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n > 15 THEN 'over-represented' ELSE '' END AS warning FROM (SELECT DISTINCT bucket FROM bk) b LEFT JOIN n ON b.bucket = n.bucket")
def m07c(spark, sf):
    b = bucket_table(spark)
    return M.bucket_coverage(M.assign_buckets(survivor_names(spark, sf), b), b)


_PCW = "pc0 AS (SELECT factor, dt, symbol, " + rk("value", "factor") + " AS v FROM zl)"
_EDG = f"{_PCW}, ed AS (SELECT a.factor AS a, b.factor AS b, corr(a.v, b.v) AS c FROM pc0 a JOIN pc0 b ON a.dt = b.dt AND a.symbol = b.symbol AND a.factor < b.factor GROUP BY ALL)"


def pooled_ranks(spark, sf):
    from pyspark.sql import Window as W

    names = sorted(NAMES)
    long = std_wide(spark, sf).select("dt", "symbol", *names).unpivot(["dt", "symbol"], names, "factor", "value").where("value is not null")
    n = long.groupBy("factor", "value").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy("factor").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    n = n.select("factor", "value", (F.sum("c").over(w) - (F.col("c") - 1) / F.lit(2.0)).alias("rk"))
    return long.join(n, ["factor", "value"]).groupBy("dt", "symbol").pivot("factor", names).agg(F.first("rk"))


@query("m_08_correlation_blocks", f"WITH {LONG}, {_EDG} SELECT a, b, round(c, 6) AS corr FROM ed")
def m08c(spark, sf):
    return rounded(M.gram_correlations(pooled_ranks(spark, sf), sorted(NAMES)).select("a", "b", "corr"))


@query("m_08_redundancy_pruning", f"""WITH RECURSIVE {LONG}, {_EDG}, es AS (SELECT a AS x, b AS y FROM ed WHERE abs(c) > 0.5 UNION SELECT b, a FROM ed WHERE abs(c) > 0.5), reach(x, y) AS (SELECT factor, factor FROM (SELECT DISTINCT factor FROM zl) UNION SELECT r.x, e.y FROM reach r JOIN es e ON r.y = e.x),
 cmp AS (SELECT x AS factor, min(y) AS component FROM reach GROUP BY x), {ic_cte('ic', 'zl', 'fwd1')}, q AS (SELECT factor, round(abs(mean_ic), 10) AS score FROM ({summary('ic')}))
 SELECT component, arg_max(q.factor, (score, q.factor)) AS factor, round(max(score), 6) AS score, count(*) AS members FROM q JOIN cmp ON q.factor = cmp.factor GROUP BY component""")
def m08(spark, sf):
    s = Q.summarise(daily_ic(spark, sf)).select("factor", F.round(F.abs("mean_ic"), 10).alias("score"))
    return rounded(M.prune(s, M.gram_correlations(pooled_ranks(spark, sf), sorted(NAMES)), 0.5))


@query("m_09_registry", f"""WITH {ALG}, {ic_cte('ic', 'zl', 'fwd1')}, seed AS (SELECT DISTINCT factor AS name, 'hand_crafted' AS source FROM zl), ent AS (SELECT factor AS name, 'algebraic' AS source FROM asum), q AS (SELECT factor AS name, p_value < 0.6 AS passed, round(mean_ic, 6) AS score FROM asum UNION ALL SELECT factor, p_value < 0.6, round(mean_ic, 6) FROM ({summary('ic')}))
 SELECT z.name, source, score, coalesce(passed, false) AS passed FROM (SELECT * FROM seed UNION ALL SELECT * FROM ent) z LEFT JOIN q ON z.name = q.name""")
def m09(spark, sf):
    empty = lambda d, src: d.select(F.col("factor").alias("name"), F.lit(src).alias("source"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("passed"))
    base, alg = Q.summarise(daily_ic(spark, sf)), algebra(spark, sf)
    zoo = empty(base, "hand_crafted")
    zoo = M.register_new(zoo, empty(base.select("factor").unionByName(alg.select("factor")), "algebraic"))
    qual = base.select("factor", "mean_ic", "p_value").unionByName(alg.select("factor", "mean_ic", "p_value"))
    return M.update_quality(zoo, qual.select(F.col("factor").alias("name"), F.round("mean_ic", 6).alias("score"), (F.col("p_value") < 0.6).alias("passed")))


RF = 5
_ROT = f"""c AS (SELECT factor, bar // {RF} AS p, symbol, value, close, row_number() OVER (PARTITION BY factor, bar ORDER BY round(value, 10) DESC, symbol) AS pos FROM zl WHERE bar % {RF} = 0),
 px AS (SELECT symbol, bar // {RF} AS p, close, lead(close) OVER (PARTITION BY symbol ORDER BY bar) / close - 1 AS nr FROM panel WHERE bar % {RF} = 0), h AS (SELECT factor, c.p, avg(coalesce(nr, 0) * (1 - 0.0002)) AS r, count(nr) AS k FROM c JOIN px ON c.symbol = px.symbol AND c.p = px.p WHERE pos <= 2 GROUP BY ALL), b AS (SELECT p, avg(nr) AS br FROM px WHERE nr IS NOT NULL GROUP BY p),
 e AS (SELECT factor, h.p, r, br, sum(ln(1 + r)) OVER (PARTITION BY factor ORDER BY h.p) AS lg FROM h JOIN b ON h.p = b.p), d AS (SELECT *, 1 - exp(lg - greatest(0, max(lg) OVER (PARTITION BY factor ORDER BY p))) AS dd FROM e)"""


@query("m_10_rotation_check", f"WITH {LONG}, {_ROT}, g AS (SELECT factor, count(*) AS periods, sum(ln(1 + r)) AS log_growth, sum(ln(1 + r)) - sum(ln(1 + br)) AS log_excess, avg(r) / stddev_pop(r) * sqrt(252 / {RF}.0) AS sharpe, max(dd) AS max_drawdown FROM d GROUP BY factor) SELECT factor, periods, round(log_growth, 6) AS log_growth, round(log_excess, 6) AS log_excess, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown, log_growth > ln(1.3) AND sharpe > 0.3 AND max_drawdown < 0.5 AS passed FROM g")
def m10(spark, sf):
    from pyspark.sql import Window as W

    from ..functions.expr import ratio
    from ..functions.ranking import ordinal_rank

    z = std_long(spark, sf).where(F.col("bar") % RF == 0).withColumn("v", F.round("value", 10))
    c = z.withColumn("pos", ordinal_rank("v", ["factor", "bar"], descending=True)).where("pos <= 2").select("factor", "bar", "symbol")
    p = panel(spark, sf).where(F.col("bar") % RF == 0).select("symbol", "bar", "close")
    p = p.withColumn("nr", ratio(F.lead("close").over(W.partitionBy("symbol").orderBy("bar")), "close") - 1).drop("close")
    h = c.join(p, ["symbol", "bar"]).groupBy("factor", "bar").agg(F.avg(F.coalesce("nr", F.lit(0.0)) * (1 - 0.0002)).alias("r"))
    b = p.where("nr is not null").groupBy("bar").agg(F.avg("nr").alias("br"))
    h = h.join(b, "bar").withColumnRenamed("bar", "period")
    stats = PF.equity_stats(h, ["factor"], F.lit(252.0 / RF), "r")
    logs = h.groupBy("factor").agg(F.sum(F.log1p("r")).alias("log_growth"), (F.sum(F.log1p("r")) - F.sum(F.log1p("br"))).alias("log_excess"))
    d = stats.join(logs, "factor")
    ok = (F.col("log_growth") > F.log(F.lit(1.3))) & (F.col("sharpe") > 0.3) & (F.col("max_drawdown") < 0.5)
    return rounded(d.select("factor", "periods", "log_growth", "log_excess", "sharpe", "max_drawdown", ok.alias("passed")))


@query("m_11_long_short_portfolio", f"""WITH {LONG}, c AS (SELECT factor, bar // {RF} AS p, symbol, row_number() OVER (PARTITION BY factor, bar ORDER BY round(value, 10) DESC, symbol) AS hi, row_number() OVER (PARTITION BY factor, bar ORDER BY round(value, 10), symbol) AS lo, count(*) OVER (PARTITION BY factor, bar) AS n FROM zl WHERE bar % {RF} = 0),
 dr AS (SELECT symbol, bar, (bar - 1) // {RF} AS p, r FROM s WHERE bar >= 1), x AS (SELECT factor, dr.bar, (avg(r) FILTER (hi <= 2) - avg(r) FILTER (lo <= 2)) / 2 AS ls, avg(r) FILTER (hi <= 2) AS top FROM c JOIN dr ON c.symbol = dr.symbol AND c.p = dr.p WHERE n >= 4 GROUP BY ALL)
 SELECT factor, count(*) AS bars, round(sum(ls), 6) AS ls_total, round(avg(ls) / stddev_samp(ls) * sqrt(252), 6) AS ls_sharpe, round(avg(CAST(ls > 0 AS INT)), 6) AS ls_win_rate, round(sum(ln(1 + top)), 6) AS top_log_growth FROM x WHERE ls IS NOT NULL GROUP BY factor""")
def m11(spark, sf):
    from pyspark.sql import Window as W

    from ..functions.ranking import ordinal_rank

    z = std_long(spark, sf).where(F.col("bar") % RF == 0).withColumn("v", F.round("value", 10))
    k = ["factor", "bar"]
    z = z.select("factor", (F.col("bar") / RF).cast("int").alias("p"), "symbol", ordinal_rank("v", k, descending=True).alias("hi"), ordinal_rank("v", k).alias("lo"), F.count(F.lit(1)).over(W.partitionBy(*k)).alias("n"))
    z = z.where((F.col("n") >= 4) & ((F.col("hi") <= 2) | (F.col("lo") <= 2)))
    r = with_stage_columns(panel(spark, sf)).where("bar >= 1").select("symbol", "bar", F.floor((F.col("bar") - 1) / RF).cast("int").alias("p"), "r")
    top, bot = F.avg(F.when(F.col("hi") <= 2, F.col("r"))), F.avg(F.when(F.col("lo") <= 2, F.col("r")))
    x = z.join(r, ["symbol", "p"]).groupBy("factor", "bar").agg(((top - bot) / 2).alias("ls"), top.alias("top")).where("ls is not null")
    return rounded(x.groupBy("factor").agg(
        F.count(F.lit(1)).alias("bars"), F.sum("ls").alias("ls_total"), (F.avg("ls") / F.stddev_samp("ls") * F.sqrt(F.lit(252.0))).alias("ls_sharpe"),
        F.avg((F.col("ls") > 0).cast("double")).alias("ls_win_rate"), F.sum(F.log1p("top")).alias("top_log_growth")))


ENUM = ", ".join(f"'{n}'" for n in NAMES)
_C3 = f"nm AS (SELECT DISTINCT factor AS f FROM zl), c3 AS (SELECT a.f || ' + ' || b.f || ' + ' || c.f AS combo, [a.f, b.f, c.f] AS names FROM nm a JOIN nm b ON a.f < b.f JOIN nm c ON b.f < c.f)"


def combos3(spark, sf):
    return WF.enumerate_combos(std_long(spark, sf).select("factor").distinct(), [3])


@query("m_12_bucket_constraint", f"WITH {LONG}, {_C3}, {BK_SQL}, e AS (SELECT combo, unnest(names) AS factor FROM c3), p AS (SELECT combo, bucket, count(*) AS c FROM e JOIN bk ON e.factor = bk.factor GROUP BY ALL), g AS (SELECT combo, count(*) AS n_buckets, max(c) AS max_in_bucket FROM p GROUP BY combo) SELECT *, CASE WHEN n_buckets < 3 THEN 'too few buckets' WHEN max_in_bucket > 2 THEN 'bucket over limit' ELSE 'ok' END AS reason, n_buckets >= 3 AND max_in_bucket <= 2 AS passed FROM g")
def m12(spark, sf):
    return M.combo_buckets(combos3(spark, sf), bucket_table(spark))


@query("m_13_parent_diversity", f"""WITH {ALG}, sv AS (SELECT factor AS f FROM asum WHERE abs(mean_ic) >= 0.005 UNION ALL SELECT DISTINCT factor FROM zl), c AS (SELECT a.f || ' + ' || b.f AS combo, [a.f, b.f] AS names FROM sv a JOIN sv b ON a.f < b.f), e AS (SELECT combo, unnest(names) AS f FROM c),
 p AS (SELECT combo, unnest(CASE WHEN f LIKE '%\\_\\_%\\_\\_%' ESCAPE '\\' THEN [split_part(f, '__', 1), split_part(f, '__', 3)] ELSE [f] END) AS parent FROM e), n AS (SELECT combo, parent, count(*) AS c FROM p GROUP BY ALL) SELECT combo, max(c) AS max_parent, max(c) <= 1 AS diverse FROM n GROUP BY combo""")
def m13(spark, sf):
    names = algebra(spark, sf).where(F.abs("mean_ic") >= 0.005).select("factor").unionByName(std_long(spark, sf).select("factor").distinct())
    return M.parent_diversity(WF.enumerate_combos(names, [2]), 1)


@query("m_14_factor_frequency", f"""WITH {ALG}, t AS (SELECT split_part(factor, '__', 1) AS a, split_part(factor, '__', 3) AS b, abs(mean_ic) AS s FROM asum), top AS (SELECT * FROM t ORDER BY round(s, 10) DESC, a, b LIMIT 60), f1 AS (SELECT f, count(*) AS n FROM (SELECT a AS f FROM top UNION ALL SELECT b FROM top) GROUP BY f), f2 AS (SELECT f, count(*) AS n FROM (SELECT a AS f FROM t UNION ALL SELECT b FROM t) GROUP BY f)
 SELECT f2.f AS factor, coalesce(f1.n, 0) AS n_top, f2.n AS n_all, round(coalesce(f1.n, 0) / 60.0 - f2.n / (SELECT count(*) FROM t), 6) AS shift FROM f2 LEFT JOIN f1 ON f1.f = f2.f""")
def m14(spark, sf):
    part = F.split("factor", "__")
    t = algebra(spark, sf).select(F.concat_ws(" + ", part[0], part[2]).alias("combo"), part[0].alias("a"), part[2].alias("b"), F.round(F.abs("mean_ic"), 10).alias("s"))
    total = t.count()
    top = M.factor_frequency(t.orderBy(F.desc("s"), "a", "b").limit(60)).withColumnRenamed("n", "n_top")
    d = M.factor_frequency(t).withColumnRenamed("n", "n_all").join(top, "factor", "left").withColumn("n_top", F.coalesce("n_top", F.lit(0)))
    return rounded(d.select("factor", "n_top", "n_all", (F.col("n_top") / 60.0 - F.col("n_all") / F.lit(total)).alias("shift")))


_TH = {"hit_rate": (0.45, 0.5, 0.52), "mean_ic": (-0.01, 0.0, 0.01, 0.02), "n_obs": (300.0, 330.0)}


@query("m_15_threshold_tables", f"WITH {ALG} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({t} AS DOUBLE) AS threshold, CAST(sum(CAST(round({m}, 10) >= {t} AS INT)) AS BIGINT) AS passing, count(*) AS total FROM asum" for m, ts in _TH.items() for t in ts))
def m15(spark, sf):
    d = algebra(spark, sf).select(F.round("hit_rate", 10).alias("hit_rate"), F.round("mean_ic", 10).alias("mean_ic"), F.col("n_obs").cast("double").alias("n_obs"))
    return M.threshold_table(d, _TH)
