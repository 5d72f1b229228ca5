"""X-01..X-22."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.expr import corr, ratio
from ..functions.ranking import avg_rank, ordinal_rank, pct_rank, rank01, ranked
from ..operators import cross_section as X
from ..operators.factors import to_long, with_stage_columns
from ..oracle.base import PANEL, SUPPLIER_PANEL, WINDOWS, mean, std
from ..oracle.factors import STAGED
from ..oracle.research import LONG, NAMES, RAW, WIDE, avg_rank as rk
from ..sources.panel import panel
from .registry import query, rounded
from .research import BOUNDED, raw_long, raw_wide, std_long, std_wide

FREE = [n for n in NAMES if n not in BOUNDED]
ID3 = ("dt", "symbol", "factor", "value")


def long_out(d, names):
    return rounded(to_long(d, names).select(*ID3))


_F = ", ".join(f"'{n}'" for n in FREE)
_Bd = ", ".join(f"'{n}'" for n in BOUNDED)


@query("x_01_zscore", f"WITH {RAW} SELECT dt, symbol, factor, round(v, 6) AS value FROM (SELECT *, CASE WHEN stddev_samp(value) OVER x >= 1e-10 THEN (value - avg(value) OVER x) / stddev_samp(value) OVER x END AS v FROM rl WHERE factor IN ({_F}) WINDOW x AS (PARTITION BY dt, factor)) WHERE v IS NOT NULL")
def x01(spark, sf):
    return long_out(X.zscore(raw_wide(spark, sf), FREE), FREE)


@query("x_02_winsorise", f"WITH {LONG} SELECT dt, symbol, factor, round(value, 6) AS value FROM zl WHERE factor IN ({_F})")
def x02(spark, sf):
    return long_out(X.zscore(raw_wide(spark, sf), FREE, winsorise=True), FREE)


@query("x_03_bounded_rank", f"WITH {LONG} SELECT dt, symbol, factor, round(value, 6) AS value FROM zl WHERE factor IN ({_Bd})")
def x03(spark, sf):
    d = raw_wide(spark, sf)
    return long_out(d.select("dt", "symbol", *[(pct_rank(c, "dt") - 0.5).alias(c) for c in BOUNDED]), BOUNDED)


@query("x_04_pool_zscore", f"""WITH {RAW}, g AS (SELECT dt, pool, factor, avg(value) AS m, stddev_samp(value) AS sd, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, count(*) AS n FROM rl WHERE factor IN ({_F}) GROUP BY ALL)
 SELECT rl.dt, symbol, rl.factor, round(CASE WHEN n >= 2 AND sd >= 1e-10 THEN (greatest(lo, least(hi, value)) - m) / sd ELSE value END, 6) AS value FROM rl JOIN g ON rl.dt = g.dt AND rl.pool = g.pool AND rl.factor = g.factor""")
def x04(spark, sf):
    return long_out(X.zscore(raw_wide(spark, sf), FREE, winsorise=True, by=("dt", "pool"), pass_small=True), FREE)


@query("x_05_average_rank", f"WITH {RAW} SELECT dt, symbol, factor, {rk('value', 'dt, factor')} AS rank, round({rk('value', 'dt, factor')} / count(*) OVER (PARTITION BY dt, factor), 6) AS pct FROM rl")
def x05(spark, sf):
    d = raw_long(spark, sf)
    k = ["dt", "factor"]
    return rounded(d.select("dt", "symbol", "factor", avg_rank("value", k).alias("rank"), pct_rank("value", k).alias("pct")))


_SUP = f"WITH {SUPPLIER_PANEL}, v AS (SELECT symbol, dt, volume FROM panel WHERE volume IS NOT NULL)"


@query("x_05_average_rank_split", f"{_SUP} SELECT symbol, dt, volume, {rk('volume', 'dt')} AS rank FROM v")
def x05s(spark, sf):
    """Same ranks with every date's cross-section spread over several tasks (volume has many ties)."""
    d = panel(spark, sf, "supplier", side=False).select("symbol", "dt", "volume")
    return ranked(d, "volume", "rank", by=["dt"], average=True, limit=0)


@query("x_06_rank01", f"WITH {WIDE} SELECT dt, symbol, round((row_number() OVER (PARTITION BY dt ORDER BY PV_CORR_20D NULLS FIRST, symbol) - 1) / greatest(count(*) OVER (PARTITION BY dt) - 1, 1), 6) AS r01 FROM fw")
def x06(spark, sf):
    return rounded(raw_wide(spark, sf).select("dt", "symbol", rank01("PV_CORR_20D", "dt").alias("r01")))


@query("x_07_single_factor_fallback", f"""WITH {WIDE}, g AS (SELECT dt, avg(CMF_20D) AS m, stddev_samp(CMF_20D) AS sd, count(CMF_20D) AS n, quantile_cont(CMF_20D, 0.025) AS lo, quantile_cont(CMF_20D, 0.975) AS hi FROM fw GROUP BY dt)
 SELECT fw.dt, symbol, round(CASE WHEN n >= 2 AND sd >= 1e-10 THEN (CMF_20D - m) / sd ELSE CMF_20D END, 6) AS standardised, round(CASE WHEN n >= 2 AND sd >= 1e-10 THEN (greatest(lo, least(hi, CMF_20D)) - m) / sd ELSE CMF_20D END, 6) AS processed FROM fw JOIN g ON fw.dt = g.dt WHERE CMF_20D IS NOT NULL""")
def x07(spark, sf):
    d = raw_wide(spark, sf).select("dt", "symbol", F.col("CMF_20D").alias("standardised"), F.col("CMF_20D").alias("processed")).where("processed is not null")
    d = X.zscore(d, ["standardised"], pass_small=True)
    return rounded(X.zscore(d, ["processed"], winsorise=True, pass_small=True))


_REP = " UNION ALL ".join(f"""SELECT '{n}' AS factor, sum(CAST({n} IS NULL AS INT)) AS nulls_before, sum(CAST({n} IS NULL OR sd IS NULL OR sd < 1e-10 AS INT)) AS nulls_after,
 sum(CAST(coalesce(sd >= 1e-10 AND {n} < lo, false) AS INT)) AS clipped_low, sum(CAST(coalesce(sd >= 1e-10 AND {n} > hi, false) AS INT)) AS clipped_high, count(DISTINCT CASE WHEN sd < 1e-10 THEN dt END) AS flat_dates
 FROM (SELECT dt, {n}, stddev_samp({n}) OVER x AS sd, quantile_cont({n}, 0.025) OVER x AS lo, quantile_cont({n}, 0.975) OVER x AS hi FROM fw WINDOW x AS (PARTITION BY dt))""" for n in FREE)


@query("x_08_processing_report", f"WITH {WIDE} SELECT factor, CAST(nulls_before AS BIGINT) AS nulls_before, CAST(nulls_after AS BIGINT) AS nulls_after, CAST(clipped_low AS BIGINT) AS clipped_low, CAST(clipped_high AS BIGINT) AS clipped_high, flat_dates FROM ({_REP})")
def x08(spark, sf):
    return X.processing_report(raw_wide(spark, sf), FREE, BOUNDED)


_EMA = lambda b: f"list_sum(list_transform(a, lambda x, i: coalesce(x, 0) * power({b}, len(a) - i))) / list_sum(list_transform(a, lambda x, i: CASE WHEN x IS NULL THEN 0 ELSE power({b}, len(a) - i) END))"


@query("x_09_temporal_ema", f"""WITH {LONG}, s1f AS (SELECT p.symbol, p.dt, z.value FROM panel p LEFT JOIN (SELECT * FROM zl WHERE factor = 'MOM_20D') z ON p.symbol = z.symbol AND p.dt = z.dt),
 l AS (SELECT symbol, dt, list(value) OVER u AS a, count(value) OVER u AS n FROM s1f WINDOW u AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT symbol, dt, round({_EMA('2 / 3.0')}, 6) AS value FROM l WHERE n > 0""")
def x09(spark, sf):
    d = R.ewm_mean(std_wide(spark, sf).select("symbol", "dt", "MOM_20D"), "MOM_20D", "value", span=5, adjust=True)
    return rounded(d.where("value is not null").select("symbol", "dt", "value"))


@query("x_10_rank_ema", f"""WITH {RAW}, p AS (SELECT symbol, dt, {rk('value', 'dt')} / count(*) OVER (PARTITION BY dt) AS p FROM rl WHERE factor = 'MOM_20D'),
 l AS (SELECT symbol, dt, list(p) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM p)
 SELECT symbol, dt, round(list_reduce(a, lambda q, x: q + (x - q) * 2 / 6.0), 6) AS value FROM l""")
def x10(spark, sf):
    d = raw_wide(spark, sf).select("symbol", "dt", pct_rank("MOM_20D", "dt").alias("p"))
    d = R.ewm_mean(d, "p", "value", span=5)
    return rounded(d.where("value is not null").select("symbol", "dt", "value"))


_OLS = """m AS (SELECT dt, symbol, MOM_20D AS y, RET_VOL_20D AS x1, VOL_RATIO_20D AS x2 FROM fw WHERE MOM_20D IS NOT NULL AND RET_VOL_20D IS NOT NULL AND VOL_RATIO_20D IS NOT NULL),
 c AS (SELECT *, y - avg(y) OVER d AS cy, x1 - avg(x1) OVER d AS c1, x2 - avg(x2) OVER d AS c2, count(*) OVER d AS n FROM m WINDOW d AS (PARTITION BY dt)),
 q AS (SELECT *, sum(c1 * c1) OVER d AS s11, sum(c2 * c2) OVER d AS s22, sum(c1 * c2) OVER d AS s12, sum(c1 * cy) OVER d AS s1, sum(c2 * cy) OVER d AS s2 FROM c WHERE n >= 10 WINDOW d AS (PARTITION BY dt))"""


@query("x_11_ols_residual", f"WITH {WIDE}, {_OLS} SELECT dt, symbol, round(cy - (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) * c1 - (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) * c2, 6) AS residual FROM q")
def x11(spark, sf):
    d = X.residual(raw_wide(spark, sf), "MOM_20D", ["RET_VOL_20D", "VOL_RATIO_20D"], "residual")
    return rounded(d.select("dt", "symbol", "residual"))


@query("x_12_aggregate_signal", f"WITH {RAW} SELECT dt, factor, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value FROM rl GROUP BY dt, factor")
def x12(spark, sf):
    return rounded(raw_long(spark, sf).groupBy("dt", "factor").agg(F.avg("value").alias("mean_value"), F.median("value").alias("median_value")))


@query("x_13_veto", f"""WITH {WIDE}, r AS (SELECT dt, symbol, RSI_14 AS v, (row_number() OVER (PARTITION BY dt ORDER BY RSI_14 NULLS FIRST, symbol) - 1) / greatest(count(*) OVER (PARTITION BY dt) - 1, 1) AS r01, count(RSI_14) OVER (PARTITION BY dt) AS n FROM fw)
 SELECT dt, symbol, CAST(CASE WHEN n >= 5 AND v IS NOT NULL AND r01 >= 0.9 THEN -1.0 ELSE 0.0 END AS DOUBLE) AS penalty FROM r""")
def x13(spark, sf):
    return raw_wide(spark, sf).select("dt", "symbol", X.veto("RSI_14", 0.9, -1.0).alias("penalty"))


COMBOS = (
    ("MOM_20D + RET_VOL_20D", (("MOM_20D", 1.0, 0.6), ("RET_VOL_20D", -1.0, 0.4))),
    ("CMF_20D + MOM_20D + VOL_RATIO_20D", (("CMF_20D", 2.0, 0.5), ("MOM_20D", 1.0, 0.3), ("VOL_RATIO_20D", -0.5, 0.2))),
    ("PV_CORR_20D + RSI_14", (("PV_CORR_20D", 1.0, 0.5), ("RSI_14", 1.0, 0.5))),
)


def combo_table(spark):
    rows = [(c, f, a, w) for c, fs in COMBOS for f, a, w in fs]
    return spark.createDataFrame(rows, "combo string, factor string, coef double, weight double")


CW = "cw(combo, factor, coef, weight) AS (VALUES " + ", ".join(f"('{c}', '{f}', {a}, {w})" for c, fs in COMBOS for f, a, w in fs) + ")"


@query("x_14_composite_score", f"WITH {LONG}, {CW} SELECT combo, dt, symbol, round(CASE WHEN sum(coef * value) <> 0 THEN sum(coef * value) END, 6) AS score FROM zl JOIN cw ON zl.factor = cw.factor GROUP BY combo, dt, symbol")
def x14(spark, sf):
    return rounded(X.composite(std_long(spark, sf), combo_table(spark)))


@query("x_15_weighted_signal", f"WITH {LONG}, {CW} SELECT combo, dt, symbol, round(sum(weight * value) / sum(weight), 6) AS signal FROM zl JOIN cw ON zl.factor = cw.factor GROUP BY combo, dt, symbol")
def x15(spark, sf):
    return rounded(X.weighted_signal(std_long(spark, sf), combo_table(spark)))


@query("x_16_rank_sum", f"""WITH {LONG}, {CW}, r AS (SELECT zl.dt, zl.symbol, zl.factor, {rk('value', 'zl.dt, zl.factor')} AS a, {rk('value', 'zl.dt, zl.factor', True)} AS d FROM zl)
 SELECT combo, dt, symbol, sum(CASE WHEN coef >= 0 THEN a ELSE d END) AS rank_sum FROM r JOIN cw ON r.factor = cw.factor GROUP BY combo, dt, symbol""")
def x16(spark, sf):
    k = ["dt", "factor"]
    d = std_long(spark, sf).select("dt", "symbol", "factor", avg_rank("value", k).alias("a"), avg_rank("value", k, True).alias("d"))
    d = d.join(combo_table(spark), "factor")
    return d.groupBy("combo", "dt", "symbol").agg(F.sum(F.when(F.col("coef") >= 0, F.col("a")).otherwise(F.col("d"))).alias("rank_sum"))


@query("x_17_null_policy", f"""WITH {LONG}, {CW}, k AS (SELECT combo, count(*) AS size FROM cw GROUP BY combo)
 SELECT cw.combo, dt, symbol, round(sum(coef * value) / size, 6) AS fixed_denominator, round(sum(coef * value) / count(*), 6) AS valid_count FROM zl JOIN cw ON zl.factor = cw.factor JOIN k ON cw.combo = k.combo GROUP BY cw.combo, dt, symbol, size""")
def x17(spark, sf):
    ct = combo_table(spark)
    size = ct.groupBy("combo").agg(F.count(F.lit(1)).alias("size"))
    d = std_long(spark, sf).join(ct.join(size, "combo"), "factor")
    s = F.sum(F.col("coef") * F.col("value"))
    g = d.groupBy("combo", "dt", "symbol", "size").agg(s.alias("s"), F.count(F.lit(1)).alias("n"))
    return rounded(g.select("combo", "dt", "symbol", (F.col("s") / F.col("size")).alias("fixed_denominator"), (F.col("s") / F.col("n")).alias("valid_count")))


@query("x_18_market_proxy", f"WITH {PANEL} SELECT dt, round(coalesce(max(CASE WHEN symbol = 'Brand#99' THEN close END), max(CASE WHEN symbol = 'Brand#3' AND traded THEN close END), avg(close)), 6) AS proxy FROM panel GROUP BY dt")
def x18(spark, sf):
    d = panel(spark, sf)
    d = d.withColumn("close", F.when((F.col("symbol") != "Brand#3") | F.col("traded"), F.col("close")))
    return rounded(X.market_proxy(d, ["Brand#99", "Brand#3"]))


@query("x_19_tradability_mask", f"""WITH {STAGED} SELECT symbol, dt, coalesce(r > 0.095, false) OR NOT traded OR coalesce(volume, 0) <= 0 AS blocked, round(CASE WHEN NOT (coalesce(r > 0.095, false) OR NOT traded OR coalesce(volume, 0) <= 0) THEN close / lag(close, 20) OVER w - 1 END, 6) AS score FROM s WINDOW w AS (PARTITION BY symbol ORDER BY dt)""")
def x19(spark, sf):
    d = with_stage_columns(panel(spark, sf)).withColumn("blocked", X.untradable())
    return rounded(d.select("symbol", "dt", "blocked", F.when(~F.col("blocked"), ratio("close", R.lag("close", 20)) - 1).alias("score")))


@query("x_20_rank_monitor", f"""WITH {LONG}, {CW}, sc AS (SELECT dt, symbol, any_value(pool) AS pool, CASE WHEN sum(coef * value) <> 0 THEN sum(coef * value) END AS score FROM zl JOIN cw ON zl.factor = cw.factor WHERE combo = 'MOM_20D + RET_VOL_20D' GROUP BY dt, symbol),
 r AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY score DESC, symbol) AS pos, (row_number() OVER (PARTITION BY dt ORDER BY score, symbol) - 1) / greatest(count(*) OVER (PARTITION BY dt) - 1, 1) AS r01 FROM sc WHERE score IS NOT NULL)
 SELECT symbol, count(*) AS n, round(avg(CAST(pos <= 2 AS INT)), 6) AS top2_rate, round(avg(CAST(pos <= 10 AS INT)), 6) AS top10_rate, round(avg(r01), 6) AS rank_mean, round(median(r01), 6) AS rank_median, round(quantile_cont(r01, 0.1), 6) AS rank_p10, round(quantile_cont(r01, 0.9), 6) AS rank_p90 FROM r WHERE pool = 4 GROUP BY symbol""")
def x20(spark, sf):
    ct = combo_table(spark).where("combo = 'MOM_20D + RET_VOL_20D'")
    s = X.composite(std_long(spark, sf), ct).withColumn("pool", F.regexp_extract("symbol", r"(\d+)$", 1).cast("int") % 5)
    return rounded(X.rank_monitor(s, F.col("pool") == 4))


@query("x_21_dispersion", f"""WITH {STAGED}, a AS (SELECT symbol, dt, r, close / lag(close, 5) OVER w - 1 AS r5, close / lag(close, 20) OVER w - 1 AS r20 FROM s WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
 d AS (SELECT dt, stddev_samp(r5) AS d5, stddev_samp(r20) AS d20, avg(r) AS mkt FROM a GROUP BY dt), v AS (SELECT *, CASE WHEN count(mkt) OVER w = 20 THEN stddev_samp(mkt) OVER w END AS vol FROM d WINDOW w AS (ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 q AS (SELECT * FROM v WHERE d20 IS NOT NULL AND vol IS NOT NULL), c AS (SELECT quantile_cont(d20, 0.25) AS a, quantile_cont(d20, 0.5) AS b, quantile_cont(d20, 0.75) AS c, corr(d20, vol) AS dispersion_vol_corr FROM q)
 SELECT CASE WHEN d20 <= c.a THEN 1 WHEN d20 <= c.b THEN 2 WHEN d20 <= c.c THEN 3 ELSE 4 END AS quartile, count(*) AS n, round(avg(d5), 6) AS dispersion_5, round(avg(d20), 6) AS dispersion_20, round(avg(vol), 6) AS volatility, round(any_value(dispersion_vol_corr), 6) AS dispersion_vol_corr FROM q, c GROUP BY 1""")
def x21(spark, sf):
    d = with_stage_columns(panel(spark, sf)).select("dt", "r", *[(ratio("close", R.lag("close", n)) - 1).alias(f"r{n}") for n in (5, 20)])
    g = d.groupBy("dt").agg(F.stddev_samp("r5").alias("d5"), F.stddev_samp("r20").alias("d20"), F.avg("r").alias("mkt")).withColumn("series", F.lit("m"))
    g = g.withColumn("vol", R.r_std("mkt", 20, by="series")).where("d20 is not null and vol is not null")
    cut = g.agg(*[F.percentile("d20", p).alias(f"c{i}") for i, p in enumerate((0.25, 0.5, 0.75))], corr("d20", "vol").alias("dispersion_vol_corr"))
    d20 = F.col("d20")
    q = F.when(d20 <= F.col("c0"), 1).when(d20 <= F.col("c1"), 2).when(d20 <= F.col("c2"), 3).otherwise(4)
    g = g.join(F.broadcast(cut))  # one row of cut points
    return rounded(g.groupBy(q.alias("quartile")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("d5").alias("dispersion_5"), F.avg("d20").alias("dispersion_20"), F.avg("vol").alias("volatility"),
        F.first("dispersion_vol_corr").alias("dispersion_vol_corr")))


@query("x_22_pairwise_correlation", f"""WITH {STAGED}, y AS (SELECT year(dt) AS yr, symbol, dt, r FROM s WHERE r IS NOT NULL),
 c AS (SELECT a.yr, a.symbol, b.symbol, corr(a.r, b.r) AS c FROM y a JOIN y b ON a.dt = b.dt AND a.symbol < b.symbol GROUP BY ALL HAVING count(*) >= 2)
 SELECT yr, count(*) AS pairs, round(avg(c), 6) AS mean_corr, round(median(c), 6) AS median_corr FROM c GROUP BY yr""")
def x22(spark, sf):
    d = with_stage_columns(panel(spark, sf)).where("r is not null").withColumn("yr", F.year("dt"))
    return rounded(X.mean_pairwise(d, "yr"))
