"""S-01..S-25: sources, side tables, contracts, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import ratio
from ..functions.rolling import lag, running
from ..operators import panels as P
from ..operators.factors import factors_wide, to_long
from ..oracle.base import FACTS, PANEL, SUPPLIER_FACTS, SUPPLIER_PANEL, WINDOWS
from ..oracle.factors import SQL, STAGED
from ..sources import io
from ..sources import side_tables as T
from ..sources.panel import CARRIED, facts, panel, spine
from ..sources.tables import FOREIGN_POOL, daily_facts, pool_of, table
from .registry import query, rounded
from .side_queries import FX

# prices are one division of exact sums: the same double in both engines, so they are compared as they are
OHLC = "open, high, low, close"


@query("s_01_scan_bars", f"WITH {FACTS} SELECT symbol, dt, {OHLC}, round(volume, 2) AS volume, round(amount, 2) AS amount FROM facts")
def s01(spark, sf):
    d = facts(spark, sf).select("symbol", "dt", "open", "high", "low", "close", F.round("volume", 2).alias("volume"), F.round("amount", 2).alias("amount"))
    return d


@query("s_01_scan_bars_supplier", f"WITH {SUPPLIER_FACTS} SELECT symbol, dt, {OHLC}, round(volume, 2) AS volume, round(amount, 2) AS amount FROM facts")
def s01b(spark, sf):
    d = facts(spark, sf, "supplier", side=False).select("symbol", "dt", "open", "high", "low", "close", F.round("volume", 2).alias("volume"), F.round("amount", 2).alias("amount"))
    return d


@query("s_02_column_mapping", f"WITH {FACTS} SELECT symbol, dt, {OHLC}, round(volume, 2) AS volume FROM facts")
def s02(spark, sf):
    odd = F.dayofyear("dt") % 2 == 1
    raw = facts(spark, sf).select(
        F.concat("symbol", F.lit(".SH")).alias("ts_code"), "dt",
        *[F.col(c).alias(f"adj_{c}") for c in ("open", "high", "low", "close")],
        F.when(odd, F.col("volume")).alias("vol"), F.when(~odd, F.col("volume")).alias("volume"),
    )
    return P.map_columns(raw)


@query("s_03_shares_outstanding", f"WITH {PANEL} SELECT symbol, dt, last_value(CASE WHEN traded THEN fd_share END IGNORE NULLS) OVER u AS fd_share FROM panel {WINDOWS}")
def s03(spark, sf):
    return T.load_shares(spark, sf)


@query("s_04_margin", f"""WITH {PANEL}, m AS (SELECT symbol, CAST(date_trunc('week', day) AS DATE) AS dt, arg_max(rzye, day) AS v FROM daily GROUP BY ALL)
 SELECT p.symbol, p.dt, round(last_value(v IGNORE NULLS) OVER (PARTITION BY p.symbol ORDER BY p.dt), 4) AS rzye FROM panel p LEFT JOIN m ON p.symbol = m.symbol AND p.dt = m.dt""")
def s04(spark, sf):
    return rounded(T.load_margin(spark, sf, "rzye"), 4)


@query("s_05_nav_by_announcement", f"""WITH {PANEL}, n AS (SELECT symbol, dt + 7 AS ann, nav_value / volume AS v FROM facts)
 SELECT p.symbol, p.dt, round(n.v, 6) AS unit_nav FROM panel p ASOF LEFT JOIN n ON p.symbol = n.symbol AND p.dt >= n.ann""")
def s05(spark, sf):
    return rounded(T.load_nav(spark, sf))


@query("s_06_fx", f"WITH {PANEL}{FX} SELECT dt, round(usd, 6) AS usd, round(hkd, 6) AS hkd FROM fx")
def s06(spark, sf):
    return rounded(T.load_fx(spark, sf))


@query("s_07_normalise_dates", "SELECT CAST(o_orderdate AS DATE) AS dt, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def s07(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    k = F.col("o_orderkey") % 3
    compact = F.date_format("o_orderdate", "yyyyMMdd")
    raw = F.when(k == 0, compact.cast("bigint").cast("string")).when(k == 1, compact).otherwise(F.col("o_orderdate").cast("string"))
    d = o.select(T.normalise_date(raw).alias("dt"), "o_totalprice")
    return d.groupBy("dt").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s_08_calendar_spine", f"WITH {PANEL} SELECT s.symbol, s.dt, CAST(s.bar AS INT) AS bar, f.close FROM spine s LEFT JOIN facts f ON s.symbol = f.symbol AND s.dt = f.dt")
def s08(spark, sf):
    f = facts(spark, sf)
    return spine(f).join(f.select("symbol", "dt", "close"), ["symbol", "dt"], "left").select("symbol", "dt", "bar", "close")


@query("s_09_forward_fill", f"WITH {PANEL} SELECT symbol, dt, {OHLC}, round(volume, 2) AS volume, round(amount, 2) AS amount FROM panel")
def s09(spark, sf):
    return panel(spark, sf).select("symbol", "dt", *CARRIED[:4], F.round("volume", 2).alias("volume"), F.round("amount", 2).alias("amount"))


@query("s_09_forward_fill_supplier", f"WITH {SUPPLIER_PANEL} SELECT symbol, dt, close, traded FROM panel")
def s09b(spark, sf):
    return panel(spark, sf, "supplier", side=False).select("symbol", "dt", "close", "traded")


_DAYS = f"d AS (SELECT symbol, CAST(date_trunc('week', day) AS DATE) AS dt, day, amount / volume AS price, volume FROM daily)"


@query("s_10_upsert_newest", f"WITH {FACTS}, {_DAYS} SELECT symbol, dt, max(day) AS day, arg_max(price, day) AS price, arg_max(volume, day) AS volume FROM d GROUP BY symbol, dt")
def s10(spark, sf):
    d = daily_facts(spark, sf, "brand").select(
        "symbol", F.to_date(F.date_trunc("week", "day")).alias("dt"), "day", (F.col("amount") / F.col("volume")).alias("price"), "volume"
    )
    early = F.dayofweek("day").between(2, 4)
    return T.upsert(d.where(early), d.where(~early), ["symbol", "dt"], "day")


@query("s_10_upsert_counts", f"WITH {FACTS}, {_DAYS}, g AS (SELECT symbol, dt, count(*) FILTER (isodow(day) BETWEEN 1 AND 3) AS early, count(*) FILTER (isodow(day) NOT BETWEEN 1 AND 3) AS late FROM d GROUP BY symbol, dt) SELECT symbol, CAST(sum(CAST(early = 0 AS INT)) AS BIGINT) AS new_rows, CAST(sum(CAST(early > 0 AND late > 0 AS INT)) AS BIGINT) AS replaced, CAST(sum(CAST(late = 0 AS INT)) AS BIGINT) AS kept FROM g GROUP BY symbol")
def s10n(spark, sf):
    """How many keys an upsert of the later days adds, replaces and leaves, for each symbol."""
    d = daily_facts(spark, sf, "brand").select("symbol", F.to_date(F.date_trunc("week", "day")).alias("dt"), F.dayofweek("day").between(2, 4).alias("early"))
    g = d.groupBy("symbol", "dt").agg(F.max("early").alias("before"), F.max(~F.col("early")).alias("after"))
    return g.groupBy("symbol").agg(F.count_if(~F.col("before")).alias("new_rows"), F.count_if(F.col("before") & F.col("after")).alias("replaced"), F.count_if(~F.col("after")).alias("kept"))


@query("s_11_incremental_range", f"""WITH {FACTS}, w AS (SELECT symbol, max(dt) AS watermark FROM facts WHERE weekofyear(dt) <= 26 GROUP BY symbol)
 SELECT f.symbol, w.watermark, count(*) AS new_rows, min(f.dt) AS first_new FROM facts f JOIN w ON f.symbol = w.symbol AND f.dt > w.watermark GROUP BY ALL""")
def s11(spark, sf):
    f = facts(spark, sf)
    mark = T.latest_dates(f.where(F.weekofyear("dt") <= 26))
    return T.newer_than(f, mark).groupBy("symbol", "watermark").agg(F.count(F.lit(1)).alias("new_rows"), F.min("dt").alias("first_new"))


_NR = " UNION ALL ".join(
    f"SELECT '{c}' AS field, (SELECT count(DISTINCT dt) FROM t) AS n_dates, (SELECT 1 - count({c}) / count(*) FROM t) AS null_ratio" for c in CARRIED
)


@query("s_12_data_contract", f"WITH {PANEL}, t AS (SELECT s.dt, f.* EXCLUDE (dt) FROM spine s LEFT JOIN facts f ON s.symbol = f.symbol AND s.dt = f.dt) SELECT field, n_dates, round(null_ratio, 6) AS null_ratio, null_ratio <= 0.2 AND n_dates >= 100 AS ok FROM ({_NR})")
def s12(spark, sf):
    f = facts(spark, sf)
    return rounded(P.contract(spine(f).join(f, ["symbol", "dt"], "left"), list(CARRIED)))


@query("s_12_factor_contract", f"""WITH {STAGED}, f AS (SELECT dt, {SQL['MOM_20D']} AS MOM_20D, {SQL['TSMOM_120D']} AS TSMOM_120D, {SQL['VOL_RATIO_60D']} AS VOL_RATIO_60D FROM s {WINDOWS}),
 u AS ({' UNION ALL '.join(f"SELECT '{c}' AS field, count(DISTINCT dt) AS n_dates, 1 - count({c}) / count(*) AS nr FROM f" for c in ('MOM_20D', 'TSMOM_120D', 'VOL_RATIO_60D'))})
 SELECT field, n_dates, round(nr, 6) AS null_ratio, nr <= 0.3 AND n_dates >= 100 AS ok FROM u""")
def s12b(spark, sf):
    names = ["MOM_20D", "TSMOM_120D", "VOL_RATIO_60D"]
    return rounded(P.contract(factors_wide(panel(spark, sf), names), names, P.MAX_FACTOR_NULL_RATIO))


@query("s_13_quality_summary", f"""WITH {PANEL} SELECT s.symbol, round(1 - count(f.close) / count(*), 6) AS missing_ratio, round(count(f.close) / count(*), 6) AS coverage, min(f.dt) AS first_dt, max(f.dt) AS last_dt
 FROM spine s LEFT JOIN facts f ON s.symbol = f.symbol AND s.dt = f.dt GROUP BY s.symbol""")
def s13(spark, sf):
    f = facts(spark, sf)
    return rounded(P.coverage_summary(spine(f).join(f.select("symbol", "dt", "close"), ["symbol", "dt"], "left")))


@query("s_14_integrity", """SELECT 'S' || s_suppkey AS symbol, count(l_suppkey) AS records, CAST(coalesce(sum(CAST(l_suppkey IS NOT NULL AND l_shipdate IS NULL AS INT) + CAST(l_suppkey IS NOT NULL AND l_quantity IS NULL AS INT)), 0) AS BIGINT) AS nulls,
 count(l_suppkey) > 0 AND sum(CAST(l_suppkey IS NOT NULL AND (l_shipdate IS NULL OR l_quantity IS NULL) AS INT)) = 0 AS ok FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey""")
def s14(spark, sf):
    expected = table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"))
    li = table(spark, sf, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), "l_shipdate", "l_quantity")
    return P.integrity(expected, li, ["l_shipdate", "l_quantity"])


@query("s_15_multi_format_read", f"WITH {FACTS} SELECT fmt, count(*) AS n, round(sum(volume), 2) AS volume, min(dt) AS first_dt FROM facts, (VALUES ('parquet'), ('csv'), ('json')) v(fmt) GROUP BY fmt")
def s15(spark, sf):
    f = facts(spark, sf).select("symbol", "dt", "close", "volume")
    out = None
    for fmt in io.FORMATS:
        path = io.write_table(f, io.scratch_path(spark, f"bars-{fmt}"), fmt)
        d = io.read_table(spark, path, f.schema, fmt).withColumn("fmt", F.lit(fmt))
        out = d if out is None else out.unionByName(d)
    return out.groupBy("fmt").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("volume"), 2).alias("volume"), F.min("dt").alias("first_dt"))


@query("s_16_partitioned_sink", f"WITH {FACTS} SELECT year(dt) AS yr, count(*) AS n, round(sum(amount), 2) AS amount FROM facts GROUP BY 1")
def s16(spark, sf):
    d = facts(spark, sf).select("symbol", "dt", "amount", F.year("dt").alias("yr"))
    path = io.write_table(d, io.scratch_path(spark, "bars-by-year"), "parquet", partition_by=["yr"])
    return spark.read.parquet(path).groupBy("yr").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query("s_17_run_publication", f"WITH {FACTS} SELECT symbol, dt, close FROM facts")
def s17(spark, sf):
    root = io.scratch_path(spark, "runs")
    d = facts(spark, sf).select("symbol", "dt", "close")
    io.publish_run(d.withColumn("close", -F.col("close")), root, "run-1")
    io.publish_run(d, root, "run-2")
    return io.read_latest_run(spark, root)


_LONG3 = f"""f AS (SELECT symbol, dt, {SQL['MOM_20D']} AS MOM_20D, {SQL['RET_VOL_20D']} AS RET_VOL_20D, {SQL['TSMOM_120D']} AS TSMOM_120D FROM s {WINDOWS}),
 l AS (UNPIVOT f ON MOM_20D, RET_VOL_20D, TSMOM_120D INTO NAME factor VALUE value)"""


@query("s_18_export_survivors", f"""WITH {STAGED}, {_LONG3}, k AS (SELECT factor FROM l GROUP BY factor HAVING count(*) >= 0.8 * (SELECT count(*) FROM panel))
 SELECT dt, symbol, factor AS factor_name, round(value, 6) AS value FROM l WHERE factor IN (SELECT factor FROM k)""")
def s18(spark, sf):
    names = ["MOM_20D", "RET_VOL_20D", "TSMOM_120D"]
    wide = factors_wide(panel(spark, sf), names)
    n = F.count(F.lit(1))
    passed = wide.agg(*[(F.count(c) / n >= 0.8).alias(c) for c in names]).unpivot([], names, "factor", "ok").where("ok").select("factor")
    d = to_long(wide, names).join(passed, "factor", "left_semi")
    return rounded(d.select("dt", "symbol", F.col("factor").alias("factor_name"), "value"))


@query("s_19_pool_mapping", """SELECT p_brand || '.SH' AS ts_code, p_brand AS symbol, count(*) AS parts, CASE WHEN CAST(substr(p_brand, 7) AS INT) <= 20 THEN CAST(substr(p_brand, 7) AS INT) % 5 ELSE -1 END AS pool FROM part GROUP BY ALL""")
def s19(spark, sf):
    part = table(spark, sf, "part").groupBy(F.concat("p_brand", F.lit(".SH")).alias("ts_code")).agg(F.count(F.lit(1)).alias("parts"))
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    pools = table(spark, sf, "part").select(F.col("p_brand").alias("symbol"), number.alias("n")).distinct().where("n <= 20").select("symbol", (F.col("n") % 5).alias("pool"))
    return P.with_pool(part, pools).select("ts_code", "symbol", "parts", "pool")


@query("s_20_universe_filter", f"WITH {PANEL} SELECT symbol, dt, close FROM panel WHERE pool <> 4")
def s20(spark, sf):
    p = panel(spark, sf)
    foreign = p.where(F.col("pool") == FOREIGN_POOL).select("symbol").distinct()
    return P.domestic_only(p.select("symbol", "dt", "close"), foreign)


@query("s_20_universe_mask", f"WITH {STAGED} SELECT symbol, dt, round(CASE WHEN pool <> 4 THEN {SQL['MOM_20D']} END, 6) AS value FROM s {WINDOWS}")
def s20b(spark, sf):
    d = factors_wide(panel(spark, sf), ["MOM_20D"])
    return rounded(d.select("symbol", "dt", F.when(F.col("pool") != FOREIGN_POOL, F.col("MOM_20D")).alias("value")))


@query("s_21_coverage_filter", f"""WITH {FACTS}, k AS (SELECT symbol FROM facts GROUP BY symbol HAVING min(dt) <= DATE '1995-01-09' AND max(dt) >= DATE '2001-10-22')
 SELECT symbol, dt, close FROM facts WHERE symbol IN (SELECT symbol FROM k)""")
def s21(spark, sf):
    d = facts(spark, sf).select("symbol", "dt", "close")
    return P.spans(d, F.to_date(F.lit("1995-01-09")), F.to_date(F.lit("2001-10-22")))


@query("s_22_extra_factors", f"""WITH {STAGED}, {_LONG3}, b AS (SELECT * FROM l WHERE factor <> 'TSMOM_120D'), e AS (SELECT * REPLACE (dt + CASE WHEN symbol = 'Brand#1' THEN 1 ELSE 0 END AS dt) FROM l WHERE factor <> 'RET_VOL_20D')
 SELECT dt, symbol, factor, round(value, 6) AS value FROM b UNION ALL SELECT e.dt, e.symbol, factor, round(value, 6) FROM e JOIN spine s ON e.dt = s.dt AND e.symbol = s.symbol WHERE factor NOT IN (SELECT factor FROM b)""")
def s22(spark, sf):
    names = ["MOM_20D", "RET_VOL_20D", "TSMOM_120D"]
    p = panel(spark, sf)
    long = to_long(factors_wide(p, names), names)
    base = long.where("factor <> 'TSMOM_120D'")
    # one symbol's extra values sit on dates the calendar does not know: they must fall away
    moved = F.when(F.col("symbol") == "Brand#1", F.date_add("dt", 1)).otherwise(F.col("dt"))
    extra = long.where("factor <> 'RET_VOL_20D'").withColumn("dt", moved)
    return rounded(P.add_factors(base, extra, p).select("dt", "symbol", "factor", "value"))


@query("s_23_master_filter", """SELECT r_name AS exchange, n_name AS category, CASE WHEN s_acctbal >= 5000 THEN 'high' ELSE 'normal' END AS priority, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 0 GROUP BY ALL""")
def s23(spark, sf):
    s = table(spark, sf, "supplier").where("s_acctbal > 0")
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    d = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    priority = F.when(F.col("s_acctbal") >= 5000, "high").otherwise("normal")
    return d.groupBy(F.col("r_name").alias("exchange"), F.col("n_name").alias("category"), priority.alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("s_24_premium_rate", f"WITH {FACTS} SELECT symbol, dt, round((close / (nav_value / volume) - 1) * 100, 6) AS premium_rate FROM facts WHERE nav_value / volume <> 0")
def s24(spark, sf):
    f = facts(spark, sf)
    nav = T.nav_table(spark, sf).select("symbol", "dt", "unit_nav")
    d = f.select("symbol", "dt", "close").join(nav, ["symbol", "dt"])
    return rounded(d.select("symbol", "dt", ((ratio("close", "unit_nav") - 1) * 100).alias("premium_rate")).where("premium_rate is not null"))


@query("s_25_config_drift", f"""WITH li AS (SELECT p_brand, l_linestatus, l_discount, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
 a AS (SELECT 'discount.' || p_brand AS path, round(avg(l_discount), 4) AS value FROM li WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT 'discount.' || p_brand AS path, round(avg(l_discount), 4) AS value FROM li WHERE l_linestatus = 'O' GROUP BY 1)
 SELECT coalesce(a.path, b.path) AS path, a.value AS frozen, b.value AS actual, CASE WHEN b.value IS NULL THEN 'missing' WHEN a.value IS NULL THEN 'unexpected' ELSE 'changed' END AS violation
 FROM a FULL JOIN b ON a.path = b.path WHERE a.value IS NULL OR b.value IS NULL OR abs(a.value - b.value) > 0.0005""")
def s25(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    li = table(spark, sf, "lineitem").select("l_partkey", "l_linestatus", "l_discount").join(part, F.col("l_partkey") == F.col("p_partkey"))
    avg = lambda s: li.where(F.col("l_linestatus") == s).groupBy(F.concat(F.lit("discount."), F.col("p_brand")).alias("path")).agg(F.round(F.avg("l_discount"), 4).alias("value"))
    return P.drift(avg("F"), avg("O"), 0.0005)
