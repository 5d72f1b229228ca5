"""J-01..J-16 joins, set operations, sorts; E-01..E-11 scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as E
from ..functions.ranking import ordinal_rank, ranked
from ..functions.rolling import lag, r_mean, r_std
from ..operators import panels as P
from ..operators.factors import to_long
from ..oracle.base import FACTS, PANEL, SUPPLIER_FACTS, WINDOWS, mean, std
from ..oracle.factors import STAGED
from ..oracle.research import NAMES, RAW, WIDE
from ..oracle.research import LONG
from ..sources import side_tables as ST
from ..sources.panel import facts, panel, spine
from ..sources.stages import stage
from ..sources.tables import table
from .registry import query, rounded
from .research import raw_long, raw_wide, std_long
from .side_queries import FX

# ---------------------------------------------------------------- stage outputs keyed by combo

RUNS_SQL = """li AS (SELECT p_brand || ' + ' || p_type AS combo, l_shipdate, l_quantity, l_discount, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey),
 wfo AS (SELECT combo, round(sum(l_quantity), 2) AS score, count(*) AS n FROM li WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY combo HAVING count(*) >= 5),
 vec AS (SELECT combo, round(sum(l_quantity), 2) AS vec_score, round(avg(l_discount), 6) AS vec_cost FROM li WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY combo HAVING count(*) >= 5),
 bt AS (SELECT combo, round(sum(l_quantity), 2) AS bt_score FROM li WHERE l_returnflag = 'R' GROUP BY combo HAVING count(*) >= 3)"""


def runs(spark, sf):
    """Three stage outputs (search, validation, audit) over combos of brand and type."""
    part = table(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.lit(" + "), "p_type").alias("combo"))
    li = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_discount", "l_returnflag").join(part, F.col("l_partkey") == F.col("p_partkey"))
    cut = F.to_timestamp(F.lit("1998-06-01"))
    n = F.count(F.lit(1))
    early, late, back = F.col("l_shipdate") < cut, F.col("l_shipdate") >= cut, F.col("l_returnflag") == "R"
    q = lambda c: F.round(F.sum(F.when(c, F.col("l_quantity"))), 2)
    k = lambda c: F.count(F.when(c, 1))

    def build():
        return li.groupBy("combo").agg(
            q(early).alias("score"), k(early).alias("n"), q(late).alias("vec_score"), F.round(F.avg(F.when(late, F.col("l_discount"))), 6).alias("vec_cost"),
            k(late).alias("n_late"), q(back).alias("bt_score"), k(back).alias("n_back"),
        )

    all_ = stage(spark, sf, "runs", build)
    return (
        all_.where("n >= 5").select("combo", "score", "n"),
        all_.where("n_late >= 5").select("combo", "vec_score", "vec_cost"),
        all_.where("n_back >= 3").select("combo", "bt_score"),
    )


@query("j_01_three_way_join", f"WITH {RUNS_SQL} SELECT combo, score, n, vec_score, vec_cost, bt_score FROM wfo JOIN vec USING (combo) JOIN bt USING (combo)")
def j01(spark, sf):
    wfo, vec, bt = runs(spark, sf)
    return wfo.join(vec, "combo").join(bt, "combo")


@query("j_02_left_join_drop_missing", f"WITH {RUNS_SQL} SELECT combo, score, n, bt_score FROM wfo LEFT JOIN bt USING (combo) WHERE bt_score IS NOT NULL AND score IS NOT NULL")
def j02(spark, sf):
    wfo, _, bt = runs(spark, sf)
    return wfo.join(bt, "combo", "left").dropna(subset=["score", "bt_score"])


@query("j_03_asof_join", f"""WITH {PANEL}, n AS (SELECT symbol, dt + 7 AS ann, nav_value / volume AS v, volume AS nv FROM facts) SELECT f.symbol, f.dt, f.close, round(n.v, 6) AS unit_nav, n.nv AS nav_volume FROM facts f ASOF LEFT JOIN n ON f.symbol = n.symbol AND f.dt >= n.ann""")
def j03(spark, sf):
    f = facts(spark, sf)
    nav = f.select("symbol", F.date_add("dt", 7).alias("ann_dt"), (F.col("nav_value") / F.col("volume")).alias("unit_nav"), F.col("volume").alias("nav_volume"))
    d = ST.asof_join(f.select("symbol", "dt", "close"), nav, ["symbol"], "dt", "ann_dt", ["unit_nav", "nav_volume"])
    return d.withColumn("unit_nav", F.round("unit_nav", 6))


@query("j_04_broadcast_series", f"WITH {PANEL}{FX} SELECT p.symbol, p.dt, round(close * usd, 3) AS close_usd FROM panel p JOIN fx ON p.dt = fx.dt WHERE close IS NOT NULL")
def j04(spark, sf):
    fx = ST.load_fx(spark, sf).select("dt", "usd")
    return rounded(panel(spark, sf).where("close is not null").join(fx, "dt").select("symbol", "dt", (F.col("close") * F.col("usd")).alias("close_usd")), 3)


@query("j_05_panel_intersection", f"WITH {FACTS}, a AS (SELECT symbol, dt, close FROM facts WHERE rqyl > 0), b AS (SELECT symbol, dt, rqchl FROM facts WHERE rqchl > 0) SELECT symbol, dt, close, rqchl FROM a JOIN b USING (symbol, dt)")
def j05(spark, sf):
    f = facts(spark, sf)
    return f.where("rqyl > 0").select("symbol", "dt", "close").join(f.where("rqchl > 0").select("symbol", "dt", "rqchl"), ["symbol", "dt"])


_OPS = "(VALUES ('add'), ('sub'), ('mul'), ('div'), ('max'), ('min')) o(op)"


@query("j_06_factor_pairs_by_operation", f"WITH {RAW}, n AS (SELECT factor, count(*) AS rows_ FROM rl GROUP BY factor) SELECT a.factor || '__' || op || '__' || b.factor AS name, a.factor AS left_factor, b.factor AS right_factor, op, least(a.rows_, b.rows_) AS rows_bound FROM n a JOIN n b ON a.factor < b.factor, {_OPS}")
def j06(spark, sf):
    # one row per factor name: the catalog bounds this theta join, the panel does not enter it
    n = raw_long(spark, sf).groupBy("factor").agg(F.count(F.lit(1)).alias("n"))
    a, b = n.select(F.col("factor").alias("left_factor"), F.col("n").alias("na")), n.select(F.col("factor").alias("right_factor"), F.col("n").alias("nb"))
    d = a.join(b, F.col("left_factor") < F.col("right_factor")).withColumn("op", F.explode(F.array(*[F.lit(o) for o in E.ALGEBRA])))
    return d.select(F.concat_ws("__", "left_factor", "op", "right_factor").alias("name"), "left_factor", "right_factor", "op", F.least("na", "nb").alias("rows_bound"))


HOLD = 4


@query("j_07_holding_intervals", f"""WITH {STAGED}, r AS (SELECT bar AS start_bar, dt AS start_dt FROM cal WHERE bar % {HOLD} = 0 AND bar > 0)
 SELECT s.symbol, r.start_dt, count(s.r) AS bars, round(exp(sum(ln(1 + s.r))) - 1, 6) AS period_return FROM r JOIN s ON s.bar >= r.start_bar AND s.bar < r.start_bar + {HOLD} WHERE s.r IS NOT NULL GROUP BY ALL""")
def j07(spark, sf):
    from ..operators.factors import with_stage_columns

    d = with_stage_columns(panel(spark, sf)).select("symbol", "dt", "bar", "r").where("r is not null")
    d = d.withColumn("period", F.floor(F.col("bar") / HOLD)).where("period > 0")  # the interval as an equi key
    start = panel(spark, sf).where((F.col("bar") % HOLD == 0)).select((F.col("bar") / HOLD).cast("bigint").alias("period"), F.col("dt").alias("start_dt")).distinct()
    g = d.groupBy("symbol", "period").agg(F.count("r").alias("bars"), E.compound("r").alias("period_return"))
    return rounded(g.join(start, "period").select("symbol", "start_dt", "bars", "period_return"))


IS_LEN, OOS_LEN, STEP = 100, 30, 30


@query("j_08_windows_by_bar", f"""WITH {STAGED}, w AS (SELECT k AS win, k * {STEP} AS a FROM range(0, 100) g(k) WHERE k * {STEP} + {IS_LEN + OOS_LEN} <= (SELECT max(bar) + 1 FROM cal))
 SELECT win, CASE WHEN s.bar < a + {IS_LEN} THEN 'is' ELSE 'oos' END AS part, symbol, count(r) AS n, round(avg(r), 6) AS mean_r FROM w JOIN s ON s.bar >= a AND s.bar < a + {IS_LEN + OOS_LEN} GROUP BY ALL""")
def j08(spark, sf):
    from ..operators.factors import with_stage_columns
    from ..operators.walkforward import explode_windows

    d = explode_windows(with_stage_columns(panel(spark, sf)).select("symbol", "bar", "r"), IS_LEN, OOS_LEN, STEP)
    return rounded(d.groupBy("win", "part", "symbol").agg(F.count("r").alias("n"), F.avg("r").alias("mean_r")))


@query("j_09_exclusions", f"WITH {RUNS_SQL} SELECT combo, score FROM wfo WHERE combo NOT LIKE '%PROMO%' AND NOT (combo LIKE 'Brand#7 +%' AND combo LIKE '%SMALL') AND combo IN (SELECT combo FROM vec)")
def j09(spark, sf):
    wfo, vec, _ = runs(spark, sf)
    d = P.excludes(wfo, ["PROMO"], [("Brand#7", "SMALL")])
    return d.join(vec, "combo", "left_semi").select("combo", "score")


@query("j_10_overlap", f"WITH {RUNS_SQL} SELECT CAST(sum(CAST(a AND b AS INT)) AS BIGINT) AS both, CAST(sum(CAST(a AND NOT b AS INT)) AS BIGINT) AS only_a, CAST(sum(CAST(b AND NOT a AS INT)) AS BIGINT) AS only_b, round(sum(CAST(a AND b AS INT)) / count(*), 6) AS overlap_ratio FROM (SELECT wfo.combo IS NOT NULL AS a, bt.combo IS NOT NULL AS b FROM wfo FULL JOIN bt ON wfo.combo = bt.combo)")
def j10(spark, sf):
    wfo, _, bt = runs(spark, sf)
    return rounded(P.overlap(wfo, bt, "combo"))


@query("j_11_run_comparison", f"""WITH {RUNS_SQL}, m AS (SELECT combo, score, vec_score FROM wfo FULL JOIN vec USING (combo)), r AS (SELECT *, CASE WHEN score IS NOT NULL THEN rank() OVER (ORDER BY score DESC NULLS LAST) END AS ra, CASE WHEN vec_score IS NOT NULL THEN rank() OVER (ORDER BY vec_score DESC NULLS LAST) END AS rb FROM m)
 SELECT combo, score AS score__sealed, vec_score AS score__new, round(vec_score - score, 6) AS delta, ra AS rank__sealed, rb AS rank__new, rb - ra AS rank_change FROM r""")
def j11(spark, sf):
    wfo, vec, _ = runs(spark, sf)
    a = best_first(wfo.select("combo", F.col("score").alias("score__sealed")), "score__sealed", "rank__sealed")
    b = best_first(vec.select("combo", F.col("vec_score").alias("score__new")), "score__new", "rank__new")
    d = a.join(b, "combo", "full")
    return d.select("combo", "score__sealed", "score__new", F.round(F.col("score__new") - F.col("score__sealed"), 6).alias("delta"), "rank__sealed", "rank__new",
                    (F.col("rank__new") - F.col("rank__sealed")).alias("rank_change"))


def best_first(d, value, out):
    """Rank 1 is best; ties share the smallest rank."""
    ord_ = ranked(d, value, "__o", tie="combo", descending=True)
    first = ord_.groupBy(value).agg(F.min("__o").cast("bigint").alias(out))
    return ord_.drop("__o").join(first, value)


@query("j_12_concatenate", f"WITH {RUNS_SQL} SELECT combo, score, n, CAST(NULL AS DOUBLE) AS bt_score FROM wfo UNION ALL SELECT combo, NULL, NULL, bt_score FROM bt")
def j12(spark, sf):
    wfo, _, bt = runs(spark, sf)
    return wfo.unionByName(bt, allowMissingColumns=True)


@query("j_13_sort_head", f"WITH {RUNS_SQL} SELECT combo, score, n FROM wfo ORDER BY score DESC, n DESC, combo LIMIT 25")
def j13(spark, sf):
    return runs(spark, sf)[0].orderBy(F.desc("score"), F.desc("n"), "combo").limit(25)


@query("j_14_topk_per_date", f"WITH {STAGED}, m AS (SELECT symbol, dt, round(close / lag(close, 20) OVER w - 1, 6) AS score FROM s WINDOW w AS (PARTITION BY symbol ORDER BY dt)) SELECT symbol, dt, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY score DESC, symbol) AS pos FROM m WHERE score IS NOT NULL) WHERE pos <= 5")
def j14(spark, sf):
    d = panel(spark, sf).select("symbol", "dt", F.round(E.ratio("close", lag("close", 20)) - 1, 6).alias("score")).where("score is not null")
    return d.withColumn("pos", ordinal_rank("score", "dt", descending=True)).where("pos <= 5")


@query("j_14_topk_per_date_supplier", f"WITH {SUPPLIER_FACTS} SELECT symbol, dt, volume, pos FROM (SELECT symbol, dt, volume, row_number() OVER (PARTITION BY dt ORDER BY volume DESC, symbol) AS pos FROM facts) WHERE pos <= 10")
def j14s(spark, sf):
    """Over an unbounded universe: each task keeps its own best k of every date before the final ranking."""
    from ..operators.selection import topk_two_step

    return topk_two_step(facts(spark, sf, "supplier", side=False).select("symbol", "dt", "volume"), ["dt"], "volume", 10, "pos")


@query("j_15_distinct", "SELECT DISTINCT p_brand AS symbol, p_type AS kind, p_size AS size FROM part")
def j15(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("kind"), F.col("p_size").alias("size")).distinct()


_YRS = list(range(1995, 2002))


@query("j_16_pivot_unpivot", f"WITH {FACTS}, p AS (SELECT symbol, " + ", ".join(f"sum(volume) FILTER (year(dt) = {y}) AS y{y}" for y in _YRS) + " FROM facts GROUP BY symbol) SELECT * FROM p")
def j16(spark, sf):
    w = facts(spark, sf).select("symbol", F.concat(F.lit("y"), F.year("dt")).alias("yr"), "volume")
    wide = w.groupBy("symbol").pivot("yr", [f"y{y}" for y in _YRS]).agg(F.sum("volume"))
    back = wide.unpivot(["symbol"], [f"y{y}" for y in _YRS], "yr", "volume")
    return back.groupBy("symbol").pivot("yr", [f"y{y}" for y in _YRS]).agg(F.sum("volume"))


@query("j_16_pivot_unpivot_all_years", f"WITH {FACTS} SELECT symbol, 'y' || year(dt) AS yr, sum(volume) AS volume FROM facts GROUP BY ALL HAVING sum(volume) IS NOT NULL")
def j16a(spark, sf):
    """The same with the years that the data have."""
    w = facts(spark, sf).select("symbol", F.concat(F.lit("y"), F.year("dt")).alias("yr"), "volume")
    years = sorted(r["yr"] for r in w.select("yr").distinct().collect())  # bounded by the calendar
    wide = w.groupBy("symbol").pivot("yr", years).agg(F.sum("volume"))
    return wide.unpivot(["symbol"], years, "yr", "volume").where("volume IS NOT NULL")


# ---------------------------------------------------------------- E


def _side(spark, sf):
    from .side_queries import side

    return side(spark, sf)


@query("e_01_guarded_division", f"WITH {FACTS} SELECT symbol, dt, round(CASE WHEN rqmcl >= 1e-10 THEN rqchl / (rqmcl + 1e-10) END, 6) AS guarded, round(CASE WHEN abs(net_qty) > 1e-10 THEN volume / (abs(net_qty) + 1e-10) END, 6) AS signed_base, round(CASE WHEN rqyl <> 0 THEN rqchl / rqyl END, 6) AS plain FROM facts")
def e01(spark, sf):
    return rounded(facts(spark, sf).select("symbol", "dt", E.safe_div("rqchl", "rqmcl").alias("guarded"), E.safe_div_signed("volume", "net_qty").alias("signed_base"), E.ratio("rqchl", "rqyl").alias("plain")))


@query("e_02_clip_and_mask", f"WITH {STAGED} SELECT symbol, dt, round(CASE WHEN r IS NOT NULL THEN greatest(-0.1, least(0.1, r)) END, 6) AS clipped, round(CASE WHEN r > 0 THEN r END, 6) AS masked, CAST(sign(r) AS DOUBLE) AS sgn, round(ln(close), 6) AS log_close, round(sqrt(volume), 6) AS root FROM s")
def e02(spark, sf):
    from ..operators.factors import with_stage_columns

    d = with_stage_columns(panel(spark, sf))
    return rounded(d.select("symbol", "dt", E.clip("r", -0.1, 0.1).alias("clipped"), F.when(F.col("r") > 0, F.col("r")).alias("masked"), F.signum("r").alias("sgn"), F.log("close").alias("log_close"), F.sqrt("volume").alias("root")))


@query("e_03_signed_transforms", f"WITH {FACTS} SELECT symbol, dt, round(sign(net_qty) * ln(1 + abs(net_qty)), 6) AS log1p, round(sign(net_qty) * sqrt(abs(net_qty)), 6) AS sqrt, CAST(sign(net_qty) AS DOUBLE) AS sign, abs(net_qty) AS abs FROM facts")
def e03(spark, sf):
    return rounded(facts(spark, sf).select("symbol", "dt", *[E.unary(t, "net_qty").alias(t) for t in E.TRANSFORMS]))


@query("e_04_binary_algebra", f"""WITH {WIDE}, t AS (SELECT symbol, dt, MOM_20D AS a, CMF_20D AS b FROM fw) SELECT symbol, dt, round(a + b, 6) AS "add", round(a - b, 6) AS "sub", round(a * b, 6) AS "mul", round(CASE WHEN b <> 0 THEN a / b END, 4) AS "div",
 round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END, 6) AS "max", round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END, 6) AS "min" FROM t""")
def e04(spark, sf):
    d = raw_wide(spark, sf)
    return d.select("symbol", "dt", *[F.round(E.binary(o, "MOM_20D", "CMF_20D"), 4 if o == "div" else 6).alias(o) for o in E.ALGEBRA])


@query("e_05_combo_strings", "WITH c AS (SELECT DISTINCT p_brand || ' + ' || p_type AS combo FROM part) SELECT combo, string_split(combo, ' + ')[1] AS head, 2 AS n_names, string_split(combo, ' + ')[2] || ' + ' || string_split(combo, ' + ')[1] AS rejoined, string_split(combo, ' + ')[1] || '__mul__' || string_split(combo, ' + ')[2] AS derived, string_split(combo, ' + ')[2] AS second_parent FROM c")
def e05(spark, sf):
    d = table(spark, sf, "part").select(F.concat("p_brand", F.lit(" + "), "p_type").alias("combo")).distinct()
    names = E.names_of("combo")
    d = d.select("combo", names[0].alias("head"), F.size(names).alias("n_names"), E.combo_of(F.reverse(names)).alias("rejoined"), F.array_join(F.array(names[0], F.lit("mul"), names[1]), "__").alias("derived"))
    return d.withColumn("second_parent", E.parents_of("derived")[1])


@query("e_06_threshold_ladder", f"WITH {STAGED} SELECT symbol, dt, CAST(CASE WHEN abs(r) >= 0.4 THEN 0.1 WHEN abs(r) >= 0.3 THEN 0.4 WHEN abs(r) >= 0.25 THEN 0.7 ELSE 1.0 END AS DOUBLE) AS exposure FROM s WHERE r IS NOT NULL")
def e06(spark, sf):
    from ..operators.factors import with_stage_columns

    d = with_stage_columns(panel(spark, sf)).where("r is not null")
    return d.select("symbol", "dt", E.ladder(F.abs("r"), [(0.25, 0.7), (0.30, 0.4), (0.40, 0.1)], 1.0).alias("exposure"))


@query("e_07_position_count", f"WITH {STAGED} SELECT symbol, dt, CASE WHEN least(abs(r), 1.2) <= 0.4 THEN 1 WHEN least(abs(r), 1.2) <= 0.7 THEN 2 ELSE 3 END AS positions FROM s WHERE r IS NOT NULL")
def e07(spark, sf):
    from ..operators.factors import with_stage_columns

    d = with_stage_columns(panel(spark, sf)).where("r is not null")
    return d.select("symbol", "dt", E.position_count(F.least(F.abs("r"), F.lit(1.2)), [(0.4, 1), (0.7, 2), (1.0, 3)]).alias("positions"))


@query("e_08_period_labels", f"WITH {FACTS}, c AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS bar FROM (SELECT DISTINCT dt FROM facts)) SELECT dt, CAST(date_trunc('month', dt) AS DATE) AS month, CAST(date_trunc('quarter', dt) AS DATE) AS quarter, CAST(date_trunc('year', dt) AS DATE) AS year, bar // 126 AS half_year FROM c")
def e08(spark, sf):
    d = panel(spark, sf).select("dt", "bar").distinct()
    t = lambda u: F.to_date(F.date_trunc(u, "dt"))
    return d.select("dt", t("month").alias("month"), t("quarter").alias("quarter"), t("year").alias("year"), F.floor(F.col("bar") / 126).alias("half_year"))


@query("e_09_round_lots", f"WITH {FACTS} SELECT symbol, dt, CAST(floor(floor(amount / close) / 100) * 100 AS BIGINT) AS shares FROM facts")
def e09(spark, sf):
    return facts(spark, sf).select("symbol", "dt", E.lots("amount", "close").cast("bigint").alias("shares"))


@query("e_10_nearest_bucket", f"WITH {STAGED} SELECT symbol, dt, arg_min(name, (round(abs(r - centre), 12), name)) AS bucket FROM s, (VALUES ('flat', 0.0), ('down', -0.1), ('up', 0.1)) b(name, centre) WHERE r IS NOT NULL GROUP BY ALL")
def e10(spark, sf):
    from ..operators.factors import with_stage_columns

    d = with_stage_columns(panel(spark, sf)).where("r is not null")
    return d.select("symbol", "dt", E.nearest("r", {"flat": 0.0, "down": -0.1, "up": 0.1}).alias("bucket"))


@query("e_11_significance_stars", "SELECT l_linenumber AS line, p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars, n FROM (SELECT l_linenumber, round(l_discount / 10, 4) AS p, count(*) AS n FROM lineitem GROUP BY ALL)")
def e11(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("line"), F.round(F.col("l_discount") / 10, 4).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return d.select("line", "p", E.stars("p").alias("stars"), "n")
