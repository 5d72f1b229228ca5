"""The research chain on the whole factor library, and combinations of the traded factors scored out of sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.selection import quantiles_of
from ..operators import enumeration as EN
from ..operators import mining as M
from ..operators import quality as Q
from ..operators import walkforward as WF
from ..operators.cross_section import standardise
from ..operators.factors import BAR_FACTORS, CATALOG, factors_wide, to_long
from ..operators.quality import rank_ic
from ..oracle.base import SUPPLIER_PANEL
from ..oracle.factors import SQL as FSQL
from ..oracle.research import SUMMARY_COLS, ic_cte, raw_factors, standardised, summary
from ..sources.panel import panel
from ..sources.stages import stage
from ..sources.tables import table
from .combo_queries import _CMP, _DEC, _RIC, _SIG, _WGT, IS_LEN, OOS_LEN, STEP, WIN, _grow, compounded, decisions, traded_buckets
from .mining_queries import BK_SQL
from .registry import query, rounded
from .research import IDS, with_forward

#: every bar factor whose expected result is one expression; ADX, drawdown duration and Hurst have statements of their own
ALL = tuple(n for n in BAR_FACTORS if n in FSQL)
INSIDE = tuple(n for n in ALL if CATALOG[n].bounded)
LONG_ALL = standardised(ALL, INSIDE)


def all_raw(spark, sf):
    return stage(spark, sf, "all_raw", lambda: with_forward(factors_wide(panel(spark, sf), list(BAR_FACTORS), keep=("r", "close"))))


def all_standard(spark, sf):
    """All 38 bar factors, standardised."""
    return stage(spark, sf, "all_standard", lambda: standardise(all_raw(spark, sf), BAR_FACTORS, [n for n in BAR_FACTORS if CATALOG[n].bounded]))


def all_long(spark, sf, names=ALL):
    return to_long(all_standard(spark, sf), list(names), IDS)


def all_ic(spark, sf):
    return stage(spark, sf, "all_ic", lambda: rank_ic(all_long(spark, sf), "fwd1", ("factor", "dt")))


IC_ALL = f"{LONG_ALL}, {ic_cte('ic', 'zl', 'fwd1')}"


@query("a_02_rank_ic_all", f"WITH {IC_ALL} SELECT factor, dt, round(ic, 6) AS ic, n FROM ic")
def a02w(spark, sf):
    return rounded(all_ic(spark, sf))


@query("a_05_ic_summary_all", f"WITH {IC_ALL} SELECT factor, {SUMMARY_COLS} FROM ({summary()})")
def a05w(spark, sf):
    return rounded(Q.summarise(all_ic(spark, sf)))


_EDGES = ", ".join(f"quantile_cont(value, {p}) AS q{i}" for i, p in enumerate((0.025, 0.5, 0.975)))


@query("x_02_bounds_all", f"WITH {raw_factors(ALL)} SELECT dt, factor, n, round(q0, 6) AS q0, round(q1, 6) AS q1, round(q2, 6) AS q2 FROM (SELECT dt, factor, count(*) AS n, {_EDGES} FROM rl GROUP BY dt, factor)")
def x02w(spark, sf):
    """Clipping bounds and median of every factor and date, by histogram selection."""
    d = to_long(all_raw(spark, sf), list(ALL), ("dt", "symbol"))
    return rounded(quantiles_of(d, "value", (0.025, 0.5, 0.975), ["dt", "factor"]))


@query("x_02_bounds_supplier", f"WITH {SUPPLIER_PANEL} SELECT dt, count(volume) AS n, round(quantile_cont(volume, 0.025), 4) AS q0, round(quantile_cont(volume, 0.975), 4) AS q1 FROM panel WHERE volume IS NOT NULL GROUP BY dt")
def x02s(spark, sf):
    return rounded(quantiles_of(panel(spark, sf, "supplier", side=False), "volume", (0.025, 0.975), ["dt"]), 4)


@query("x_04_quantiles_of_one_group", "SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 4) AS q0, round(quantile_cont(l_extendedprice, 0.5), 4) AS q1, round(quantile_cont(l_extendedprice, 0.999), 4) AS q2 FROM lineitem GROUP BY l_returnflag")
def x04q(spark, sf):
    """Three groups that hold all order lines."""
    return rounded(quantiles_of(table(spark, sf, "lineitem"), "l_extendedprice", (0.1, 0.5, 0.999), ["l_returnflag"]), 4)


# combinations of the traded factors, scored out of sample in blocks


def traded(spark, sf):
    return traded_buckets(spark, sf).where(F.col("factor").isin(*ALL))


def traded_combos(spark, sf):
    return stage(spark, sf, "traded_combos", lambda: EN.combinations(traded(spark, sf), [2, 3], 3, 2))


def traded_stats(spark, sf):
    names = F.broadcast(traded(spark, sf).select("factor"))  # a few names
    return stage(spark, sf, "traded_stats", lambda: WF.is_statistics(all_long(spark, sf).join(names, "factor", "left_semi"), IS_LEN, OOS_LEN, STEP))


_TN = f"""{BK_SQL}, tn AS MATERIALIZED (SELECT factor AS name, bucket, [factor] AS parents FROM bk WHERE factor IN ({', '.join(f"'{n}'" for n in ALL)}) AND bucket NOT IN ('FUND_FLOW', 'LEVERAGE') AND (SELECT max(bar) + 1 FROM cal) > CAST(coalesce(nullif(regexp_extract(factor, '(\\d+)', 1), ''), '1') AS INT)),
 {_grow('tn', 3, 2)}, cm AS MATERIALIZED (SELECT array_to_string(names, ' + ') AS combo, names, size FROM grow WHERE size >= 2 AND len(list_distinct(bks)) >= least(3, size))"""
_ISS = """od AS MATERIALIZED (SELECT factor, bar, round(corr(a, b), 12) AS ic FROM (SELECT factor, bar, row_number() OVER (PARTITION BY factor, bar ORDER BY value, symbol) AS a, row_number() OVER (PARTITION BY factor, bar ORDER BY r, symbol) AS b FROM zl WHERE r IS NOT NULL AND factor IN (SELECT name FROM tn)) GROUP BY factor, bar HAVING count(*) >= 3),
 iss AS MATERIALIZED (SELECT win, factor, avg(ic) AS ic FROM wn JOIN od ON bar >= is_start AND bar < is_end GROUP BY ALL)"""


@query("c_04_in_sample_statistics_traded", f"WITH RECURSIVE {LONG_ALL}, {_TN}, {WIN}, {_ISS} SELECT win, factor, round(ic, 6) AS ic FROM iss")
def c04w(spark, sf):
    return rounded(traded_stats(spark, sf))


@query("c_06_out_of_sample_ic_traded", f"WITH RECURSIVE {LONG_ALL}, {_TN}, {WIN}, {_ISS}, {_WGT}, {_DEC}, {_SIG}, {_CMP}, {_RIC} SELECT combo, win, freq, round(mean_ic, 6) AS mean_ic, round(ir, 6) AS ir, round(positive_rate, 6) AS positive_rate, n_periods FROM ri")
def c06w(spark, sf):
    """All combinations of two and three traded factors under bucket limits, on every window and frequency."""
    names = sorted(r["factor"] for r in traded(spark, sf).select("factor").collect())  # at most the library
    w = stage(spark, sf, "traded_weights", lambda: WF.combo_weights(traded_combos(spark, sf), traded_stats(spark, sf)))
    return rounded(WF.matrix_ic(traded_combos(spark, sf), w, all_long(spark, sf, names), decisions(spark, sf), compounded(spark, sf), names))


# all pairs of the library under six operations

_ALG = f"""fi AS (SELECT factor, CAST(row_number() OVER (ORDER BY factor) AS INT) AS f FROM (SELECT DISTINCT factor FROM zl)), zi AS MATERIALIZED (SELECT f, dt, symbol, fwd1, round(value, 5) AS value FROM zl JOIN fi ON fi.factor = zl.factor WHERE fwd1 IS NOT NULL),
 al AS (SELECT * FROM (SELECT fa, fb, dt, fwd1, unnest(['add', 'div', 'max', 'min', 'mul', 'sub']) AS op, unnest([x + y, CASE WHEN y <> 0 THEN x / y END, greatest(x, y), least(x, y), x * y, x - y]) AS v
   FROM (SELECT a.f AS fa, b.f AS fb, a.dt, a.fwd1, a.value AS x, b.value AS y FROM zi a JOIN zi b ON a.dt = b.dt AND a.symbol = b.symbol AND a.f < b.f)) WHERE v IS NOT NULL),
 ar AS (SELECT fa, fb, op, dt, rank() OVER (PARTITION BY fa, fb, op, dt ORDER BY v) + (count(*) OVER (PARTITION BY fa, fb, op, dt, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY fa, fb, op, dt ORDER BY fwd1) + (count(*) OVER (PARTITION BY fa, fb, op, dt, fwd1) - 1) / 2.0 AS b
   FROM (SELECT fa, fb, op, dt, fwd1, round(v, 10) AS v FROM al)),
 ai AS (SELECT fa, fb, op, dt, round(corr(a, b), 12) AS ic FROM ar GROUP BY fa, fb, op, dt HAVING count(*) >= 5 AND min(a) < max(a) AND min(b) < max(b)),
 an AS (SELECT x.factor || '__' || op || '__' || y.factor AS factor, ic FROM ai JOIN fi x ON x.f = fa JOIN fi y ON y.f = fb)"""


@query("m_01_algebraic_search_all", f"WITH {LONG_ALL}, {_ALG} SELECT factor, round(mean_ic, 6) AS mean_ic, round(ic_ir, 6) AS ic_ir, round(hit_rate, 6) AS hit_rate, n_obs FROM ({summary('an')})")
def m01w(spark, sf):
    """Every candidate of the library: one block of symbols x candidates a date."""
    base = all_standard(spark, sf).select("dt", "symbol", "fwd1", *[F.round(c, 5).alias(c) for c in ALL])  # products of five digits are exact at ten, and no sign hangs on the last bit
    d = M.algebra_ic(base, M.algebra_names(ALL), "fwd1")
    return rounded(Q.summarise(d).select("factor", "mean_ic", "ic_ir", "hit_rate", "n_obs"))
