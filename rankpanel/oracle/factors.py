"""Expected factor formulas as DuckDB window expressions."""

from __future__ import annotations

from .base import PANEL, WINDOWS, corr, full, mean, slope, std, total

E = "1e-10"

STAGED = PANEL + f""",
s1 AS (
  SELECT *, close / lag(close) OVER w - 1 AS r, close - lag(close) OVER w AS delta, lag(close) OVER w AS pc, lag(high) OVER w AS ph,
    lag(low) OVER w AS pl, volume / lag(volume) OVER w - 1 AS dvol
  FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
s2 AS MATERIALIZED (
  SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
    CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm,
    CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm,
    sum(coalesce(sign(delta), 0) * volume) OVER u AS obv,
    CASE WHEN high <> low THEN ((close - low) - (high - close)) / (high - low + {E}) * volume END AS mfv,
    avg(r) OVER (PARTITION BY dt) AS mkt, lag(r, 2) OVER w AS ra, lag(r, 1) OVER w AS rb
  FROM s1 WINDOW w AS (PARTITION BY symbol ORDER BY dt), u AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS MATERIALIZED (SELECT *, 2 * (CAST(rb < ra AS INT) + CAST(r < ra AS INT)) + CAST(r < rb AS INT) AS pat FROM s2)"""


def _pos(n):
    lo, hi = full("min(low)", "low", n), full("max(high)", "high", n)
    return f"CASE WHEN ({hi}) - ({lo}) > {E} THEN greatest(0, least(1, (close - ({lo})) / (({hi}) - ({lo})))) WHEN ({hi}) - ({lo}) IS NOT NULL THEN 0.5 END"


def _sd(a, b):
    return f"CASE WHEN ({b}) >= {E} THEN ({a}) / (({b}) + {E}) END"


def _chg(c, n):
    return f"CASE WHEN abs(lag({c}, {n}) OVER w) > {E} THEN ({c} - lag({c}, {n}) OVER w) / (abs(lag({c}, {n}) OVER w) + {E}) END"


def lst(x, n):
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN list({x}) OVER w{n} END"


def _dd(n):
    """Worst drawdown of a window list by comparing every later price with the running peak."""
    l = f"list(close) OVER w{n}"
    return (
        f"CASE WHEN count(close) OVER w{n} = {n} THEN list_min(list_transform(range(1, {n + 1}), "
        f"lambda j: ({l})[j] / list_max(list_slice({l}, 1, j)) - 1)) END"
    )


def _entropy():
    parts = []
    for k in range(6):
        p = f"(sum(CAST(pat = {k} AS DOUBLE)) OVER w18 / 18.0)"
        parts.append(f"CASE WHEN {p} > 0 THEN {p} * ln({p}) ELSE 0 END")
    return f"CASE WHEN count(r) OVER w20 = 20 THEN -({' + '.join(parts)}) / ln(6) END"


UP = mean("CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END", 14)
DOWN = mean("CASE WHEN delta IS NOT NULL THEN -least(delta, 0) END", 14)
UPV, DNV = total("CASE WHEN r > 0 THEN volume ELSE 0 END", 20), total("CASE WHEN r <= 0 THEN volume ELSE 0 END", 20)
GKV = mean(f"0.5 * power(ln(high / (low + {E})), 2) - (2 * ln(2) - 1) * power(ln(close / (open + {E})), 2)", 20)
CC = mean("r * r", 20)

SQL: dict[str, str] = {
    "MOM_20D": "(close / lag(close, 20) OVER w - 1) * 100",
    "SLOPE_20D": slope("close", 20),
    "PRICE_POSITION_20D": _pos(20),
    "PRICE_POSITION_120D": _pos(120),
    "RET_VOL_20D": std("r * 100", 20),
    "MAX_DD_60D": f"abs({_dd(60)}) * 100",
    "VOL_RATIO_20D": _sd(mean("volume", 20), mean("volume", 20, "p")),
    "VOL_RATIO_60D": _sd(mean("volume", 60), mean("volume", 60, "p")),
    "PV_CORR_20D": corr("r", "dvol", 20),
    "RSI_14": f"100 - 100 / (1 + ({UP}) / (({DOWN}) + {E}))",
    "OBV_SLOPE_10D": slope("obv", 10),
    "CMF_20D": f"({total('mfv', 20)}) / (({total('volume', 20)}) + {E})",
    "SHARPE_RATIO_20D": f"CASE WHEN ({std('r', 20)}) >= {E} THEN ({mean('r', 20)}) / (({std('r', 20)}) + {E}) * sqrt(252) END",
    "CALMAR_RATIO_60D": f"CASE WHEN abs({_dd(60)}) >= {E} THEN (close / lag(close, 59) OVER w - 1) / abs({_dd(60)}) END",
    "VORTEX_14D": f"({total('abs(high - pl)', 14)}) / (({total('tr', 14)}) + {E}) - ({total('abs(low - ph)', 14)}) / (({total('tr', 14)}) + {E})",
    "RELATIVE_STRENGTH_VS_MARKET_20D": f"({total('ln(1 + r)', 20)}) - ({total('ln(1 + mkt)', 20)})",
    "CORRELATION_TO_MARKET_20D": corr("r", "mkt", 20),
    "TSMOM_60D": "(close / lag(close, 60) OVER w - 1) * 100",
    "TSMOM_120D": "(close / lag(close, 120) OVER w - 1) * 100",
    "BREAKOUT_20D": f"(close / ({full('max(high)', 'high', 20)}) - 1) * 100",
    "TURNOVER_ACCEL_5_20": _sd(mean("volume", 5), mean("volume", 20)),
    "REALIZED_VOL_20D": f"({std('r', 20)}) * sqrt(252)",
    "AMIHUD_ILLIQUIDITY": f"({mean(f'abs(r) / (volume * close + {E})', 20)}) * 1e6",
    "SPREAD_PROXY": f"({mean(f'(high - low) / (close + {E})', 5)}) * 100",
    "SKEW_20D": full("skewness(r)", "r", 20),
    "KURT_20D": full("kurtosis(r)", "r", 20),
    "INFO_DISCRETE_20D": "CASE WHEN count(dt) OVER w20 = 20 THEN sign(close / lag(close, 20) OVER w - 1) * "
    "(coalesce(sum(CAST(r < 0 AS INT)) OVER w20, 0) - coalesce(sum(CAST(r > 0 AS INT)) OVER w20, 0)) / 20.0 END",
    "IBS": f"CASE WHEN abs(high - low) > {E} THEN greatest(0, least(1, (close - low) / (high - low + {E}))) WHEN high IS NOT NULL THEN 0.5 END",
    "MEAN_REV_RATIO_20D": f"(close / ({mean('close', 20)}) - 1) * 100",
    "UP_DOWN_VOL_RATIO_20D": _sd(UPV, DNV),
    "ABNORMAL_VOLUME_20D": f"(({_sd(mean('volume', 5), mean('volume', 60))}) - 1) * 100",
    "ULCER_INDEX_20D": "CASE WHEN count(close) OVER w20 = 20 THEN sqrt(list_sum(list_transform(range(1, 21), "
    "lambda j: power(((list(close) OVER w20)[j] / list_max(list_slice(list(close) OVER w20, 1, j)) - 1) * 100, 2))) / 20) END",
    "GK_VOL_RATIO_20D": f"CASE WHEN ({CC}) >= {E} THEN sqrt(abs({GKV}) / (({CC}) + {E})) END",
    "PERM_ENTROPY_20D": _entropy(),
    "DOWNSIDE_DEV_20D": f"sqrt({mean('CASE WHEN r IS NOT NULL THEN power(least(r, 0), 2) END', 20)}) * sqrt(252) * 100",
    "SHARE_CHG_5D": _chg("fd_share", 5),
    "SHARE_CHG_10D": _chg("fd_share", 10),
    "SHARE_CHG_20D": _chg("fd_share", 20),
    "SHARE_ACCEL": f"({_chg('fd_share', 5)}) - ({_chg('fd_share', 20)})",
}


def one(name: str) -> str:
    return f"WITH {STAGED} SELECT symbol, dt, round(v, 6) AS value FROM (SELECT symbol, dt, {SQL[name]} AS v FROM s {WINDOWS}) WHERE v IS NOT NULL"


def wide(names, src: str = "s", extra: str = "") -> str:
    """CTE body: the panel keys with one column per factor."""
    cols = ", ".join(f"{SQL[n]} AS {n}" for n in names)
    return f"SELECT symbol, dt, bar, pool, r, close{extra}, {cols} FROM {src} {WINDOWS}"


# factors stated in several steps
DD_DURATION = f"""WITH {STAGED} SELECT symbol, dt, round(least(coalesce(bar - max(hb), least(bar, 60)), 60) / 60.0, 6) AS value FROM (
  SELECT a.symbol, a.dt, a.bar AS ob, a.bar - f.fb AS bar, b.bar + 1 - f.fb AS hb
  FROM s a JOIN (SELECT symbol, min(bar) AS fb FROM s WHERE close IS NOT NULL GROUP BY symbol) f ON a.symbol = f.symbol AND a.bar >= f.fb
  LEFT JOIN s b ON a.symbol = b.symbol AND b.bar < a.bar AND b.bar >= a.bar - 60 AND b.close >= a.close)
 GROUP BY symbol, dt, ob, bar HAVING ob > 0"""


_U = "OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ADX = f"""WITH {STAGED}, a AS (SELECT symbol, dt, tr, list(pdm) {_U} AS lp, list(mdm) {_U} AS lm, list(tr) FILTER (WHERE tr IS NOT NULL) {_U} AS lt FROM s),
 b AS (SELECT symbol, dt, list_reduce(lp, lambda p, x: p + (x - p) * 2 / 15.0) AS p, list_reduce(lm, lambda p, x: p + (x - p) * 2 / 15.0) AS m,
   list_reduce(lt, lambda p, x: p + (x - p) * 2 / 15.0) AS t FROM a WHERE len(lt) >= 14 AND len(lp) >= 14),
 c AS (SELECT symbol, dt, 100 * p / (t + 1e-10) AS pd, 100 * m / (t + 1e-10) AS md FROM b),
 d AS (SELECT symbol, dt, list(100 * abs(pd - md) / (pd + md + 1e-10)) {_U} AS l FROM c)
 SELECT symbol, dt, round(list_reduce(l, lambda p, x: p + (x - p) * 2 / 15.0), 6) AS value FROM d WHERE len(l) >= 14"""

HURST = f"""WITH {STAGED}, wn AS (SELECT symbol, dt, list(r) OVER w60 AS a FROM s {WINDOWS} QUALIFY count(r) OVER w60 = 60),
 sub AS (SELECT symbol, dt, n, k, list_slice(a, k * n + 1, (k + 1) * n) AS v FROM wn, (VALUES (30, 2), (15, 4), (7, 8)) q(n, c), range(8) g(k) WHERE k < c),
 el AS (SELECT symbol, dt, n, k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM sub),
 cu AS (SELECT symbol, dt, n, k, x, sum(x - m) OVER (PARTITION BY symbol, dt, n, k ORDER BY i) AS c FROM (SELECT *, avg(x) OVER (PARTITION BY symbol, dt, n, k) AS m FROM el)),
 rs AS (SELECT symbol, dt, n, k, CASE WHEN stddev_pop(x) > 1e-10 THEN (max(c) - min(c)) / stddev_pop(x) END AS q FROM cu GROUP BY ALL),
 pt AS (SELECT symbol, dt, ln(n) AS lx, ln(avg(q)) AS ly FROM rs GROUP BY symbol, dt, n HAVING avg(q) > 0)
 SELECT symbol, dt, round(greatest(0, least(1, regr_slope(ly, lx))), 6) AS value FROM pt GROUP BY symbol, dt HAVING count(*) >= 2"""

STEPPED = {"DD_DURATION_60D": DD_DURATION, "ADX_14D": ADX, "HURST_60D": HURST}
