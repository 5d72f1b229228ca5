"""Shared expressions for standardised factors, forward returns and the daily rank statistic."""

from __future__ import annotations

from .base import WINDOWS
from .factors import STAGED, wide

NAMES = ("MOM_20D", "PRICE_POSITION_20D", "RET_VOL_20D", "VOL_RATIO_20D", "PV_CORR_20D", "RSI_14", "CMF_20D", "SPREAD_PROXY")
BOUNDED = ("PRICE_POSITION_20D", "PV_CORR_20D", "RSI_14", "CMF_20D")


def avg_rank(x: str, part: str, desc: bool = False) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}{' DESC' if desc else ''}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"


HOR = (1, 3, 5, 10, 20)
_FWD = ", ".join(f"lead(close, {h}) OVER w / close - 1 AS fwd{h}" for h in HOR)



def wide_factors(names) -> str:
    """Factors of the panel with forward returns, a column each: `fw`."""
    return STAGED + f""",
fw0 AS ({wide(names)}),
fw AS MATERIALIZED (SELECT *, {_FWD} FROM fw0 WINDOW w AS (PARTITION BY symbol ORDER BY dt))"""


def raw_factors(names) -> str:
    """`wide_factors`, and a row for each factor: `rl`."""
    return wide_factors(names) + f""",
rl AS MATERIALIZED (UNPIVOT fw ON {', '.join(names)} INTO NAME factor VALUE value)"""


def standardised(names, bounded) -> str:
    """`raw_factors`, and `zl`: bounded factors as centred ranks, others as clipped z-scores."""
    inside = ", ".join(f"'{n}'" for n in bounded)
    return raw_factors(names) + f""",
st AS (SELECT dt, factor, avg(value) AS m, stddev_samp(value) AS sd, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, count(*) AS n FROM rl GROUP BY dt, factor),
zl AS MATERIALIZED (
  SELECT symbol, dt, bar, pool, r, close, fwd1, fwd3, fwd5, fwd10, fwd20, factor, value FROM (
    SELECT rl.* EXCLUDE (value), CASE WHEN rl.factor IN ({inside}) THEN {avg_rank('value', 'rl.dt, rl.factor')} / count(*) OVER (PARTITION BY rl.dt, rl.factor) - 0.5
      WHEN sd >= 1e-10 THEN (greatest(lo, least(hi, value)) - m) / sd END AS value
    FROM rl JOIN st ON rl.dt = st.dt AND rl.factor = st.factor) WHERE value IS NOT NULL)"""


WIDE, RAW, LONG = wide_factors(NAMES), raw_factors(NAMES), standardised(NAMES, BOUNDED)


def ic_cte(name: str, src: str, fwd: str, keys: str = "factor, dt", need: int = 5, where: str = "", value: str = "value") -> str:
    return f"""{name} AS MATERIALIZED (SELECT {keys}, round(corr(a, b), 12) AS ic, count(*) AS n FROM (
   SELECT {keys}, {avg_rank(value, keys)} AS a, {avg_rank(fwd, keys)} AS b FROM {src} WHERE {fwd} IS NOT NULL AND {value} IS NOT NULL {where})
   GROUP BY {keys} HAVING count(*) >= {need} AND min(a) < max(a) AND min(b) < max(b))"""


IC = LONG + ", " + ic_cte("ic", "zl", "fwd1")


def t_two_sided(t: str, nu: str) -> str:
    """P(|T| > |t|) for whole degrees of freedom, by the finite trigonometric series."""
    th = f"atan(abs({t}) / sqrt({nu}))"
    even = (
        f"sin({th}) * coalesce(list_sum(list_transform(range(0, CAST({nu} AS BIGINT) // 2), "
        f"lambda k: exp(2 * k * ln(cos({th})) + lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0)))), 0)"
    )
    odd = (
        f"2 / pi() * ({th} + sin({th}) * coalesce(list_sum(list_transform(range(0, (CAST({nu} AS BIGINT) - 1) // 2), "
        f"lambda k: exp((2 * k + 1) * ln(cos({th})) + lgamma(k + 1.0) + lgamma(1.5) - lgamma(k + 1.5)))), 0))"
    )
    return f"(1 - CASE WHEN CAST({nu} AS BIGINT) % 2 = 0 THEN {even} ELSE {odd} END)"


def summary(src: str = "ic", keys: str = "factor", need: int = 30, value: str = "ic") -> str:
    """One row per key: mean, std, ratio, t, p, hit rate, count."""
    return f"""SELECT *, CASE WHEN std_ic > 1e-10 THEN {t_two_sided('t_stat', '(n_obs - 1)')} ELSE 1.0 END AS p_value FROM (
   SELECT *, CASE WHEN std_ic > 1e-10 THEN mean_ic / std_ic ELSE 0 END AS ic_ir, CASE WHEN std_ic > 1e-10 THEN mean_ic / (std_ic / sqrt(n_obs)) ELSE 0 END AS t_stat FROM (
     SELECT {keys}, avg({value}) AS mean_ic, stddev_samp({value}) AS std_ic, avg(CAST({value} > 0 AS INT)) AS hit_rate, count(*) AS n_obs FROM {src} GROUP BY {keys} HAVING count(*) >= {need}))"""


SUMMARY_COLS = "round(mean_ic, 6) AS mean_ic, round(std_ic, 6) AS std_ic, round(ic_ir, 6) AS ic_ir, round(t_stat, 6) AS t_stat, round(p_value, 6) AS p_value, round(hit_rate, 6) AS hit_rate, n_obs"
