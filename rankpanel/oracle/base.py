"""Common table expressions the statements are built from."""

from __future__ import annotations

FACTS = """
li AS (SELECT p.p_brand AS symbol, p.p_retailprice AS rp, l.* FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l_quantity > 0),
daily AS (
  SELECT symbol, CAST(l_shipdate AS DATE) AS day, round(sum(l_extendedprice), 2) AS amount, sum(l_quantity) AS volume,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, count(*) AS lines,
    sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS net_qty,
    round(sum(l_discount * l_extendedprice), 4) AS rzye,
    round(sum(CASE WHEN l_linestatus = 'O' THEN l_discount * l_extendedprice ELSE 0 END), 4) AS rzmre,
    round(sum(CASE WHEN l_linestatus = 'F' THEN l_discount * l_extendedprice ELSE 0 END), 4) AS rzche,
    round(sum(l_tax * l_extendedprice), 4) AS rqye,
    sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS rqyl,
    sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS rqchl,
    sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS rqmcl,
    round(sum(rp * l_quantity), 2) AS nav_value
  FROM li GROUP BY ALL),
facts AS (
  SELECT symbol, CAST(date_trunc('week', day) AS DATE) AS dt, arg_min(amount / volume, day) AS open, max(high) AS high, min(low) AS low,
    arg_max(amount / volume, day) AS close, sum(lines) AS lines, round(sum(amount), 4) AS amount, round(sum(volume), 4) AS volume,
    round(sum(net_qty), 4) AS net_qty, round(sum(rzye), 4) AS rzye, round(sum(rzmre), 4) AS rzmre, round(sum(rzche), 4) AS rzche,
    round(sum(rqye), 4) AS rqye, round(sum(rqyl), 4) AS rqyl, round(sum(rqchl), 4) AS rqchl, round(sum(rqmcl), 4) AS rqmcl,
    round(sum(nav_value), 4) AS nav_value
  FROM daily GROUP BY ALL)"""

SUPPLIER_FACTS = FACTS.replace(
    "SELECT p.p_brand AS symbol, p.p_retailprice AS rp, l.* FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l_quantity > 0",
    "SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS symbol, CAST(NULL AS DOUBLE) AS rp, l.* FROM lineitem l WHERE l_quantity > 0",
)

PANEL_ONLY = """
cal AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS bar FROM (SELECT DISTINCT dt FROM facts)),
spine AS (SELECT s.symbol, c.dt, c.bar FROM (SELECT DISTINCT symbol FROM facts) s, cal c),
panel AS MATERIALIZED (
  SELECT s.symbol, s.dt, s.bar, f.close IS NOT NULL AS traded,
    last_value(f.open IGNORE NULLS) OVER u AS open, last_value(f.high IGNORE NULLS) OVER u AS high, last_value(f.low IGNORE NULLS) OVER u AS low,
    last_value(f.close IGNORE NULLS) OVER u AS close, last_value(f.volume IGNORE NULLS) OVER u AS volume, last_value(f.amount IGNORE NULLS) OVER u AS amount,
    f.lines, f.net_qty, f.rzye, f.rzmre, f.rzche, f.rqye, f.rqyl, f.rqchl, f.rqmcl, f.nav_value,
    sum(f.net_qty) OVER u AS fd_share, f.nav_value / f.volume AS unit_nav, CAST(regexp_extract(s.symbol, '(\\d+)$', 1) AS INT) % 5 AS pool
  FROM spine s LEFT JOIN facts f ON s.symbol = f.symbol AND s.dt = f.dt
  WINDOW u AS (PARTITION BY s.symbol ORDER BY s.dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

PANEL = FACTS + "," + PANEL_ONLY
SUPPLIER_PANEL = SUPPLIER_FACTS + "," + PANEL_ONLY

# rolling windows used by the statements, by name
WINDOWS = """ WINDOW w AS (PARTITION BY symbol ORDER BY dt), """ + ", ".join(
    f"w{n} AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 5, 10, 14, 18, 20, 40, 60, 120, 200)
) + ", " + ", ".join(
    f"p{n} AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN {2 * n - 1} PRECEDING AND {n} PRECEDING)" for n in (20, 60)
) + ", u AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY dt)"


def full(agg: str, x: str, n: int, w: str = "w", need: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {w}{n} >= {need or n} THEN {agg} OVER {w}{n} END"


def mean(x, n, w="w", need=None):
    return full(f"avg({x})", x, n, w, need)


def std(x, n, need=None):
    return full(f"stddev_samp({x})", x, n, "w", need)


def total(x, n):
    return full(f"sum({x})", x, n)


def corr(a, b, n, need=None):
    both = f"CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN"
    av, bv = f"{both} {a} END", f"{both} {b} END"
    return (
        f"CASE WHEN count({av}) OVER w{n} >= {need or n} AND min({av}) OVER w{n} < max({av}) OVER w{n} "
        f"AND min({bv}) OVER w{n} < max({bv}) OVER w{n} THEN corr({av}, {bv}) OVER w{n} END"
    )


def slope(x, n):
    return full(f"regr_slope({x}, bar)", x, n)


def select(cols: str, src: str, where: str = "", ctes: str = PANEL) -> str:
    return f"WITH {ctes} SELECT {cols} FROM {src} {where}"
