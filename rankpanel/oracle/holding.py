"""Hysteresis as a recursive statement: one step a decision, the positions as a list."""

from __future__ import annotations

from collections.abc import Sequence


def hysteresis(src: str, keys: str, k: int, freq: str, points: Sequence[tuple[float, int]], out: str = "hy") -> str:
    """Common table expressions that end in `out` (keys, dl, md, period, symbol, hold_days).

    `src` has keys, period, symbol, score; the statement needs WITH RECURSIVE. `freq` may name a column of the keys.
    """
    part = f"PARTITION BY {keys}, period"
    on = lambda a, b: " AND ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in keys.split(","))
    of = lambda a: ", ".join(f"{a}.{c.strip()}" for c in keys.split(","))
    grid = ", ".join(f"(CAST({d} AS DOUBLE), {m})" for d, m in points)
    return f"""{out}c AS MATERIALIZED (SELECT {keys}, period, symbol, CASE WHEN score IS NOT NULL THEN row_number() OVER ({part} ORDER BY score DESC NULLS LAST, symbol) END AS pos,
    (row_number() OVER ({part} ORDER BY score ASC NULLS FIRST, symbol) - 1) / CASE WHEN count(*) OVER ({part}) > 1 THEN count(*) OVER ({part}) - 1 ELSE 1 END AS r01, count(score) OVER ({part}) AS nv FROM {src}),
 {out}e AS (SELECT DISTINCT {keys}, symbol FROM {out}c WHERE pos <= {k}),
 {out}d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY period) AS i FROM (SELECT {of('c')}, period, any_value(nv) AS nv, coalesce(list(c.symbol ORDER BY pos) FILTER (pos <= {k}), []) AS top, list({{'s': c.symbol, 'r': r01}}) AS rk
    FROM {out}c c JOIN {out}e e ON {on('c', 'e')} AND c.symbol = e.symbol GROUP BY {of('c')}, period)),
 {out}r AS (SELECT {keys}, dl, md, CAST(0 AS BIGINT) AS i, CAST(NULL AS INT) AS period, false AS ok, CAST([] AS STRUCT(s VARCHAR, d BIGINT)[]) AS held FROM (SELECT DISTINCT {keys} FROM {out}d), (VALUES {grid}) g(dl, md)
   UNION ALL SELECT {keys}, dl, md, i, period, nv >= {k}, CASE WHEN nv >= {k} THEN list_transform(target, lambda t: {{'s': t, 'd': coalesce(list_filter(aged, lambda x: x.s = t)[1].d, 1)}}) ELSE aged END
   FROM (SELECT *, CASE WHEN dl <= 0 AND md <= 0 THEN top WHEN len(aged) < {k} THEN list_concat(syms, (list_filter(top, lambda t: NOT list_contains(syms, t)))[1:{k} - len(aged)])
       WHEN best IS NOT NULL AND coalesce(list_filter(rk, lambda y: y.s = best)[1].r, 0) - worst.r >= dl AND worst.d >= md THEN list_transform(syms, lambda s: CASE WHEN s = worst.s THEN best ELSE s END) ELSE syms END AS target
     FROM (SELECT *, list_sort(list_transform(aged, lambda x: {{'r': coalesce(list_filter(rk, lambda y: y.s = x.s)[1].r, 0), 's': x.s, 'd': x.d}}))[1] AS worst, list_filter(top, lambda t: NOT list_contains(syms, t))[1] AS best
       FROM (SELECT *, list_transform(aged, lambda x: x.s) AS syms FROM (SELECT {of('d')}, r.dl, r.md, d.i, d.period, d.nv, d.top, d.rk, list_transform(r.held, lambda x: {{'s': x.s, 'd': x.d + {freq}}}) AS aged FROM {out}r r JOIN {out}d d ON {on('r', 'd')} AND d.i = r.i + 1))))),
 {out} AS MATERIALIZED (SELECT {keys}, dl, md, period, h.s AS symbol, CAST(h.d AS INT) AS hold_days FROM (SELECT {keys}, dl, md, period, unnest(held) AS h FROM {out}r WHERE ok))"""
