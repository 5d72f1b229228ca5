"""Selection: top-k, pool-diversified top-k, stateful selection with hysteresis (J-14, P-03, P-04)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rolling import spread


def topk_two_step(d: DataFrame, by: Sequence[str], value: str, k: int, out: str, tie: str = "symbol", splits: int = 64) -> DataFrame:
    """Exact top-k per group when a group may be huge: best k of every slice first, then of their union."""
    by = list(by)
    order = [F.col(value).desc(), F.col(tie).asc()]
    s = d.where(F.col(value).isNotNull()).withColumn("__slice", F.pmod(F.xxhash64(tie), F.lit(splits)))
    s = s.withColumn("__r", F.row_number().over(W.partitionBy(*by, "__slice").orderBy(*order))).where(F.col("__r") <= k)
    return s.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(out) <= k).drop("__slice", "__r")


def ranked_candidates(scores: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Adds `pos` (1 = best, NULL when not selectable), `r01` and `n_valid` per decision."""
    w = W.partitionBy(*keys)
    v = F.col(score)
    n = F.count(F.lit(1)).over(w)
    return scores.select(
        "*",
        F.when(v.isNotNull(), F.row_number().over(w.orderBy(v.desc_nulls_last(), F.col("symbol")))).alias("pos"),
        ((F.row_number().over(w.orderBy(v.asc_nulls_first(), F.col("symbol"))) - 1) / F.when(n > 1, n - 1).otherwise(F.lit(1))).alias("r01"),
        F.count(v).over(w).alias("n_valid"),
    )


def pool_topk(scores: DataFrame, keys: Sequence[str], k: int, depth: int, score: str = "score") -> DataFrame:
    """Best first, then best from a pool not used yet within the first `depth`, else best remaining.

    Only the first `depth` candidates of a decision are gathered, so the arrays stay tiny. Pool -1 is
    always a pool of its own.
    """
    keys = list(keys)
    order = W.partitionBy(*keys).orderBy(F.col(score).desc(), F.col("symbol"))
    c = scores.where(F.col(score).isNotNull()).withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= depth)
    c = c.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "symbol", "pool"))).alias("cand"))
    c = c.withColumn("picked", F.slice("cand", 1, 1))
    for _ in range(k - 1):
        left = F.array_except("cand", "picked")
        fresh = F.filter(left, lambda x: (x["pool"] == -1) | ~F.exists("picked", lambda p: p["pool"] == x["pool"]))
        pick = F.when(F.size(fresh) > 0, F.slice(fresh, 1, 1)).otherwise(F.slice(left, 1, 1))
        c = c.withColumn("picked", F.concat("picked", pick))
    p = c.select(*keys, F.posexplode("picked").alias("i", "c"))
    return p.select(*keys, (F.col("i") + 1).alias("pick"), "c.symbol", "c.pool", F.col("c.pos").alias("pos"))


def hysteresis_step(held: dict[str, int], top: list[str], rank01: dict[str, float], k: int, delta: float, min_days: int) -> list[str]:
    """One decision. Not full: keep and fill. Full: at most one swap, for a clear enough lead after enough days."""
    if delta <= 0.0 and min_days <= 0:
        return list(top)
    if len(held) < k:
        fill = [s for s in top if s not in held]
        return list(held) + fill[: k - len(held)]
    worst = min(held, key=lambda s: (rank01.get(s, 0.0), s))
    best = next((s for s in top if s not in held), None)
    keep = list(held)
    if best is not None and rank01.get(best, 0.0) - rank01.get(worst, 0.0) >= delta and held[worst] >= min_days:
        keep[keep.index(worst)] = best
    return keep


def advance(held: dict[str, int], target: list[str]) -> dict[str, int]:
    """Hold days after a decision: kept positions go on, new ones start at 1."""
    return {s: held.get(s, 1) for s in target}


FOLD_SCHEMA = "period int, symbol string, hold_days int"


def decisions(pdf: pd.DataFrame, k: int):
    """(period, enough valid scores, top k best first, rank01 by symbol) in time order."""
    d = pdf.sort_values(["period", "pos"], na_position="last")
    current, valid, top, r01 = None, 0, [], {}
    for period, symbol, pos, rank, n_valid in zip(d["period"].tolist(), d["symbol"].tolist(), d["pos"].tolist(), d["r01"].tolist(), d["n_valid"].tolist()):
        if period != current:
            if current is not None:
                yield int(current), valid >= k, top, r01
            current, valid, top, r01 = period, n_valid, [], {}
        r01[symbol] = rank
        if pos is not None and pos <= k:
            top.append(symbol)
    if current is not None:
        yield int(current), valid >= k, top, r01


def fold_decisions(keys: Sequence[str], k: int, freq: int | None, delta: float, min_days: int):
    """Per strategy: run the decisions in order. Input holds only symbols that ever reach the top k."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, int] = {}
        out = []
        step = int(pdf["freq"].iloc[0]) if freq is None else freq
        for period, enough, top, r01 in decisions(pdf, k):
            held = {s: d + step for s, d in held.items()}
            if enough:
                held = advance(held, hysteresis_step(held, top, r01, k, delta, min_days))
                out += [(period, s, d) for s, d in held.items()]
        res = pd.DataFrame(out, columns=["period", "symbol", "hold_days"])
        for i, name in enumerate(keys):
            res.insert(i, name, key[i])
        return res

    return run


def stateful_selection(cand: DataFrame, keys: Sequence[str], k: int, freq: int | None, delta: float, min_days: int) -> DataFrame:
    """Holdings per decision under hysteresis.

    The fold is sequential inside one strategy and parallel over strategies. A position can only be a
    symbol that reached the top k at some decision, so all other symbols are dropped before the fold:
    what a task receives is bounded by k x decisions, not by the universe. A decision whose symbols
    were all dropped still appears through its own top k.
    """
    keys = list(keys)
    ever = cand.where(F.col("pos") <= k).select(*keys, "symbol").distinct()
    cols = [*keys, "period", "symbol", "pos", "r01", "n_valid"] + (["freq"] if freq is None and "freq" not in keys else [])
    small = cand.join(ever, [*keys, "symbol"], "left_semi").select(*cols)
    types = dict(cand.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", " + FOLD_SCHEMA
    return spread(small, *keys).groupBy(*keys).applyInPandas(fold_decisions(keys, k, freq, delta, min_days), schema)
