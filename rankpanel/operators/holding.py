"""Hysteresis over many strategies and parameter points in one pass (P-04, C-08, C-22).

Rows are partitioned by strategy and sorted by decision inside the partition; a grouped iterator folds them as batches
arrive. What a task holds is one decision and the positions of each parameter point, never a strategy's
history, so long histories and many points cost time, not memory. Every point sees the same candidates once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import advance, hysteresis_step

Point = tuple[float, int]


class Fold:
    """Positions of every parameter point of one strategy."""

    def __init__(self, points: Sequence[Point], k: int):
        self.points, self.k = points, k
        self.held: list[dict[str, int]] = [{} for _ in points]

    def decide(self, step: int, enough: bool, top: list[str], r01: dict[str, float]) -> Iterator[tuple[float, int, str, int]]:
        """(delta, min_days, symbol, hold_days) after one decision; nothing where too few scores are valid."""
        for i, (delta, min_days) in enumerate(self.points):
            held = {s: d + step for s, d in self.held[i].items()}
            if enough:
                held = advance(held, hysteresis_step(held, top, r01, self.k, delta, min_days))
                yield from ((delta, min_days, s, d) for s, d in held.items())
            self.held[i] = held


def _folded(keys: list[str], points: Sequence[Point], k: int, freq: int | None):
    """Sorted rows -> holdings, batch by batch."""
    columns = [*keys, "delta_rank", "min_days", "period", "symbol", "hold_days"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        strategy, period, step, valid, top, r01 = None, None, 0, 0, [], {}
        fold = Fold(points, k)
        out: list[tuple] = []

        def close() -> None:
            out.extend((*strategy, delta, days, period, s, d) for delta, days, s, d in fold.decide(step, valid >= k, top, r01))

        for pdf in batches:
            names = zip(*(pdf[c].tolist() for c in keys))
            rows = zip(names, *(pdf[c].tolist() for c in ("period", "symbol", "pos", "r01", "n_valid")), pdf["freq"].tolist() if freq is None else [freq] * len(pdf))
            for name, at, symbol, pos, rank, n_valid, bars in rows:
                if name != strategy or at != period:
                    if strategy is not None:
                        close()
                    if name != strategy:
                        strategy, fold = name, Fold(points, k)
                    period, step, valid, top, r01 = at, bars, n_valid, [], {}
                r01[symbol] = rank
                if pos <= k:  # a missing position is no number and never is
                    top.append(symbol)
            yield pd.DataFrame(out, columns=columns)
            out.clear()
        if strategy is not None:
            close()
            yield pd.DataFrame(out, columns=columns)

    return run


def grid_selection(cand: DataFrame, keys: Sequence[str], points: Sequence[Point], k: int, freq: int | None = None) -> DataFrame:
    """Holdings (keys, delta_rank, min_days, period, symbol, hold_days) of every strategy at every point (delta, min_days).

    `cand`: keys, period, symbol, pos, r01, n_valid as `ranked_candidates` gives them; `freq` bars lie between decisions,
    read from a column of that name where it is None. Only symbols that reach the top k at some decision can
    be held, so all others go before the shuffle.
    """
    keys = list(keys)
    ever = cand.where(F.col("pos") <= k).select(*keys, "symbol").distinct()
    extra = ["freq"] if freq is None and "freq" not in keys else []
    small = cand.join(ever, [*keys, "symbol"], "left_semi").select(*keys, "period", "symbol", F.col("pos").cast("double").alias("pos"), "r01", "n_valid", *extra)
    laid = small.repartition(int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    laid = laid.sortWithinPartitions(*keys, "period", F.col("pos").asc_nulls_last(), "symbol")
    types = dict(cand.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", delta_rank double, min_days int, period int, symbol string, hold_days int"
    return laid.mapInPandas(_folded(keys, points, k, freq), schema)
