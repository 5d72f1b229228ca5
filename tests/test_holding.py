"""The streaming grouped fold against a fold of whole strategies, in tiny batches, at many points."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankpanel.operators import holding as H
from rankpanel.operators import selection as S

POINTS = [(0.0, 0), (0.1, 0), (0.1, 9), (0.3, 4), (0.0, 6)]


@pytest.fixture(scope="module")
def candidates(spark):
    rnd = random.Random(2)
    rows = []
    for combo in ("a", "b + c", "d", None):
        for win in (0, 1):
            for period in range(1, 25):
                for s in range(rnd.choice([1, 2, 8])):
                    rows.append((combo, win, period, f"s{s}", rnd.choice([None, *map(float, range(6))]) if rnd.random() < 0.9 else None))
    d = spark.createDataFrame(rows, "combo string, win int, period int, symbol string, score double")
    return S.ranked_candidates(d, ["combo", "win", "period"]).withColumn("freq", F.col("win") * 2 + 3)


def whole(cand, k, points):
    """Every strategy in memory, one decision after the other."""
    pdf = cand.toPandas()
    ever = {(c, w, s) for c, w, s, p in zip(pdf["combo"], pdf["win"], pdf["symbol"], pdf["pos"]) if p <= k}
    out = []
    groups: dict = {}
    for r in pdf.itertuples():
        groups.setdefault((r.combo if isinstance(r.combo, str) else None, r.win), {}).setdefault(r.period, []).append(r)
    for (combo, win), periods in groups.items():
        for delta, days in points:
            held: dict = {}
            for period in sorted(periods):
                rows = [r for r in periods[period] if (r.combo, win, r.symbol) in ever or combo is None]
                if not rows:
                    continue
                top = [r.symbol for r in sorted(rows, key=lambda r: r.pos if r.pos == r.pos else 99) if r.pos <= k]
                held = {s: d + win * 2 + 3 for s, d in held.items()}
                if rows[0].n_valid >= k:
                    held = S.advance(held, S.hysteresis_step(held, top, {r.symbol: r.r01 for r in rows}, k, delta, days))
                    out += [(combo, win, delta, days, period, s, d) for s, d in held.items()]
    return sorted(map(str, out))


@pytest.mark.parametrize("batch", [3, 10_000])
def test_grid_equals_whole_strategies(spark, candidates, batch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        cand = candidates.where("combo IS NOT NULL")
        got = H.grid_selection(cand, ["combo", "win"], POINTS, 2).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(str((r.combo, r.win, r.delta_rank, r.min_days, r.period, r.symbol, r.hold_days)) for r in got) == whole(cand, 2, POINTS)
    assert len({(r.delta_rank, r.min_days) for r in got}) == len(POINTS)


def test_one_point_equals_selection(spark, candidates):
    cand = candidates.where("combo IS NOT NULL").withColumn("freq", F.lit(4))
    one = H.grid_selection(cand, ["combo", "win"], [(0.1, 9)], 2, 4).drop("delta_rank", "min_days")
    old = S.stateful_selection(cand, ["combo", "win"], 2, 4, 0.1, 9)
    cols = ["combo", "win", "period", "symbol", "hold_days"]
    assert sorted(map(str, one.select(cols).collect())) == sorted(map(str, old.select(cols).collect()))


def test_a_long_strategy_is_never_gathered():
    """What the fold holds is one decision: batches go in and come out one by one."""
    n = 0

    def batches():
        nonlocal n
        for p in range(200):
            n += 1
            yield pd.DataFrame({"combo": ["x"] * 3, "period": [p] * 3, "symbol": list("abc"), "pos": [1.0, 2.0, None], "r01": [1.0, 0.5, 0.0], "n_valid": [2] * 3})

    seen = 0
    for out in H._folded(["combo"], [(0.1, 9)], 2, 5)(batches()):
        seen += len(out)
        assert len(out) <= 4
    assert n == 200 and seen == 400


def test_no_rows(spark, candidates):
    assert H.grid_selection(candidates.where("false"), ["combo", "win"], POINTS, 2).collect() == []
