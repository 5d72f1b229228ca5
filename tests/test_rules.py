"""Decision rules, enumeration, ranks and recursions against brute force on small fixtures."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankpanel.functions import rolling as R
from rankpanel.functions.ranking import quantiles, ranked
from rankpanel.functions.student import betainc
from rankpanel.operators import mining as M
from rankpanel.operators import quality as Q
from rankpanel.operators import selection as S
from rankpanel.operators import walkforward as WF
from rankpanel.plans.mining_queries import BUCKETS


@pytest.mark.parametrize(
    "held, top, r01, k, delta, days, want",
    [
        ({}, ["a", "b"], {}, 2, 0.1, 9, {"a", "b"}),
        ({"c": 5}, ["a", "b"], {"a": 1.0, "c": 0.1}, 2, 0.1, 9, {"c", "a"}),
        ({"c": 15, "d": 15}, ["a", "b"], {"a": 1.0, "b": 0.9, "c": 0.5, "d": 0.6}, 2, 0.1, 9, {"a", "d"}),
        ({"c": 5, "d": 15}, ["a", "b"], {"a": 1.0, "b": 0.9, "c": 0.5, "d": 0.6}, 2, 0.1, 9, {"c", "d"}),
        ({"c": 15, "d": 15}, ["a", "b"], {"a": 0.55, "b": 0.5, "c": 0.5, "d": 0.6}, 2, 0.1, 9, {"c", "d"}),
        ({"c": 15, "d": 15}, ["a", "b"], {"a": 1.0, "b": 0.9, "c": 0.0, "d": 0.1}, 2, 0.1, 9, {"a", "d"}),
        ({"c": 1, "d": 1}, ["a", "b"], {}, 2, 0.0, 0, {"a", "b"}),
    ],
)
def test_hysteresis_step(held, top, r01, k, delta, days, want):
    assert set(S.hysteresis_step(held, top, r01, k, delta, days)) == want


def test_hysteresis_production_case():
    n = 43
    r01 = {str(i): i / (n - 1) for i in range(n)}
    assert set(S.hysteresis_step({"20": 15, "21": 15}, ["42", "41"], r01, 2, 0.10, 9)) == {"42", "21"}


def test_stateful_selection_matches_full_fold(spark):
    rnd = random.Random(3)
    rows = [(c, p, f"s{i:02d}", rnd.random()) for c in ("x", "y") for p in range(1, 30) for i in range(12)]
    cand = S.ranked_candidates(spark.createDataFrame(rows, "combo string, period int, symbol string, score double"), ["combo", "period"])
    got = {(r.combo, r.period, r.symbol, r.hold_days) for r in S.stateful_selection(cand, ["combo"], 2, 4, 0.2, 8).collect()}
    want = set()
    for c in ("x", "y"):
        held = {}
        for p in range(1, 30):
            sc = {s: v for cc, pp, s, v in rows if cc == c and pp == p}
            asc = sorted(sc, key=lambda s: (sc[s], s))
            held = {s: d + 4 for s, d in held.items()}
            top = sorted(sc, key=lambda s: (-sc[s], s))[:2]
            held = S.advance(held, S.hysteresis_step(held, top, {s: i / 11 for i, s in enumerate(asc)}, 2, 0.2, 8))
            want |= {(c, p, s, d) for s, d in held.items()}
    assert got == want


@pytest.mark.parametrize(
    "scores, pools, want",
    [
        ([10, 9, 8, 7, 6], [0, 0, 1, 1, 2], {0, 2}),
        ([10, 9, 8], [0, 0, 0], {0, 1}),
        ([10, 9, 8], [0, -1, 0], {0, 1}),
        ([10, None, 8], [0, 1, 0], {0, 2}),
        ([10], [0], {0}),
    ],
)
def test_pool_topk(spark, scores, pools, want):
    rows = [("c", i, None if s is None else float(s), p) for i, (s, p) in enumerate(zip(scores, pools))]
    d = spark.createDataFrame(rows, "combo string, symbol int, score double, pool int")
    assert {r.symbol for r in S.pool_topk(d, ["combo"], 2, 5).collect()} == want


def test_golden_combo_counts(spark):
    names = [(f, b) for b, fs in BUCKETS.items() if b not in ("FUND_FLOW", "LEVERAGE") for f in fs]
    drop = "UP_DOWN_VOL_RATIO_20D"
    d = spark.createDataFrame([x for x in names if x[0] != drop], "factor string, bucket string")
    assert d.count() == 17
    assert [WF.enumerate_bucketed(d, k).count() for k in (3, 4, 5)] == [340, 1876, 4501]


def test_split_rank_equals_window_rank(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else "cold", f"s{i:04d}", float(rnd.randint(0, 50))) for i in range(3000)]
    d = spark.createDataFrame(rows, "g string, symbol string, v double")
    for avg in (False, True):
        a = {(r.symbol, r.o) for r in ranked(d, "v", "o", ["g"], average=avg).collect()}
        b = {(r.symbol, r.o) for r in ranked(d, "v", "o", ["g"], average=avg, limit=10).collect()}
        assert a == b
    q1 = {r.g: (r.q0, r.q1) for r in quantiles(d, "v", [0.1, 0.77], ["g"]).collect()}
    q2 = {r.g: (r.q0, r.q1) for r in quantiles(d, "v", [0.1, 0.77], ["g"], limit=10).collect()}
    assert all(np.allclose(q1[k], q2[k]) for k in q1)


@pytest.mark.parametrize("kw", [dict(span=5), dict(span=14, min_periods=14), dict(halflife=3, adjust=True), dict(span=2)])
def test_ewm_matches_pandas_with_gaps(spark, kw):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    x[[0, 1, 17, 18, 19, 200]] = np.nan
    adjust = kw.get("adjust", False)
    args = {k: v for k, v in kw.items() if k in ("span", "halflife")}
    want = pd.Series(x).ewm(**args, adjust=adjust, min_periods=kw.get("min_periods", 1)).mean()
    rows = [("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    d = R.ewm_mean(spark.createDataFrame(rows, "symbol string, dt int, x double"), "x", "y", **kw)
    got = {r.dt: r.y for r in d.collect()}
    for i, w in enumerate(want):
        if np.isnan(x[i]):
            continue  # a missing row carries no new value
        assert (got[i] is None and np.isnan(w)) or abs(got[i] - w) < 1e-9


def test_student_t_table_values():
    def p(t, df):
        return betainc(np.array([df / 2]), np.array([0.5]), np.array([df / (df + t * t)]))[0]

    assert abs(p(2.045, 29) - 0.05) < 1e-4
    assert abs(p(12.706, 1) - 0.05) < 1e-4
    assert abs(p(0.0, 5) - 1.0) < 1e-12


def test_benjamini_hochberg_split(spark):
    rnd = random.Random(2)
    rows = [(f"k{i:03d}", round(rnd.random() ** 3, 6)) for i in range(300)]
    d = spark.createDataFrame(rows, "k string, p double")
    a = {r.k: r.q_value for r in M.benjamini_hochberg(d, "p", "k").collect()}
    b = {r.k: r.q_value for r in M.benjamini_hochberg(d, "p", "k", limit=7).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    q, best = {}, 1.0
    for i in range(len(order) - 1, -1, -1):
        best = min(best, order[i][1] * len(order) / (i + 1))
        q[order[i][0]] = best
    assert all(math.isclose(a[k], q[k]) and math.isclose(b[k], q[k]) for k in q)


def test_principal_shares_match_covariance(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 6)) + rng.normal(size=(30, 1))
    rows = [(f"s{j}", i, float(x[i, j])) for i in range(30) for j in range(6)]
    d = Q.principal_shares(spark.createDataFrame(rows, "symbol string, dt int, r double"), 20)
    for r in d.collect():
        w = x[r.dt - 19 : r.dt + 1]
        ev = np.sort(np.linalg.eigvalsh(np.cov(w.T)))[::-1]
        assert abs(r.pc1 - ev[0] / ev.sum()) < 1e-9 and abs(r.pc2 - ev[1] / ev.sum()) < 1e-9


def test_components_and_prune(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0), ("d", 0.5)], "factor string, score double")
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.8), ("c", "d", 0.1)], "a string, b string, corr double")
    assert {(r.factor, r.members) for r in M.prune(s, e).collect()} == {("b", 3), ("d", 1)}


def test_rank_ic_of_flat_group_is_dropped(spark):
    rows = [("f", d, f"s{i}", 1.0 if d == 1 else float(i), float(i)) for d in (1, 2) for i in range(6)]
    ic = Q.rank_ic(spark.createDataFrame(rows, "factor string, dt int, symbol string, value double, r double"), "r")
    assert [(r.dt, r.ic) for r in ic.collect()] == [(2, 1.0)]


def test_good_factor_beats_noise(spark):
    rng = np.random.default_rng(42)
    rows = []
    for d in range(60):
        r = rng.normal(size=20)
        for i in range(20):
            rows += [("good", d, f"s{i}", float(r[i] + rng.normal() * 0.5), float(r[i])), ("noise", d, f"s{i}", float(rng.normal()), float(r[i]))]
    s = Q.summarise(Q.rank_ic(spark.createDataFrame(rows, "factor string, dt int, symbol string, value double, r double"), "r"))
    p = {r.factor: (r.mean_ic, r.p_value) for r in s.collect()}
    assert p["good"][0] > 0.5 and p["good"][1] < 1e-6 and abs(p["noise"][0]) < 0.1


def test_hot_symbol_survives_topk(spark):
    rows = [("d", f"s{i:05d}", float(i % 97)) for i in range(5000)]
    d = spark.createDataFrame(rows, "g string, symbol string, v double")
    got = [(r.symbol, r.pos) for r in S.topk_two_step(d, ["g"], "v", 5, "pos").orderBy("pos").collect()]
    want = sorted(rows, key=lambda r: (-r[2], r[1]))[:5]
    assert got == [(r[1], i + 1) for i, r in enumerate(want)]
