"""Histogram selection against sorted lists."""

import math
import random

import pytest

from rankpanel.functions import selection as S


def interpolated(xs, p):
    xs = sorted(xs)
    at = (len(xs) - 1) * p
    lo, hi = xs[math.floor(at)], xs[math.ceil(at)]
    return lo + (hi - lo) * (at - math.floor(at))


@pytest.fixture(scope="module")
def groups():
    rnd = random.Random(3)
    return {
        "gauss": [rnd.gauss(0, 1) for _ in range(801)], "ties": [rnd.choice([1.0, 2.0, -3.5]) for _ in range(600)], "one": [4.25], "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-300, 300) for _ in range(300)],
        "zeros": [0.0, -0.0, 0.0, -0.0, 5e-324, -5e-324], "same": [7.0] * 900, None: [1.0, 2.0, 4.0], "close": [1.0 + k * 2.0**-52 for k in range(500)],
    }


@pytest.mark.parametrize("few", [1, 40, 10_000])
def test_quantiles(spark, groups, few):
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("gauss", None), ("empty", None)]
    random.Random(1).shuffle(rows)
    probs = (0.0, 0.025, 0.5, 0.9, 1.0)
    got = {r.g: r for r in S.quantiles_of(spark.createDataFrame(rows, "g string, x double").repartition(5), "x", probs, ["g"], few).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g].n == len(xs)
        for i, p in enumerate(probs):
            assert got[g][f"q{i}"] == pytest.approx(interpolated(xs, p), rel=1e-14), (g, p)


def test_one_group(spark):
    xs = [random.Random(i).random() for i in range(500)]
    r = S.quantiles_of(spark.createDataFrame([(x,) for x in xs], "x double"), "x", (0.25, 0.75), (), 20).collect()
    assert len(r) == 1 and (r[0].q0, r[0].q1) == pytest.approx((interpolated(xs, 0.25), interpolated(xs, 0.75)))


def test_order_is_that_of_doubles(spark):
    xs = [float("-inf"), -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, float("inf"), float("nan")]
    keys = [r.k for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", S._ordered("x").alias("k")).orderBy("i").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_no_values(spark):
    assert S.quantiles_of(spark.createDataFrame([(None,)], "x double"), "x", (0.5,)).collect() == []
