"""Path summaries, bootstrap and range scans against plain loops."""

import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from rankpanel.operators import paths as P


def stats_of(rs):
    eq, high, fall = 1.0, 0.0, 0.0
    for r in rs:
        eq *= max(0.0, 1 + r)
        high = max(high, eq)
        fall = min(fall, eq / high - 1 if high else -1.0)
    sd = statistics.stdev(rs) if len(rs) > 1 else None
    annual = eq ** (252 / len(rs)) - 1
    return eq - 1, annual, annual / (sd * math.sqrt(252)) if sd else None, fall


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(6)
    rows = [("a", i, rnd.gauss(0, 0.1)) for i in range(137)] + [("short", i, rnd.gauss(0, 0.1)) for i in range(4)] + [("one", 0, 0.5)]
    rows += [("ruin", i, -1.0 if i == 40 else 0.01) for i in range(60)] + [("gap", i, None if i % 3 else 0.02) for i in range(60)] + [(None, i, 0.01 * (-1) ** i) for i in range(20)]
    return rows


@pytest.mark.parametrize("size", [None, 25, 7])
def test_draws_equal_copied_rows(spark, series, size):
    block, seed = 10, 3
    d = spark.createDataFrame([r for r in series if r[0]], "combo string, dt int, r double")
    got = {(r.combo, r.boot): r for r in P.bootstrap(d, 20, block, seed, size).collect()}
    by: dict = {}
    for c, _, r in series:
        if c and r is not None:
            by.setdefault(c, []).append(r)
    assert len(got) == 20 * len(by)
    for c, rs in by.items():
        n = len(rs)
        length = min(size or n, n)
        for boot in range(1, 21):
            drawn = []
            for blk in range(-(-length // block)):
                h = int(hashlib.md5(f"{seed}:{boot}:{blk}".encode()).hexdigest()[:12], 16)
                start = h % (n if n < block else n - block + 1)
                drawn += [rs[(start + k) % n] for k in range(block)]
            want, r = stats_of(drawn[:length]), got[c, boot]
            assert r.n == length
            assert (r.total_return, r.annual_return, r.max_drawdown) == pytest.approx((want[0], want[1], want[3]), rel=1e-9, abs=1e-9)
            assert r.sharpe is None or want[2] is None or r.sharpe == pytest.approx(want[2], rel=1e-6)


@pytest.mark.parametrize("parts", [1, 9])
def test_running_drawdown_and_falls(spark, series, parts):
    rows = [r for r in series if r[2] is not None]
    d = spark.createDataFrame(rows, "combo string, dt int, r double")
    curve = P.running_drawdown(d, parts=parts)
    got = {(r.combo, r.dt): r for r in curve.collect()}
    by: dict = {}
    for c, t, r in rows:
        by.setdefault(c, []).append((t, r))
    falls = []
    for c, xs in by.items():
        eq, high, peak, no = 1.0, 0.0, None, 0
        open_: list | None = None
        for t, r in sorted(xs):
            eq *= 1 + r
            high = max(high, eq)
            dd = eq / high - 1 if high else -1.0
            g = got[c, t]
            assert (g.eq, g.high, g.dd) == pytest.approx((eq, high, dd), rel=1e-9, abs=1e-9)
            no += 1
            if g.dd >= 0:
                if open_ and open_[1] is not None:
                    falls.append((c, *open_[:5], t, open_[5] - open_[6], no - open_[5]))
                open_ = [t, None, 0.0, None, None, no, no]
                peak = t
            else:
                if open_[1] is None and g.dd < -0.05:
                    open_[1] = t
                if g.dd < open_[2]:
                    open_[2], open_[3], open_[5] = g.dd, t, no
        if open_ and open_[1] is not None:
            falls.append((c, *open_[:5], None, open_[5] - open_[6], None))
        assert peak is not None
    out = P.drawdowns(curve).collect()
    key = lambda r: str(r)
    assert sorted([(r.combo, r.peak, r.below, round(r.depth, 9), r.trough, r.recovery, r.bars_down, r.bars_up) for r in out if r.combo], key=key) == sorted(
        [(c, p, b, round(dp, 9), tr, rec, down, up) for c, p, b, dp, tr, _, rec, down, up in falls if c], key=key
    )
    assert len(out) > 3


@pytest.mark.parametrize("parts", [1, 7])
def test_streaks(spark, parts):
    rnd = random.Random(1)
    kinds = [rnd.choice(["x", "x", "x", "y", None]) for _ in range(300)]
    d = spark.createDataFrame([("k", i, k) for i, k in enumerate(kinds)] + [("m", 5, None)], "g string, t int, kind string")
    got = sorted((r.g, r["first"].t, r.kind, r.length) for r in P.streaks(d, ["g"], ["t"], F.col("kind"), parts).collect())
    want, i = [("m", 5, "", 1)], 0
    while i < 300:
        j = i
        while j < 300 and kinds[j] == kinds[i]:
            j += 1
        want.append(("k", i, kinds[i] or "", j - i))
        i = j
    assert got == sorted(want)


def test_one_series_lies_in_many_ranges(spark):
    d = spark.range(4000).select(F.lit("s").alias("combo"), F.col("id").alias("dt"), F.lit(0.001).alias("r"))
    laid = P.in_ranges(d, ["combo"], ["dt"], 8)
    assert laid.select("__part").distinct().count() >= 6
    out = P.scan(laid, ["combo"], ["dt"], {"n": ("sum", F.lit(1)), "top": ("max", F.col("dt")), "low": ("min", F.col("dt")), "prev": ("last", F.col("dt"))}).collect()
    assert all(r.n == r.dt + 1 and r.top == r.dt and r.low == 0 and r.prev == (r.dt - 1 if r.dt else None) for r in out)


def test_no_rows(spark):
    none = spark.createDataFrame([], "combo string, dt int, r double")
    assert P.bootstrap(none, 5, 10, 1).collect() == []
    assert P.drawdowns(P.running_drawdown(none)).collect() == []
