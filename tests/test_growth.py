"""Steps whose work must grow no faster than their rows: same results as the plain form, and the shape of the plan."""

import math
import random

from pyspark.sql import functions as F

from rankpanel.functions import ranking as K
from rankpanel.functions import rolling as R
from rankpanel.functions.rolling import ffill
from rankpanel.operators import cross_section as X
from rankpanel.operators import mining as M
from rankpanel.operators import search as SR
from rankpanel.sources import panel as P
from rankpanel.sources.tables import weekly_facts


def plan_of(d):
    return d._jdf.queryExecution().toString().lower()


def test_suffix_minimum_runs_backwards(spark):
    rnd = random.Random(4)
    rows = [(f"k{i:03d}", round(rnd.random() ** 2, 3)) for i in range(200)]
    d = spark.createDataFrame(rows, "k string, p double")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    want, best = {}, 1.0
    for i in range(len(order) - 1, -1, -1):
        best = min(best, order[i][1] * len(order) / (i + 1))
        want[order[i][0]] = best
    for limit in (1000, 9):
        q = M.benjamini_hochberg(d, "p", "k", limit=limit)
        assert "unboundedfollowing" not in plan_of(q)  # such a frame is evaluated anew for every row
        got = {r.k: r.q_value for r in q.collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def ranks(rows, down=False):
    out = {}
    for g in {r[0] for r in rows}:
        v = sorted((r[2] for r in rows if r[0] == g and r[2] is not None), reverse=down, key=lambda x: (math.isnan(x), x))
        at = {}
        for i, x in enumerate(v, 1):
            at.setdefault("nan" if math.isnan(x) else x + 0.0, []).append(i)
        for r in rows:
            if r[0] == g and r[2] is not None:
                p = at["nan" if math.isnan(r[2]) else r[2] + 0.0]
                out[(g, r[1])] = sum(p) / len(p)
    return out


def test_split_average_rank_counts_values(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([1, 2, None]), f"s{i:04d}", rnd.choice([None, 0.0, -0.0, math.nan, 1.5, 2.0, rnd.random()])) for i in range(900)]
    d = spark.createDataFrame(rows, "g int, symbol string, v double")
    for down in (False, True):
        for limit in (0, 10_000):
            got = K.ranked(d, "v", "rank", by=["g"], average=True, descending=down, limit=limit)
            assert {(r.g, r.symbol): r["rank"] for r in got.collect()} == ranks(rows, down)
    whole = K.ranked(d.select(F.lit("x").alias("g"), "symbol", "v"), "v", "rank", average=True, limit=0)
    assert {("x", r.symbol): r["rank"] for r in whole.collect()} == ranks([("x", *r[1:]) for r in rows])


def test_split_average_rank_lays_out_values_only(spark, monkeypatch):
    d = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("symbol"), (F.col("id") % 7).cast("double").alias("v"))
    laid = []
    cut = K.cut_lineage
    monkeypatch.setattr(K, "cut_lineage", lambda x: laid.append(cut(x)) or laid[-1])
    got = K.ranked(d, "v", "rank", by=["g"], average=True, limit=0)
    assert got.count() == 5000 and [x.count() for x in laid] == [7]


def joined(bars, columns):
    """The calendar-aligned panel the long way round: every symbol on every date, joined to its rows."""
    on_spine = P.spine(bars).join(bars, ["symbol", "dt"], "left")
    keep = [c for c in bars.columns if c not in columns and c not in ("symbol", "dt")]
    return on_spine.select("symbol", "dt", "bar", F.col("close").isNotNull().alias("traded"), *[ffill(c).alias(c) for c in columns], *keep)


def test_align_writes_out_gaps(spark):
    rnd = random.Random(8)
    some = lambda x: x if rnd.random() < 0.7 else None
    keys = [(s, f"2024-01-{d:02d}") for s in ("a", "b", "c", "d", None) for d in range(1, 29) if rnd.random() < 0.4 and d != 17]
    keys += [("a", None), ("only", None), ("last", "2024-01-28")]
    rows = [(s, d, some(rnd.random()), some(rnd.random()), some(rnd.randint(1, 9))) for s, d in keys]
    bars = spark.createDataFrame(rows, "symbol string, dt string, close double, volume double, lines int").withColumn("dt", F.to_date("dt"))
    cols = ("close", "volume")
    got, want = P.align(bars, cols), joined(bars, cols)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert P.align(bars.where("false"), cols).count() == 0


def test_supplier_bars_move_lines_once(spark, sf):
    d = weekly_facts(spark, sf, "supplier", side=False)
    assert plan_of(d).split("== physical plan ==")[1].count("exchange ") == 1
    names = [c for c in d.columns]
    full = weekly_facts(spark, sf, "supplier").select(*names)
    assert d.exceptAll(full).count() == 0 and full.exceptAll(d).count() == 0


def test_calibration_does_not_hang_on_partitions(spark):
    rnd = random.Random(12)
    rows = [(f"c{i:02d}", rnd.random(), None if i == 3 else rnd.random()) for i in range(24)]
    d = spark.createDataFrame([(k, a, b, a - 0.5 * (b or 0.0) + 0.1 * rnd.random()) for k, a, b in rows], "combo string, a double, b double, y double")
    seen = []
    for parts in (1, 5):
        fitted, scored = SR.calibrate(d.repartition(parts), "combo", ["a", "b"], "y")
        seen.append((fitted.avgMetrics, sorted((r.combo, r.prediction) for r in scored.collect())))
    (m1, p1), (m2, p2) = seen
    assert all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(m1, m2, strict=True))
    assert all(x[0] == y[0] and math.isclose(x[1], y[1], rel_tol=1e-9) for x, y in zip(p1, p2, strict=True))


def test_bounded_factors_share_one_sort(spark):
    rnd = random.Random(15)
    names = [f"f{i}" for i in range(6)]
    rows = [(d, f"s{j}" if j else None, rnd.random(), *[rnd.choice([None, 1.0, 2.0, 2.0, rnd.random()]) for _ in names]) for d in (1, 2, 3) for j in range(9)]
    rows.append((3, "empty", 0.5, *[None] * len(names)))
    d = spark.createDataFrame(rows, "dt int, symbol string, keep double, " + ", ".join(f"{n} double" for n in names))
    got = X.centred_ranks(d, names)
    want = {}
    for i, n in enumerate(names):
        cells = [(r[0], r[1], r[3 + i]) for r in rows]
        full = {k: sum(c[0] == k and c[2] is not None for c in cells) for k in (1, 2, 3)}
        want |= {(k, s, n): v / full[k] - 0.5 for (k, s), v in ranks(cells).items()}
    assert got.columns == d.columns and got.count() == len(rows)
    for r in got.collect():
        assert all(r[n] == want.get((r.dt, r.symbol, n)) for n in names) and r.keep is not None
    plan = plan_of(X.standardise(d, names, names)).split("== physical plan ==")[1]
    assert plan.count("window [") <= 2 and plan.count("sort [") <= 4
    assert plan_of(d.select(K.pct_rank("f0", "dt"))).split("== physical plan ==")[1].count("sort [") == 1


def test_recursive_average_sorts_twice(spark):
    d = spark.createDataFrame([("a", i, float(i % 7)) for i in range(20)], "symbol string, dt int, x double")
    for adjust in (False, True):
        plan = plan_of(R.ewm_mean(d, "x", "y", span=14, adjust=adjust)).split("== physical plan ==")[1]
        assert plan.count("sort [") == 2
