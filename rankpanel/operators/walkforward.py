"""Walk-forward windows and combination scoring (C-01..C-13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import spread


def n_windows(bars: int, is_len: int, oos_len: int, step: int) -> int:
    return max(0, (bars - is_len - oos_len) // step + 1)


def explode_windows(d: DataFrame, is_len: int, oos_len: int, step: int, bar: str = "bar") -> DataFrame:
    """Adds (win, part): every row once per window that covers its bar.

    The window ids of a bar are an arithmetic range, so no range join is needed.
    """
    bars = d.agg((F.max(bar) + 1).alias("t")).first()["t"]  # one number
    windows = n_windows(bars, is_len, oos_len, step)
    b = F.col(bar)
    first = F.greatest(F.lit(0), F.ceil((b - (is_len + oos_len) + 1) / F.lit(step)).cast("int"))
    last = F.least(F.lit(windows - 1), F.floor(b / F.lit(step)).cast("int"))
    d = d.where(first <= last).withColumn("win", F.explode(F.sequence(first, last)))
    return d.withColumn("part", F.when(b < F.col("win") * step + is_len, "is").otherwise("oos"))


# ---------------------------------------------------------------- enumeration


def enumerate_combos(factors: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """All combinations of the given sizes: (combo, names, size). Grown one larger name at a time."""
    f = factors.select(F.col("factor").alias("f"))
    cur = f.select(F.array("f").alias("names"))
    out = None
    for size in range(1, max(sizes) + 1):
        if size > 1:
            cur = cur.join(f, F.col("f") > F.element_at("names", -1)).select(F.concat("names", F.array("f")).alias("names"))
        if size in sizes:
            level = cur.select(F.array_join("names", " + ").alias("combo"), "names", F.lit(size).alias("size"))
            out = level if out is None else out.unionByName(level)
    return out


def enumerate_bucketed(buckets: DataFrame, size: int, min_buckets: int = 3, max_per_bucket: int = 2) -> DataFrame:
    """Combinations under bucket limits, pruned while they grow.

    A partial combination is dropped as soon as a bucket is over its limit, or when the picks that are
    left cannot reach the required number of buckets.
    """
    need = min(size, min_buckets)
    f = buckets.select(F.col("factor").alias("f"), F.col("bucket").alias("b"))
    cur = f.select(F.array("f").alias("names"), F.array("b").alias("bks"))
    for level in range(2, size + 1):
        room = F.size(F.filter("bks", lambda x: x == F.col("b"))) < max_per_bucket
        cur = cur.join(f, (F.col("f") > F.element_at("names", -1)) & room)
        cur = cur.select(F.concat("names", F.array("f")).alias("names"), F.concat("bks", F.array("b")).alias("bks"))
        cur = cur.where(F.size(F.array_distinct("bks")) + (size - level) >= need)
    cur = cur.where(F.size(F.array_distinct("bks")) >= need)
    return cur.select(F.array_join("names", " + ").alias("combo"), "names", F.lit(size).alias("size"), F.size(F.array_distinct("bks")).alias("n_buckets"))


# ---------------------------------------------------------------- schedule tables


def window_table(spark, bars: int, is_len: int, oos_len: int, step: int) -> DataFrame:
    w = spark.range(n_windows(bars, is_len, oos_len, step)).select(F.col("id").cast("int").alias("win"))
    a = F.col("win") * step
    return w.select("win", a.alias("is_start"), (a + is_len).alias("is_end"), (a + is_len).alias("oos_start"), (a + is_len + oos_len).alias("oos_end"))


def decision_table(windows: DataFrame, freqs: Sequence[int], with_is: bool = False) -> DataFrame:
    """(win, freq, period, sig_bar, start_bar, end_bar, oos): one row per rebalance.

    Decisions fall on multiples of freq counted from the start of the evaluated stretch; the score row
    is the bar before; a stretch shorter than two bars is skipped.
    """
    base = F.col("is_start") if with_is else F.col("oos_start")
    length = F.col("oos_end") - base
    d = windows.withColumn("freq", F.explode(F.array(*[F.lit(f) for f in freqs])))
    d = d.withColumn("period", F.explode(F.sequence(F.lit(1), F.floor((length - 1) / F.col("freq")).cast("int"))))
    start = F.col("period") * F.col("freq")
    end = F.least(start + F.col("freq"), length)
    d = d.where((start < length) & (end - start >= 2))
    return d.select("win", "freq", "period", (base + start - 1).alias("sig_bar"), (base + start).alias("start_bar"), (base + end).alias("end_bar"), (base + start >= F.col("oos_start")).alias("oos"))


def period_bars(decisions: DataFrame) -> DataFrame:
    """The bars of every holding period."""
    return decisions.select("win", "freq", "period", "start_bar", "oos", F.explode(F.sequence("start_bar", F.col("end_bar") - 1)).alias("bar"))


# ---------------------------------------------------------------- statistics


def is_statistics(long: DataFrame, is_len: int, oos_len: int, step: int) -> DataFrame:
    """In-sample mean ordinal rank correlation per (win, factor), shared by all combinations.

    The daily statistic does not depend on the window, so it is computed once per date and then
    averaged over the windows that cover the date.
    """
    from .quality import ordinal_ic

    daily = ordinal_ic(long, "r", ("factor", "bar"))
    d = explode_windows(daily, is_len, oos_len, step).where("part = 'is'")
    return d.groupBy("win", "factor").agg(F.avg("ic").alias("ic"))


def combo_weights(combos: DataFrame, stats: DataFrame) -> DataFrame:
    """|IC| weights normalised inside each (combo, win); sign of the IC with a dead zone of 0.01."""
    from pyspark.sql import Window as W

    d = combos.select("combo", "size", F.explode("names").alias("factor")).join(stats, "factor")
    w = W.partitionBy("combo", "win")
    tot = F.sum(F.abs("ic")).over(w)
    weight = F.when(tot > 0, F.abs("ic") / tot).otherwise(1.0 / F.col("size"))
    sign = F.when((F.abs("ic") < 0.01) | (F.col("ic") >= 0), F.lit(1.0)).otherwise(F.lit(-1.0))
    return d.select("combo", "size", "win", "factor", "ic", weight.alias("weight"), sign.alias("sign"))


def combo_signals(weights: DataFrame, long: DataFrame, rows: DataFrame) -> DataFrame:
    """Signal of each combination on the score rows only: weighted mean over the factors present."""
    z = long.select("factor", F.col("bar").alias("sig_bar"), "symbol", "value").join(rows.select("win", "sig_bar").distinct(), "sig_bar")
    d = z.join(weights.select("combo", "win", "factor", "weight", "sign"), ["win", "factor"])
    g = d.groupBy("combo", "win", "sig_bar", "symbol").agg(F.sum(F.col("weight") * F.col("sign") * F.col("value")).alias("n"), F.sum("weight").alias("d"))
    # weights are at most 1 and scores of order 1: 12 digits make ties the same on every plan
    return g.where("d > 0").select("combo", "win", "sig_bar", "symbol", F.round(F.col("n") / F.col("d"), 12).alias("signal"))


def period_compound(panel: DataFrame, decisions: DataFrame) -> DataFrame:
    """Compounded return of every symbol over every holding period; missing bars count as 0."""
    d = period_bars(decisions).join(panel.select("symbol", "bar", "r"), "bar")
    g = d.groupBy("win", "freq", "period", "symbol").agg((F.exp(F.coalesce(F.sum(F.log1p("r")), F.lit(0.0))) - 1).alias("c"))
    return g.withColumn("c", F.round("c", 12))


def rebalanced_ic(signals: DataFrame, decisions: DataFrame, compounded: DataFrame) -> DataFrame:
    """Out-of-sample rank statistic per (combo, win, freq): mean, IR (population std) and positive rate."""
    from .quality import ordinal_ic

    d = signals.join(decisions.select("win", "freq", "period", "sig_bar"), ["win", "sig_bar"]).join(compounded, ["win", "freq", "period", "symbol"])
    ic = ordinal_ic(d, "c", ("combo", "win", "freq", "period"), 3, "signal")
    g = ic.groupBy("combo", "win", "freq").agg(
        F.avg("ic").alias("mean_ic"), F.stddev_pop("ic").alias("s"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_rate"), F.count(F.lit(1)).alias("n_periods")
    )
    ir = F.when(F.col("s") > 1e-12, F.col("mean_ic") / F.col("s")).otherwise(F.lit(0.0))
    return g.select("combo", "win", "freq", "mean_ic", ir.alias("ir"), "positive_rate", "n_periods")


def best_frequency(ic: DataFrame) -> DataFrame:
    """Frequency with the highest mean; ties go to the smallest frequency."""
    key = F.struct(F.round("mean_ic", 10), -F.col("freq"))
    return ic.groupBy("combo", "win").agg(*[F.max_by(c, key).alias(c) for c in ("freq", "mean_ic", "ir", "positive_rate")])


def matrix_ic(combos: DataFrame, weights: DataFrame, long: DataFrame, decisions: DataFrame, compounded: DataFrame, names: Sequence[str], chunk: int = 400) -> DataFrame:
    """The same statistic by Arrow blocks: a task scores `chunk` combinations on one window as a matrix product.

    For universes whose window (score rows x symbols x factors) fits a task; `rebalanced_ic` is the
    relational form for any universe. Both give the same numbers.
    """
    import numpy as np
    import pandas as pd

    names = list(names)
    pos = {n: i for i, n in enumerate(names)}
    total = combos.count()
    chunks = max(1, -(-total // chunk))
    w = weights.select("combo", "win", "factor", (F.col("weight")).alias("weight"), "sign")
    w = w.groupBy("combo", "win").agg(F.collect_list(F.struct("factor", "weight", "sign")).alias("f"))
    w = w.withColumn("chunk", F.pmod(F.xxhash64("combo"), F.lit(chunks)).cast("int"))
    z = long.where(F.col("factor").isin(names)).select("factor", F.col("bar").alias("sig_bar"), "symbol", "value")
    rows = z.join(decisions.select("win", "freq", "period", "sig_bar"), "sig_bar").groupBy("win", "freq", "period", "symbol").pivot("factor", names).agg(F.first("value"))
    rows = rows.join(compounded, ["win", "freq", "period", "symbol"])
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["combo", "win", "freq", "mean_ic", "ir", "positive_rate", "n_periods"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=cols)
        wt, sg = np.zeros((len(names), len(left))), np.zeros((len(names), len(left)))
        for j, items in enumerate(left["f"]):
            for it in items:
                wt[pos[it["factor"]], j], sg[pos[it["factor"]], j] = it["weight"], it["sign"]
        out = []
        for freq, by_freq in right.groupby("freq"):
            ics = []
            for _, g in by_freq.groupby("period"):
                g = g.sort_values("symbol")
                v = g[names].to_numpy(dtype=float)
                ok = np.isfinite(v)
                den = ok.astype(float) @ wt
                with np.errstate(all="ignore"):
                    sig = np.round((np.where(ok, v, 0.0) @ (wt * sg)) / den, 12)
                sig = np.where(den > 0, sig, np.nan)
                ret = g["c"].to_numpy(dtype=float)
                valid = np.isfinite(sig) & np.isfinite(ret)[:, None]
                # missing signals sort last and are masked out of both rank sums
                sr = np.argsort(np.argsort(np.where(valid, sig, np.inf), axis=0, kind="stable"), axis=0, kind="stable").astype(float)
                rr = np.argsort(np.argsort(np.where(valid, ret[:, None], np.inf), axis=0, kind="stable"), axis=0, kind="stable").astype(float)
                n = valid.sum(axis=0)
                mean = (n - 1) / 2.0
                a, b = np.where(valid, sr - mean, 0.0), np.where(valid, rr - mean, 0.0)
                with np.errstate(all="ignore"):
                    ic = (a * b).sum(axis=0) / np.sqrt((a * a).sum(axis=0) * (b * b).sum(axis=0))
                ics.append(np.where(n > 2, np.round(ic, 12), np.nan))
            m = np.vstack(ics)
            seen = np.isfinite(m)
            cnt = seen.sum(axis=0)
            with np.errstate(all="ignore"):
                avg = np.where(seen, m, 0.0).sum(axis=0) / cnt
                sd = np.sqrt(np.where(seen, (m - avg) ** 2, 0.0).sum(axis=0) / cnt)
                ir = np.where(sd > 1e-12, avg / sd, 0.0)
                pr = ((m > 0) & seen).sum(axis=0) / cnt
            res = pd.DataFrame({"combo": left["combo"].to_numpy(), "win": key[0], "freq": freq, "mean_ic": avg, "ir": ir, "positive_rate": pr, "n_periods": cnt})
            out.append(res[cnt > 0])
        return pd.concat(out)[cols]

    schema = "combo string, win int, freq int, mean_ic double, ir double, positive_rate double, n_periods bigint"
    return spread(w, "win", "chunk").groupBy("win", "chunk").cogroup(spread(rows, "win", "chunk").groupBy("win", "chunk")).applyInPandas(score, schema)


# ---------------------------------------------------------------- collapse


def consensus(weights: DataFrame) -> DataFrame:
    """Per (combo, factor): direction if at least 80 % of the windows agree (else +1), its stability, and the ICIR."""
    g = weights.groupBy("combo", "factor").agg(
        F.avg("ic").alias("m"), F.greatest(F.coalesce(F.stddev_samp("ic"), F.lit(0.0)), F.lit(0.01)).alias("s"), F.abs(F.avg(F.signum("ic"))).alias("sign_stability")
    )
    sign = F.when(F.col("sign_stability") < 0.8, 1).when(F.col("m") < 0, -1).otherwise(1)
    return g.select("combo", "factor", sign.alias("consensus_sign"), "sign_stability", (F.col("m") / F.col("s")).alias("icir"))


def collapse(best: DataFrame, perf: DataFrame | None, penalty: float = 0.01) -> DataFrame:
    """One row per combination from its windows, with the stability score."""
    d = best if perf is None else best.join(perf, ["combo", "win"])
    agg = [
        F.count(F.lit(1)).alias("windows"), F.avg("mean_ic").alias("mean_oos_ic"), F.stddev_pop("mean_ic").alias("oos_ic_std"),
        F.stddev_samp("mean_ic").alias("s1"), F.avg("ir").alias("mean_oos_ir"), F.avg("positive_rate").alias("mean_positive_rate"),
    ]
    if perf is not None:
        agg += [
            F.avg("total_return").alias("mean_oos_return"), (F.exp(F.sum(F.log1p("total_return"))) - 1).alias("cum_oos_return"),
            F.avg("sharpe").alias("mean_oos_sharpe"), F.avg("max_drawdown").alias("mean_oos_maxdd"),
        ]
    g = d.groupBy("combo").agg(*agg)
    votes = best.groupBy("combo", "freq").agg(F.count(F.lit(1)).alias("c"), F.min("win").alias("w"))
    mode = votes.groupBy("combo").agg(F.max_by("freq", F.struct("c", -F.col("w"))).alias("best_freq"))
    g = g.join(mode, "combo").withColumn("size", F.size(F.split("combo", r" \+ ")))
    score = 0.5 * F.col("mean_oos_ic") + 0.3 * F.col("mean_oos_ir") + 0.2 * F.col("mean_positive_rate") - 0.1 * F.col("oos_ic_std") - penalty * F.col("size")
    return g.withColumn("stability_score", score)
