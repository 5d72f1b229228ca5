"""Factor mining (M-01..M-15): generate candidates, control false discoveries, prune."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.expr import ALGEBRA, TRANSFORMS, binary, parents_of, ratio, unary
from ..functions.ranking import GROUP_LIMIT, largest_group, pct_rank, split_positions
from ..session import cut_lineage
from .factors import ANNUAL

DIGITS = 10


# ---------------------------------------------------------------- candidates


def algebra_names(left: Sequence[str], right: Sequence[str] | None = None) -> list[tuple[str, str, str, str]]:
    """(name, op, a, b) for every pair and operation; within one list each unordered pair once."""
    pairs = [(a, b) for i, a in enumerate(sorted(left)) for b in sorted(left)[i + 1 :]] if right is None else [(a, b) for a in sorted(left) for b in sorted(right)]
    return [(f"{a}__{op}__{b}", op, a, b) for a, b in pairs for op in ALGEBRA]


def algebra_long(wide: DataFrame, cands: Sequence[tuple[str, str, str, str]], ids: Sequence[str]) -> DataFrame:
    """Candidate values in long form; one projection computes all candidates of a row."""
    cells = F.array(*[F.struct(F.lit(n).alias("factor"), F.round(binary(op, a, b), DIGITS).alias("value")) for n, op, a, b in cands])
    return wide.select(*ids, F.inline(cells)).where("value is not null")


def _average_ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks down the columns; missing values get NaN."""
    n, m = x.shape
    order = np.argsort(np.where(np.isfinite(x), x, np.inf), axis=0, kind="stable")
    s = np.take_along_axis(np.where(np.isfinite(x), x, np.inf), order, axis=0)
    new = np.vstack([np.ones((1, m), bool), s[1:] != s[:-1]])
    pos = np.arange(n)[:, None]
    first = np.maximum.accumulate(np.where(new, pos, 0), axis=0)
    end = np.vstack([new[1:], np.ones((1, m), bool)])
    last = np.minimum.accumulate(np.where(end, pos, n)[::-1], axis=0)[::-1]
    ranks = np.empty_like(x)
    np.put_along_axis(ranks, order, (first + last) / 2.0 + 1.0, axis=0)
    return np.where(np.isfinite(x), ranks, np.nan)


_NP = {
    "add": np.add, "sub": np.subtract, "mul": np.multiply, "max": np.maximum, "min": np.minimum,
    "div": lambda a, b: np.where(b == 0, np.nan, a / np.where(b == 0, 1.0, b)),
}


def algebra_ic_blocks(wide: DataFrame, cands: Sequence[tuple[str, str, str, str]], ret: str, min_rows: int = 5) -> DataFrame:
    """Daily rank correlation of all candidates, one date's cross-section per block.

    Only the base columns travel; the candidates exist inside the task as a matrix (symbols x
    candidates) and leave it as one row each. For cross-sections that fit a task - `algebra_ic`
    checks that and falls back to the relational form.
    """
    bases = sorted({c for _, _, a, b in cands for c in (a, b)})
    at = {c: i for i, c in enumerate(bases)}
    names = np.array([c[0] for c in cands])

    def block(key, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[ret].to_numpy(dtype=float)
        keep = np.isfinite(y)
        base = pdf[bases].to_numpy(dtype=float)[keep]
        y = y[keep][:, None]
        if len(y) < min_rows:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("factor", object), ("dt", object), ("ic", float), ("n", int))})
        with np.errstate(all="ignore"):
            x = np.column_stack([_NP[op](base[:, at[a]], base[:, at[b]]) for _, op, a, b in cands])
            x = np.round(x, DIGITS)
            ok = np.isfinite(x)
            rx = _average_ranks(np.where(ok, x, np.nan))
            ry = _average_ranks(np.where(ok, y, np.nan))
            n = ok.sum(axis=0)
            mean = (n + 1) / 2.0
            a, b = np.where(ok, rx - mean, 0.0), np.where(ok, ry - mean, 0.0)
            aa, bb = (a * a).sum(axis=0), (b * b).sum(axis=0)
            ic = (a * b).sum(axis=0) / np.sqrt(aa * bb)
        good = (n >= min_rows) & (aa > 0) & (bb > 0)
        return pd.DataFrame({"factor": names[good], "dt": pd.Series([key[0]] * int(good.sum()), dtype=object), "ic": np.round(ic[good], 12), "n": n[good]})

    return R.spread(wide.select("dt", ret, *bases), "dt").groupBy("dt").applyInPandas(block, "factor string, dt date, ic double, n bigint")


BLOCK_CELLS = 20_000_000


def algebra_ic(wide: DataFrame, cands: Sequence[tuple[str, str, str, str]], ret: str) -> DataFrame:
    """Size-checked choice between the block form and the relational form."""
    from .quality import rank_ic

    if largest_group(wide, ["dt"]) * len(cands) <= BLOCK_CELLS:
        return algebra_ic_blocks(wide, cands, ret)
    return rank_ic(algebra_long(wide, cands, ["dt", "symbol", ret]), ret)


def valid_rates(long: DataFrame, cells: int) -> DataFrame:
    return long.groupBy("factor").agg((F.count(F.lit(1)) / F.lit(cells)).alias("valid_rate"))


def window_variants(windows: Sequence[int] = (5, 10, 20, 40, 60, 120)) -> dict[str, Column]:
    """Window variants of eight base factors (suffix _V: these formulas differ from the library's).

    Needs close, volume, r, dvol, bar.
    """
    out: dict[str, Column] = {}
    c = F.col("close")
    for n in windows:
        s = R.r_std("r", n)
        hi, lo = R.r_max("close", n), R.r_min("close", n)
        out[f"MOM_{n}D_V"] = ratio("close", R.lag("close", n)) - 1
        out[f"SLOPE_{n}D_V"] = R.r_slope("close", n)
        out[f"RET_VOL_{n}D_V"] = s * ANNUAL**0.5
        out[f"VOL_RATIO_{n}D_V"] = ratio(R.r_mean("volume", n), R.r_mean("volume", 3 * n))
        out[f"PV_CORR_{n}D_V"] = R.r_corr("r", "dvol", n)
        out[f"SHARPE_RATIO_{n}D_V"] = ratio(R.r_mean("r", n) * ANNUAL, s * ANNUAL**0.5)
        out[f"TSMOM_{n}D_V"] = ratio("close", R.lag("close", n)) - 1
        out[f"BREAKOUT_{n}D_V"] = ratio(c - lo, hi - lo)
    return out


def transforms_long(long: DataFrame) -> DataFrame:
    """rank, log1p, sqrt, sign, abs of every factor, named FACTOR__transform."""
    d = long.withColumn("__rank", pct_rank("value", ["factor", "dt"]))
    cells = [F.struct(F.lit("rank").alias("t"), F.col("__rank").alias("v"))] + [F.struct(F.lit(t).alias("t"), unary(t, "value").alias("v")) for t in TRANSFORMS]
    d = d.withColumn("c", F.explode(F.array(*cells)))
    rest = [c for c in long.columns if c not in ("factor", "value")]
    return d.select(*rest, F.concat_ws("__", "factor", "c.t").alias("factor"), F.round("c.v", DIGITS).alias("value"))


# ---------------------------------------------------------------- false discovery control


def benjamini_hochberg(d: DataFrame, p: str, key: str, alpha: float = 0.05, limit: int = GROUP_LIMIT) -> DataFrame:
    """q-values, rejections and Bonferroni p.

    q_i is the smallest p_j n / j over j >= i. Above `limit` rows the order comes from the split
    ranking; the suffix minimum is then taken over blocks of positions first (one row per block) and
    inside each block second, so no task sees all rows. Suffix minima run backwards from the last position:
    a frame that ends at unbounded following is evaluated anew for every row.
    """
    d = d.where(F.col(p).isNotNull())
    n = d.count()
    order = [F.col(p).asc(), F.col(key).asc()]
    back = lambda w: w.orderBy(F.col("__i").desc()).rowsBetween(W.unboundedPreceding, 0)
    if n <= limit:
        r = d.withColumn("__i", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)))
        r = r.withColumn("__raw", F.col(p) * n / F.col("__i"))
        q = F.min("__raw").over(back(W.partitionBy(F.lit(1))))
        r = r.withColumn("q_value", F.least(F.lit(1.0), q))
    else:
        r = split_positions(d, [], order, "__i").withColumn("__raw", F.col(p) * n / F.col("__i"))
        r = r.withColumn("__blk", F.floor(F.col("__i") / F.lit(max(1, min(limit, 500_000)))))
        blocks = r.groupBy("__blk").agg(F.min("__raw").alias("__m"))
        after = W.partitionBy(F.lit(1)).orderBy(F.col("__blk").desc()).rowsBetween(W.unboundedPreceding, -1)
        blocks = blocks.select("__blk", F.min("__m").over(after).alias("__next"))
        inner = F.min("__raw").over(back(W.partitionBy("__blk")))
        r = r.withColumn("__q", inner).join(blocks, "__blk")
        r = r.withColumn("q_value", F.least(F.lit(1.0), F.col("__q"), F.coalesce("__next", F.lit(1.0)))).drop("__blk", "__q", "__next")
    r = r.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col(p) * n)).withColumn("reject", F.col("q_value") <= alpha)
    return r.drop("__i", "__raw")


# ---------------------------------------------------------------- gates, buckets


def gate_cascade(d: DataFrame, gates: Sequence[tuple[str, Column]]) -> DataFrame:
    """Eliminated and remaining per gate, all gates in one pass."""
    ok, aggs, prev = F.lit(True), [], F.count(F.lit(1))
    for i, (name, cond) in enumerate(gates):
        ok = ok & F.coalesce(cond, F.lit(False))
        left = F.sum(F.when(ok, 1).otherwise(0))
        aggs.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("gate"), (prev - left).alias("eliminated"), left.alias("remaining")))
        prev = left
    return d.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def survivors(d: DataFrame, gates: Sequence[tuple[str, Column]]) -> DataFrame:
    for _, cond in gates:
        d = d.where(cond)
    return d


def assign_buckets(names: DataFrame, buckets: DataFrame, column: str = "factor") -> DataFrame:
    """Bucket of each survivor; a derived factor takes the bucket of a parent that holds fewest plain survivors."""
    plain = names.join(buckets, names[column] == buckets["factor"], "inner").select(names[column].alias("name"), "bucket")
    counts = plain.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    derived = names.join(buckets, names[column] == buckets["factor"], "left_anti").select(F.col(column).alias("name"))
    par = derived.select("name", F.explode(parents_of("name")).alias("factor")).join(buckets, "factor").join(counts, "bucket", "left")
    pick = par.groupBy("name").agg(F.min_by("bucket", F.struct(F.coalesce("c", F.lit(0)), F.col("bucket"))).alias("bucket"))
    return plain.unionByName(derived.join(pick, "name", "left"))


def bucket_coverage(assigned: DataFrame, buckets: DataFrame, most: int = 15) -> DataFrame:
    """Survivors per bucket with a warning for missing and crowded buckets."""
    n = assigned.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    d = buckets.select("bucket").distinct().join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    return d.withColumn("warning", F.when(F.col("n") == 0, "missing").when(F.col("n") > most, "over-represented").otherwise(""))


def combo_buckets(combos: DataFrame, buckets: DataFrame, min_buckets: int = 3, max_per_bucket: int = 2) -> DataFrame:
    """Coverage of each combination and whether it meets the limits, with the reason."""
    x = combos.select("combo", F.explode("names").alias("factor")).join(buckets, "factor", "left")
    per = x.where("bucket is not null").groupBy("combo", "bucket").agg(F.count(F.lit(1)).alias("c"))
    g = per.groupBy("combo").agg(F.count(F.lit(1)).alias("n_buckets"), F.max("c").alias("max_in_bucket"))
    reason = F.when(F.col("n_buckets") < min_buckets, "too few buckets").when(F.col("max_in_bucket") > max_per_bucket, "bucket over limit").otherwise("ok")
    return g.withColumn("reason", reason).withColumn("passed", reason == "ok")


def parent_diversity(combos: DataFrame, limit: int = 2) -> DataFrame:
    x = combos.select("combo", F.explode("names").alias("f")).select("combo", F.explode(parents_of("f")).alias("parent"))
    c = x.groupBy("combo", "parent").agg(F.count(F.lit(1)).alias("c"))
    g = c.groupBy("combo").agg(F.max("c").alias("max_parent"))
    return g.withColumn("diverse", F.col("max_parent") <= limit)


# ---------------------------------------------------------------- redundancy


def gram_correlations(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations of many columns: every Arrow batch gives its block of sums, the
    sums are added by pair. Linear in the rows, and only (columns^2) numbers leave a batch."""
    names = list(names)
    k = len(names)

    def sums(batches):
        acc = np.zeros((6, k, k))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            m = np.isfinite(x)
            x0, mf = np.where(m, x, 0.0), m.astype(float)
            acc += np.stack([mf.T @ mf, x0.T @ mf, mf.T @ x0, (x0**2).T @ mf, mf.T @ (x0**2), x0.T @ x0])
        i, j = np.triu_indices(k, 1)
        yield pd.DataFrame({"i": i, "j": j, **{c: acc[q][i, j] for q, c in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))}})

    part = wide.select(*names).mapInPandas(sums, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    g = part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    label = F.array(*[F.lit(n) for n in names])
    d = g.where("n > 1").select(label[F.col("i")].alias("a"), label[F.col("j")].alias("b"), F.try_divide(cov, F.sqrt(F.greatest(vx * vy, F.lit(0.0)))).alias("corr"), F.col("n").cast("bigint").alias("n"))
    return d.where("corr is not null")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components by spreading the smallest label and then following labels of labels, until none moves."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    both = cut_lineage(both)
    lab = cut_lineage(nodes.select("factor", F.col("factor").alias("component")))
    while True:
        near = both.join(lab, both["y"] == lab["factor"]).groupBy("x").agg(F.min("component").alias("m"))
        nxt = lab.join(near, lab["factor"] == near["x"], "left").select("factor", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        hop = nxt.select(F.col("factor").alias("at"), F.col("component").alias("next"))
        nxt = nxt.join(hop, nxt["component"] == hop["at"]).select("factor", F.least("component", "next").alias("component"), "old")
        nxt = cut_lineage(nxt)
        moved = nxt.where("component <> old").limit(1).count()
        lab = nxt.select("factor", "component")
        if moved == 0:
            return lab


def prune(scores: DataFrame, edges: DataFrame, limit: float = 0.7, keep: int | None = None) -> DataFrame:
    """Best-scored factor of every group of correlated factors."""
    comp = components(scores.select("factor"), edges.where(F.abs("corr") > limit))
    d = scores.join(comp, "factor").groupBy("component").agg(
        F.max_by("factor", F.struct(F.col("score"), F.col("factor"))).alias("factor"), F.max("score").alias("score"), F.count(F.lit(1)).alias("members")
    )
    return d.orderBy(F.desc("score"), "factor").limit(keep) if keep else d


# ---------------------------------------------------------------- registry and reports


def register_new(zoo: DataFrame, entries: DataFrame) -> DataFrame:
    """Insert entries whose name is not registered yet."""
    return zoo.unionByName(entries.join(zoo, "name", "left_anti"), allowMissingColumns=True)


def update_quality(zoo: DataFrame, quality: DataFrame) -> DataFrame:
    """Merge-style update of score and passed by name."""
    q = quality.select("name", F.col("score").alias("__s"), F.col("passed").alias("__p"))
    d = zoo.join(q, "name", "left")
    return d.select(*[
        F.coalesce("__s", "score").alias("score") if c == "score" else F.coalesce("__p", "passed").alias("passed") if c == "passed" else F.col(c) for c in zoo.columns
    ])


def factor_frequency(combos: DataFrame, column: str = "combo") -> DataFrame:
    """How often each factor appears."""
    from ..functions.expr import names_of

    return combos.select(F.explode(names_of(column)).alias("factor")).groupBy("factor").agg(F.count(F.lit(1)).alias("n"))


def threshold_table(d: DataFrame, metrics: dict[str, Sequence[float]]) -> DataFrame:
    """Share of factors at or above each threshold, one pass."""
    cells = [F.struct(F.lit(m).alias("metric"), F.lit(float(t)).alias("threshold"), F.sum((F.col(m) >= t).cast("bigint")).alias("passing"), F.count(m).alias("total")) for m, ts in metrics.items() for t in ts]
    return d.agg(F.array(*cells).alias("a")).select(F.inline("a"))
