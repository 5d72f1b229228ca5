"""Portfolio returns, costs, benchmarks and holdings analysis (P-05..P-12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import compound, ratio
from .paths import hashed

# one-way cost by tier: (domestic, foreign). Fixed values.
COST_TIERS = {"low": (0.0010, 0.0030), "med": (0.0020, 0.0050), "high": (0.0030, 0.0080)}
UNIFORM_COST = 0.0002
# name, starts one bar later, tier (None: uniform). Fixed values.
SCENARIOS = (("COC@2bp", False, None), ("T1_OPEN@2bp", True, None), ("T1_OPEN@low", True, "low"), ("T1_OPEN@med", True, "med"), ("T1_OPEN@high", True, "high"))


def cost_of(foreign: Column, tier: str | None = "med", uniform: float = UNIFORM_COST) -> Column:
    if tier is None:
        return F.lit(uniform)
    home, abroad = COST_TIERS[tier]
    return F.when(foreign, F.lit(abroad)).otherwise(F.lit(home))


def cost_grid(symbols: DataFrame, foreign: Column) -> DataFrame:
    """Cost of every symbol under every scenario."""
    rows = [F.struct(F.lit(n).alias("scenario"), F.lit(t1).alias("t1_open"), cost_of(foreign, tier).alias("cost")) for n, t1, tier in SCENARIOS]
    return symbols.select("symbol", F.explode(F.array(*rows)).alias("s")).select("symbol", "s.*")


def turnover(holdings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Symbols bought or sold at each decision: +1 where held now, -1 where held at the decision before."""
    keys = list(keys)
    periods = holdings.select(*keys, "period").distinct()
    nxt = periods.select(*keys, "period", F.lag("period").over(W.partitionBy(*keys).orderBy("period")).alias("prev"))
    now = holdings.select(*keys, "period", "symbol", F.lit(1).alias("d"))
    before = holdings.select(*keys, F.col("period").alias("prev"), "symbol").join(nxt, [*keys, "prev"]).select(*keys, "period", "symbol", F.lit(-1).alias("d"))
    return now.unionByName(before).groupBy(*keys, "period", "symbol").agg(F.sum("d").alias("d")).where(F.col("d") != 0)


def period_returns(holdings: DataFrame, returns: DataFrame, costs: DataFrame, keys: Sequence[str], k: int, match: Sequence[str] = ()) -> DataFrame:
    """Return of each holding period after costs.

    `returns` holds (period, [match...], symbol, bar, r, exposure, start_exposure): which bars belong
    to a period is an equi key, so the holding-interval join stays a hash join. Per bar the members'
    non-missing returns are averaged and scaled by the exposure; bars compound to the period.
    """
    keys, match = list(keys), list(match)
    d = holdings.select(*keys, "period", "symbol").join(returns, [*match, "period", "symbol"])
    bars = d.groupBy(*keys, "period", "bar").agg(F.avg("r").alias("m"), F.first("exposure").alias("e"))
    gross = bars.groupBy(*keys, "period").agg(F.coalesce(compound(F.col("m") * F.coalesce("e", F.lit(1.0))), F.lit(0.0)).alias("gross"))
    start = returns.groupBy(*match, "period").agg(F.first("start_exposure").alias("start_exposure"))
    cost = turnover(holdings, keys).join(costs, "symbol").groupBy(*keys, "period").agg(F.sum("cost").alias("c"))
    out = gross.join(cost, [*keys, "period"], "left").join(start, [*match, "period"], "left")
    c = F.coalesce("c", F.lit(0.0)) * F.coalesce("start_exposure", F.lit(1.0)) / F.lit(float(k))
    return out.select(*keys, "period", "gross", c.alias("cost"), (F.col("gross") - c).alias("net"))


def equity_stats(periods: DataFrame, keys: Sequence[str], per_year: Column, value: str = "net") -> DataFrame:
    """Total return, Sharpe (population std) and largest drawdown of a period-return series."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    eq = F.exp(F.sum(F.log1p(value)).over(w))
    d = periods.withColumn("eq", eq)
    d = d.withColumn("dd", 1 - F.col("eq") / F.greatest(F.lit(1.0), F.max("eq").over(w)))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"), compound(value).alias("total_return"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"),
        F.greatest(F.max("dd"), F.lit(0.0)).alias("max_drawdown"),
    )
    sharpe = F.when((F.col("periods") >= 2) & (F.col("s") > 1e-12), F.col("m") / F.col("s") * F.sqrt(per_year)).otherwise(F.lit(0.0))
    return g.withColumn("sharpe", sharpe).drop("m", "s")


def equal_weight(returns: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """Daily return of holding everything equally, scaled by the exposure."""
    d = returns.groupBy("dt").agg(F.avg("r").alias("r"))
    if gate is None:
        return d
    return d.join(gate.select("dt", "exposure"), "dt").select("dt", (F.col("r") * F.col("exposure")).alias("r"))


def random_scores(panel: DataFrame, seeds: int) -> DataFrame:
    """Reproducible random scores: an MD5 of (seed, date, symbol), the same on every run and engine."""
    s = F.explode(F.sequence(F.lit(1), F.lit(seeds)))
    d = panel.select("symbol", "dt", "bar", s.alias("seed"))
    text = F.concat_ws(":", F.col("seed"), F.col("dt").cast("string"), F.col("symbol"))
    return d.withColumn("score", hashed(text, F.lit(1000003)) / F.lit(1000003.0))


def stop_breaches(spells: DataFrame, pct: float, keys: Sequence[str]) -> DataFrame:
    """First bar of each holding spell whose low falls below the running high of the spell so far."""
    w = W.partitionBy(*keys, "symbol", "spell").orderBy("dt").rowsBetween(W.unboundedPreceding, -1)
    d = spells.withColumn("peak", F.max("high").over(w)).withColumn("level", F.col("peak") * (1 - pct))
    hit = d.where(F.col("low") < F.col("level"))
    return hit.groupBy(*keys, "symbol", "spell").agg(F.min("dt").alias("breach_dt"), F.min_by("level", "dt").alias("level"), F.min_by("low", "dt").alias("low"))


def spells(holdings_by_bar: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Contiguous holding runs per symbol by row position."""
    w = W.partitionBy(*keys, "symbol").orderBy("bar")
    new = F.coalesce(F.col("bar") - F.lag("bar").over(w) > 1, F.lit(True)).cast("int")
    return holdings_by_bar.withColumn("__n", new).withColumn("spell", F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__n")


def holding_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per decision: common symbols and Jaccard of two strategies' holdings."""
    both = a.select("period", "symbol", F.lit(1).alias("s")).unionByName(b.select("period", "symbol", F.lit(2).alias("s")))
    bits = both.groupBy("period", "symbol").agg(F.sum("s").alias("s"))
    return bits.groupBy("period").agg(
        F.sum((F.col("s") == 3).cast("bigint")).alias("common"), F.count(F.lit(1)).alias("all_symbols"),
        F.avg((F.col("s") == 3).cast("double")).alias("jaccard"),
    )


def target_weights(holdings: DataFrame, strategies: int, k: int, exposure: Column, capital: float, prices: DataFrame) -> DataFrame:
    """Weight = votes over n x k, scaled by exposure; value and whole lots at the latest price."""
    from ..functions.expr import lots

    d = holdings.groupBy("period", "symbol").agg(F.count(F.lit(1)).alias("votes"))
    d = d.join(prices, ["period", "symbol"])
    weight = F.col("votes") / F.lit(float(strategies * k)) * exposure
    d = d.withColumn("weight", weight).withColumn("target_value", F.col("weight") * capital)
    return d.withColumn("shares", lots("target_value", "price").cast("bigint"))


def pool_diagnostics(holdings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How diverse the chosen pools are."""
    per = holdings.groupBy(*keys, "period").agg(F.countDistinct("pool").alias("pools"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("decisions"), F.avg("pools").alias("avg_pools"), F.avg(((F.col("pools") == 1) & (F.col("n") > 1)).cast("double")).alias("same_pool_rate")
    )


