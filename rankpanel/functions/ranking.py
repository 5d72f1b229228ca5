"""Ranks inside groups (X-05, X-06, J-14) and exact quantiles, with a size check.

Two rank flavours exist on purpose: average ranks (ties share the mean position) and ordinal ranks
(ties broken by a name). Each has a window form for groups of bounded size and a split form for
groups too large for one task. `ranked` checks the largest group and picks one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .expr import col

# rows of one group that a single task sorts without trouble
GROUP_LIMIT = 2_000_000


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


# ---------------------------------------------------------------- window form


def avg_rank(value, by, descending: bool = False) -> Column:
    """Average rank, 1..n over the non-null values of the group."""
    v, by = col(value), _by(by)
    order = v.desc_nulls_last() if descending else v.asc_nulls_last()
    w = W.partitionBy(*by).orderBy(order)
    # first and last position of the value: the count runs to the last row of equal value, in the same sort as the rank
    return F.when(v.isNotNull(), (F.rank().over(w) + F.count(v).over(w)) / F.lit(2.0))


def pct_rank(value, by) -> Column:
    """Average rank over the count of non-null values (not percent_rank, not cume_dist)."""
    v = col(value)
    whole = W.partitionBy(*_by(by)).orderBy(v.asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return avg_rank(value, by) / F.count(v).over(whole)


def ordinal_rank(value, by, tie="symbol", descending: bool = False) -> Column:
    """Position 1..n, ties by name."""
    v = col(value)
    order = v.desc_nulls_last() if descending else v.asc_nulls_last()
    return F.when(v.isNotNull(), F.row_number().over(W.partitionBy(*_by(by)).orderBy(order, col(tie))))


def rank01(value, by, tie="symbol") -> Column:
    """Ordinal ascending position over n-1; missing values take the lowest positions."""
    by = _by(by)
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    pos = F.row_number().over(W.partitionBy(*by).orderBy(col(value).asc_nulls_first(), col(tie)))
    return (pos - 1) / F.when(n > 1, n - 1).otherwise(F.lit(1))


# ---------------------------------------------------------------- split form


def _same(a: str, b: str, columns: Sequence[str]) -> Column:
    return reduce(lambda x, c: x & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), columns, F.lit(True))


def split_positions(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str, parts: int | None = None, weight: str | None = None) -> DataFrame:
    """Row position 1..n inside each group without ever putting a group into one task.

    With `weight`, a row that stands for several: the running total of that column, the row included.

    Rows are range-partitioned on (group, order keys), so a hot group spreads over many partitions.
    The partition number is written to the checkpoint folder together with the rows, which fixes it
    for both uses below: counts per (group, partition) give the offset, and a window inside
    (group, partition) gives the local position.
    """
    by = list(by)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by] + list(order)
    laid = cut_lineage(df.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()))
    rows = F.lit(1) if weight is None else F.col(weight)
    counts = laid.groupBy(*by, "__part").agg(F.sum(rows).alias("__n"))
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    if not by:
        counts = counts.withColumn("__one", F.lit(1))
        before = W.partitionBy("__one").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.sum(rows).over(W.partitionBy(*by, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    d, o = laid.withColumn("__local", local).alias("d"), offsets.alias("o")
    return d.join(o, _same("d", "o", [*by, "__part"])).select(*[F.col(f"d.{c}") for c in df.columns], (F.col("__before") + F.col("__local")).alias(out))


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    by = list(by)
    if not by:
        return df.count()
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def ranked(
    df: DataFrame,
    value: str,
    out: str,
    by: Sequence[str] = (),
    tie: str = "symbol",
    descending: bool = False,
    average: bool = False,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Rank the rows whose `value` is present. Groups above `limit` rows take the split form."""
    by = list(by)
    d = df.where(F.col(value).isNotNull())
    order = F.col(value).desc() if descending else F.col(value).asc()
    if largest_group(d, by) <= limit:
        keys = by or [F.lit(1)]
        w = W.partitionBy(*keys)
        if not average:
            return d.withColumn(out, F.row_number().over(w.orderBy(order, F.col(tie))))
        w = w.orderBy(order)
        return d.withColumn(out, (F.rank().over(w) + F.count(F.lit(1)).over(w)) / F.lit(2.0))
    if not average:
        return split_positions(d, by, [order, F.col(tie).asc()], out)
    # an average rank hangs on how many rows have each value, not on their order: values are counted map-side,
    # their running totals are split, and the rows themselves move at most once, in the join
    ties = d.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__ties"))
    ties = split_positions(ties, by, [order], "__upto", weight="__ties")
    rank = F.col("__upto") - (F.col("__ties") - 1) / F.lit(2.0)
    return d.alias("d").join(ties.alias("t"), _same("d", "t", [*by, value])).select(*[F.col(f"d.{c}") for c in d.columns], rank.alias(out))


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), tie: str = "symbol", limit: int = GROUP_LIMIT) -> DataFrame:
    """Exact, linearly interpolated quantiles per group: columns q0, q1, ..."""
    by = list(by)
    d = df.where(F.col(value).isNotNull())
    if largest_group(d, by) <= limit:
        agg = [F.percentile(value, p).alias(f"q{i}") for i, p in enumerate(probs)]
        return d.groupBy(*by).agg(*agg)
    pos = split_positions(d.select(*by, value, tie), by, [F.col(value).asc(), F.col(tie).asc()], "__pos")
    sizes = d.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    joined = pos.join(sizes, by) if by else pos.crossJoin(F.broadcast(sizes))  # sizes: a single row
    aggs = []
    for i, p in enumerate(probs):
        at = (F.col("__n") - 1) * F.lit(p) + 1
        lo, hi = F.floor(at), F.ceil(at)
        low = F.max(F.when(F.col("__pos") == lo, F.col(value)))
        high = F.max(F.when(F.col("__pos") == hi, F.col(value)))
        frac = F.max(at - lo)
        aggs.append((low + (high - low) * frac).alias(f"q{i}"))
    return joined.groupBy(*by).agg(*aggs)
