"""Exact quantiles by histogram selection: no sort of a group, no buffer of its values (X-02, X-04, X-22).

Doubles become longs that order alike. Counts per group and leading bits, combined before the shuffle, tell in
which bucket each wanted position lies; only rows of those buckets are counted again by their next bits, until the
buckets that are left hold few rows, which are numbered. A group of any size takes this one path: what
leaves a task for one group is at most BUCKETS counts in a round.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..session import cut_lineage

BITS = 12
BUCKETS = 1 << BITS
FEW = 10_000  # rows of one bucket that a task may number
_SIGN = np.int64(-(1 << 63))


@F.pandas_udf(LongType())
def _ordered(v: pd.Series) -> pd.Series:
    bits = (v.to_numpy(np.float64) + 0.0).view(np.int64)  # + 0.0: both zeros are one value
    return pd.Series(np.where(bits < 0, ~bits ^ _SIGN, bits))


@F.pandas_udf(DoubleType())
def _value(k: pd.Series) -> pd.Series:
    bits = k.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, ~(bits ^ _SIGN), bits).view(np.float64))


def _same(a: str, b: str, columns: Sequence[str]) -> Column:
    return reduce(lambda x, c: x & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), columns, F.lit(True))


def selected(d: DataFrame, by: Sequence[str], wanted: DataFrame, few: int = FEW) -> DataFrame:
    """(by, place, key) of the rows at 0-based places: `d` has by and `key` (a long), `wanted` by and `place`."""
    by = list(by)
    d = d.select(*by, "key", F.lit(0).cast("long").alias("bucket"))
    targets = wanted.select(*by, "place", F.col("place").alias("left"), F.lit(0).cast("long").alias("bucket"))
    done = None
    for shift in [*range(64 - BITS, -1, -BITS), 0]:
        # counts of the rows that are still in question, by their bits down to `shift`
        d = d.withColumn("next", F.shiftright("key", shift))
        counts = d.groupBy(*by, "bucket", "next").agg(F.count(F.lit(1)).alias("n"))
        upto = W.partitionBy(*by, "bucket").orderBy("next").rowsBetween(W.unboundedPreceding, 0)  # BUCKETS rows at most
        counts = counts.withColumn("upto", F.sum("n").over(upto))
        t, c = targets.alias("t"), counts.alias("c")
        hit = _same("t", "c", [*by, "bucket"]) & (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n"))
        targets = cut_lineage(t.join(c, hit).select(*[F.col(f"t.{x}") for x in by], "place", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.col("c.next").alias("bucket"), "n"))
        whole = F.lit(shift == 0)
        open_ = targets.where(~whole & (F.col("n") > few))
        ready = targets.where(whole | (F.col("n") <= few))
        d, rows = cut_lineage(d.drop("bucket").withColumnRenamed("next", "bucket")) if shift else d.drop("bucket").withColumnRenamed("next", "bucket"), ready
        if shift:
            r = d.alias("r").join(ready.select(*by, "bucket").distinct().alias("q"), _same("r", "q", [*by, "bucket"]), "left_semi")
            order = W.partitionBy(*by, "bucket").orderBy("key")  # at most `few` rows
            r = r.withColumn("left", (F.row_number().over(order) - 1).cast("long"))
            rows = ready.alias("t").join(r.alias("r"), _same("t", "r", [*by, "bucket", "left"])).select(*[F.col(f"t.{x}") for x in by], "place", "key")
        else:
            rows = ready.select(*by, "place", F.col("bucket").alias("key"))
        rows = cut_lineage(rows)
        done = rows if done is None else done.unionByName(rows)
        if not shift or open_.isEmpty():
            return done
        targets = open_.select(*by, "place", "left", "bucket")
        d = cut_lineage(d.alias("r").join(targets.select(*by, "bucket").distinct().alias("q"), _same("r", "q", [*by, "bucket"]), "left_semi"))
    return done


def quantiles_of(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), few: int = FEW) -> DataFrame:
    """Linearly interpolated quantiles of the non-null values of every group: by, n, q0, q1, ... NaN counts as largest."""
    by = list(by)
    d = cut_lineage(df.where(F.col(value).isNotNull()).select(*by, _ordered(F.col(value).cast("double")).alias("key")))
    sizes = cut_lineage(d.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 0"))
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    places = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
    rows = selected(d, by, sizes.select(*by, F.explode(places).alias("place")), few).withColumn("v", _value("key"))
    found = rows.alias("r").join(sizes.alias("s"), _same("r", "s", by)).select(*[F.col(f"s.{x}") for x in by], "n", "place", "v")
    out = []
    for i, x in enumerate(at):
        low, high = F.max(F.when(F.col("place") == F.floor(x), F.col("v"))), F.max(F.when(F.col("place") == F.ceil(x), F.col("v")))
        out.append((low + (high - low) * F.max(x - F.floor(x))).alias(f"q{i}"))
    return found.groupBy(*by, "n").agg(*out)
