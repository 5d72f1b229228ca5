"""Checks, alignment and set operations on panels (S-12..S-25, J-05..J-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import names_of, ratio

MAX_NULL_RATIO = 0.20
MIN_DATES = 100
MAX_FACTOR_NULL_RATIO = 0.30


def null_ratios(panel: DataFrame, fields: list[str]) -> DataFrame:
    """One aggregate over the table, then one row per field."""
    n = F.count(F.lit(1))
    d = panel.agg(F.countDistinct("dt").alias("n_dates"), *[((n - F.count(c)) / n).alias(c) for c in fields])
    return d.unpivot(["n_dates"], fields, "field", "null_ratio")


def contract(panel: DataFrame, fields: list[str], max_null: float = MAX_NULL_RATIO, min_dates: int = MIN_DATES) -> DataFrame:
    d = null_ratios(panel, fields)
    return d.withColumn("ok", (F.col("null_ratio") <= max_null) & (F.col("n_dates") >= min_dates))


def coverage_summary(panel: DataFrame, field: str = "close") -> DataFrame:
    n = F.count(F.lit(1))
    seen = F.when(F.col(field).isNotNull(), F.col("dt"))
    return panel.groupBy("symbol").agg(
        ((n - F.count(field)) / n).alias("missing_ratio"),
        (F.count(field) / n).alias("coverage"),
        F.min(seen).alias("first_dt"),
        F.max(seen).alias("last_dt"),
    )


def integrity(expected: DataFrame, bars: DataFrame, required: list[str]) -> DataFrame:
    """Expected symbols with record counts and nulls in required columns; absent ones stay visible."""
    nulls = sum((F.col(c).isNull().cast("int") for c in required), F.lit(0))
    found = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("records"), F.sum(nulls).alias("nulls"))
    d = expected.join(found, "symbol", "left").select(
        "symbol", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("nulls", F.lit(0)).alias("nulls")
    )
    return d.withColumn("ok", (F.col("records") > 0) & (F.col("nulls") == 0))


def map_columns(raw: DataFrame) -> DataFrame:
    """Vendor column names to canonical ones; `vol` wins over `volume`."""
    return raw.select(
        F.substring_index("ts_code", ".", 1).alias("symbol"),
        "dt",
        *[F.col(f"adj_{c}").cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.coalesce(F.col("vol").cast("double"), F.col("volume").cast("double")).alias("volume"),
    )


def with_pool(df: DataFrame, pools: DataFrame) -> DataFrame:
    """Pool id by suffix-stripped symbol; -1 where unmapped."""
    key = F.substring_index("ts_code", ".", 1)
    return df.withColumn("symbol", key).join(pools, "symbol", "left").withColumn("pool", F.coalesce("pool", F.lit(-1)))


def domestic_only(df: DataFrame, foreign: DataFrame) -> DataFrame:
    return df.join(foreign, "symbol", "left_anti")


def spans(bars: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows of symbols whose history covers [start, end]."""
    ok = bars.groupBy("symbol").agg(F.min("dt").alias("a"), F.max("dt").alias("b")).where((F.col("a") <= start) & (F.col("b") >= end))
    return bars.join(ok, "symbol", "left_semi")


def add_factors(base: DataFrame, extra: DataFrame, spine: DataFrame) -> DataFrame:
    """Append extra factors: known names are skipped, unknown dates and symbols fall away."""
    fresh = extra.join(base.select("factor").distinct(), "factor", "left_anti").join(spine.select("dt", "symbol"), ["dt", "symbol"], "left_semi")
    return base.unionByName(fresh)


def drift(frozen: DataFrame, actual: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Full outer comparison of two (path, value) tables; rows that differ, are missing or are new."""
    d = frozen.withColumnRenamed("value", "frozen").join(actual.withColumnRenamed("value", "actual"), "path", "full")
    kind = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("frozen").isNull(), "unexpected")
        .when(F.abs(F.col("frozen") - F.col("actual")) > tolerance, "changed")
    )
    return d.withColumn("violation", kind).where("violation is not null")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of two key sets and of their intersection, in one pass over the union."""
    sides = a.select(key).distinct().withColumn("s", F.lit(1)).unionByName(b.select(key).distinct().withColumn("s", F.lit(2)))
    bits = sides.groupBy(key).agg(F.sum("s").alias("s"))
    count = lambda k: F.sum((F.col("s") == k).cast("bigint"))
    d = bits.agg(count(3).alias("both"), count(1).alias("only_a"), count(2).alias("only_b"))
    return d.withColumn("overlap_ratio", ratio(F.col("both"), F.col("both") + F.col("only_a") + F.col("only_b")))


def excludes(df: DataFrame, banned: list[str], pairs: list[tuple[str, str]], column: str = "combo") -> DataFrame:
    """Drop combos holding a banned factor or a banned pair."""
    names = names_of(column)
    bad = F.arrays_overlap(names, F.array(*[F.lit(b) for b in banned])) if banned else F.lit(False)
    for a, b in pairs:
        bad = bad | (F.array_contains(names, a) & F.array_contains(names, b))
    return df.where(~bad)
