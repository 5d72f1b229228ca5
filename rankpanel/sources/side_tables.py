"""Slow side tables aligned to the trading calendar without look-ahead (S-03..S-07, S-10, S-11, J-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import col
from ..functions.rolling import ffill, running
from .panel import facts, spine, trading_calendar
from .tables import WEEK_DAYS, daily_facts, fx_quotes


def normalise_date(raw) -> Column:
    """20240131, '20240131', '2024-01-31' and timestamps all to DATE; anything else is NULL."""
    s = col(raw).cast("string")
    return F.coalesce(F.try_to_date(s, "yyyyMMdd"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))


def keep_last(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One whole row per key, the newest version; equal versions are settled by the row's content.

    A map-side combined aggregate, so hot keys stay small.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    newest = df.groupBy(*keys).agg(F.max_by(row, F.struct(F.col(version), F.to_json(row))).alias("__row"))
    return newest.select(*keys, *[F.col("__row")[c].alias(c) for c in rest if c != version], F.col("__row")[version].alias(version))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    return keep_last(old.unionByName(new, allowMissingColumns=True), keys, version)


def on_calendar(side: DataFrame, bars: DataFrame, columns: list[str]) -> DataFrame:
    """Reindex a side table to the dates of the bars and carry values forward."""
    return spine(bars).join(side, ["symbol", "dt"], "left").select("symbol", "dt", *[ffill(c).alias(c) for c in columns])


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, columns: list[str]) -> DataFrame:
    """Latest `right` row with right_on <= on, per key: union, then last value over time.

    Right rows sort before left rows of the same time, so a value published on the day counts.
    """
    lcols = [c for c in left.columns if c not in by and c != on]
    l = left.select(*by, F.col(on).alias("__t"), F.lit(1).alias("__side"), *lcols, *[F.lit(None).cast(dict(right.dtypes)[c]).alias(c) for c in columns])
    r = right.select(
        *by, F.col(right_on).alias("__t"), F.lit(0).alias("__side"),
        *[F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in lcols], *columns,
    )
    w = W.partitionBy(*by).orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, 0)
    d = l.unionByName(r)
    d = d.select(*by, "__t", "__side", *lcols, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns])
    return d.where("__side = 1").select(*by, F.col("__t").alias(on), *lcols, *columns)


def shares_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Several records per (symbol, week): the running net quantity as of each day."""
    d = daily_facts(spark, sf, "brand").select("symbol", "day", "net_qty")
    return d.select(
        "symbol", F.to_date(F.date_trunc("week", "day")).alias("dt"), "day", running(F.sum("net_qty"), order="day").alias("fd_share")
    )


def load_shares(spark: SparkSession, sf: str) -> DataFrame:
    return on_calendar(keep_last(shares_raw(spark, sf), ["symbol", "dt"], "day"), facts(spark, sf), ["fd_share"])


MARGIN_FIELDS = ("rzye", "rzmre", "rzche", "rqye", "rqyl", "rqchl", "rqmcl")


def load_margin(spark: SparkSession, sf: str, field: str) -> DataFrame:
    if field not in MARGIN_FIELDS:
        raise ValueError(f"unknown margin field {field!r}")
    d = daily_facts(spark, sf, "brand").select("symbol", F.to_date(F.date_trunc("week", "day")).alias("dt"), "day", field)
    return on_calendar(keep_last(d, ["symbol", "dt"], "day"), facts(spark, sf), [field])


def nav_table(spark: SparkSession, sf: str) -> DataFrame:
    """Net values by the week they describe and the day they were announced (one week later)."""
    return facts(spark, sf).select(
        "symbol", "dt", F.date_add("dt", WEEK_DAYS).alias("ann_dt"), (F.col("nav_value") / F.col("volume")).alias("unit_nav")
    )


def load_nav(spark: SparkSession, sf: str) -> DataFrame:
    bars = facts(spark, sf)
    return asof_join(spine(bars), nav_table(spark, sf), ["symbol"], "dt", "ann_dt", ["unit_nav"]).drop("bar")


def load_fx(spark: SparkSession, sf: str) -> DataFrame:
    """Both quote tables in one frame on the trading calendar, the second scaled per 100 units."""
    q = fx_quotes(spark, sf)
    usd = q.where("pair = 'USD'").select("dt", F.col("quote").alias("usd"))
    hkd = q.where("pair = 'HKD'").select("dt", (F.col("quote") / 100).alias("hkd"))
    both = usd.join(hkd, "dt", "full")
    days = F.array(*[F.lit(d) for d in trading_calendar(facts(spark, sf))])
    cal = spark.range(1).select(F.explode(days).alias("dt"))
    d = cal.join(both, "dt", "left").withColumn("series", F.lit("fx"))
    return d.select("dt", ffill("usd", by="series").alias("usd"), ffill("hkd", by="series").alias("hkd"))


def latest_dates(stored: DataFrame) -> DataFrame:
    return stored.groupBy("symbol").agg(F.max("dt").alias("watermark"))


def newer_than(incoming: DataFrame, watermark: DataFrame) -> DataFrame:
    """Rows past the stored watermark; symbols never stored are new in full."""
    d = incoming.join(watermark, "symbol", "left")
    return d.where(F.col("watermark").isNull() | (F.col("dt") > F.col("watermark")))
