"""Explicit-schema readers for the input tables and the weekly (symbol, dt) bars made from them.

Bars are made in two hash aggregations, lines to (symbol, day) and days to weeks. Brands are few: their lines
collapse map-side, so a symbol that owns a third of all lines leaves each task as a few thousand daily rows.
Suppliers have a few lines a week, which leaves nothing to collapse: their lines move once, by (supplier, week),
and both aggregations follow in place; a supplier that owns a third of all lines is spread over its weeks. Sums of cents are rounded to cents, so both the prices and everything after
them start from the same doubles whatever the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEEK_DAYS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool_of(symbol) -> Column:
    """Pool 0..4 from the digits that end a symbol; -1 when there are none."""
    digits = F.regexp_extract(F.col(symbol) if isinstance(symbol, str) else symbol, r"(\d+)$", 1)
    return F.when(digits != "", digits.cast("int") % 5).otherwise(F.lit(-1))


FOREIGN_POOL = 4


def order_lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Order lines with their symbol: the brand of the part, or the number of the supplier."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    if kind == "supplier":
        return li.withColumn("symbol", F.col("l_suppkey")).withColumn("p_retailprice", F.lit(None).cast("double"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"), "p_retailprice")
    # no hint: `part` grows with the data; AQE broadcasts it only below its size threshold and
    # splits hot part keys in the sort-merge join otherwise
    return li.join(part, li.l_partkey == part.p_partkey)


def daily_facts(spark: SparkSession, sf_dir: str, kind: str, side: bool = True) -> DataFrame:
    """One row per (symbol, day), with its week `dt`; `side` adds the side quantities."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    ep, q = F.col("l_extendedprice"), F.col("l_quantity")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")

    def total(x, cond=None):
        return F.sum(F.when(cond, x).otherwise(F.lit(0.0)) if cond is not None else x)

    facts = [
        F.round(F.sum(ep), 2).alias("amount"),
        F.sum(q).alias("volume"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
    ]
    if side:
        facts += [
            F.count(F.lit(1)).alias("lines"),
            total(F.when(flag == "R", -q).otherwise(q)).alias("net_qty"),
            F.round(total(F.col("l_discount") * ep), 4).alias("rzye"),
            F.round(total(F.col("l_discount") * ep, status == "O"), 4).alias("rzmre"),
            F.round(total(F.col("l_discount") * ep, status == "F"), 4).alias("rzche"),
            F.round(total(F.col("l_tax") * ep), 4).alias("rqye"),
            total(q, flag == "R").alias("rqyl"),
            total(q, flag == "A").alias("rqchl"),
            total(q, (flag == "R") & (status == "F")).alias("rqmcl"),
            F.round(F.sum(F.col("p_retailprice") * q), 2).alias("nav_value"),
        ]
    day = F.to_date("l_shipdate")
    used = ("l_quantity", "l_extendedprice") + (("l_discount", "l_tax", "l_returnflag", "l_linestatus", "p_retailprice") if side else ())
    lines = order_lines(spark, sf_dir, kind).where(q > 0).select("symbol", day.alias("day"), F.to_date(F.date_trunc("week", day)).alias("dt"), *used)
    if kind == "supplier":
        lines = lines.repartition("symbol", "dt")
    return lines.groupBy("symbol", "dt", "day").agg(*facts)


SUMMED = ("amount", "volume", "net_qty", "rzye", "rzmre", "rzche", "rqye", "rqyl", "rqchl", "rqmcl", "nav_value")


def weekly_facts(spark: SparkSession, sf_dir: str, kind: str, side: bool = True) -> DataFrame:
    """One row per traded (symbol, week): prices, volume, amount and, with `side`, the raw side quantities."""
    d = daily_facts(spark, sf_dir, kind, side)
    vwap = F.col("amount") / F.col("volume")
    d = d.groupBy("symbol", "dt").agg(
        F.min_by(vwap, "day").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by(vwap, "day").alias("close"),
        *([F.sum("lines").alias("lines")] if side else []),
        *[F.round(F.sum(c), 4).alias(c) for c in SUMMED if c in d.columns],
    )
    return d.withColumn("symbol", F.format_string("S%09d", "symbol")) if kind == "supplier" else d


def fx_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weekly quote series; the second is quoted per 100 units."""
    o = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderdate", "o_orderpriority")
    pair = F.when(F.col("o_orderpriority") == "1-URGENT", "USD").when(F.col("o_orderpriority") == "2-HIGH", "HKD")
    return (
        o.select(pair.alias("pair"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("dt"), "o_totalprice")
        .where("pair is not null")
        .groupBy("pair", "dt")
        .agg((F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1)) / 1000.0).alias("quote"))
    )
