"""The calendar-aligned panel (S-08, S-09): every symbol on every trading date, values carried forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rolling import running, spread, ts
from .stages import stage
from .tables import pool_of, weekly_facts

PRICES = ("open", "high", "low", "close")
CARRIED = (*PRICES, "volume", "amount")


def trading_calendar(bars: DataFrame) -> list:
    """The sorted trading dates. One entry per period of the whole history: bounded by the calendar."""
    return bars.agg(F.array_sort(F.collect_set("dt")).alias("d")).first()["d"]


def spine(bars: DataFrame) -> DataFrame:
    """(symbol, dt, bar) for every symbol and trading date; `bar` is the row position of the date."""
    days = F.array(*[F.lit(d) for d in trading_calendar(bars)])
    return bars.select("symbol").distinct().select("symbol", F.posexplode(days).alias("bar", "dt"))


def facts(spark: SparkSession, sf_dir: str, kind: str = "brand", side: bool = True) -> DataFrame:
    name = f"facts:{kind}" if side else f"facts:{kind}:bars"
    return stage(spark, sf_dir, name, lambda: weekly_facts(spark, sf_dir, kind, side))


def align(bars: DataFrame, columns=CARRIED) -> DataFrame:
    """Reindex to the calendar, then carry the last known value forward (never back).

    A row stands for every date from its own to the one before its symbol's next row, a symbol's first row also for
    the dates before it, which stay empty. The gaps are written out from the rows, so the calendar of all symbols is never
    shuffled or joined: rows move once, by symbol.
    """
    calendar = trading_calendar(bars)
    days, n = F.array(*[F.lit(d) for d in calendar]).cast("array<date>"), F.lit(len(calendar))
    places = bars.sparkSession.range(1).select(F.posexplode(days).alias("__at", "dt"))
    at, first, keep = F.col("__at"), F.col("__first"), [c for c in bars.columns if c not in columns and c not in ("symbol", "dt")]
    d = spread(bars.join(places, "dt", "left"), "symbol")
    known = F.col("symbol").isNotNull() & at.isNotNull()
    w = ts(order=at.asc_nulls_last())  # a row without a date only tells that there is such a symbol
    d = d.select(
        "symbol", "__at", (F.row_number().over(w) == 1).alias("__first"), F.greatest(F.coalesce(F.lead(at).over(w), n), at + 1).alias("__end"),
        (known & F.col("close").isNotNull()).alias("__traded"),
        *[F.last(F.when(known, F.col(c)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias(c) for c in columns],
        *[F.when(known, F.col(c)).alias(c) for c in keep],
    )
    d = d.withColumn("__from", F.when(first, F.lit(0)).otherwise(at)).where("__from is not null")
    d = d.select("*", F.posexplode(F.slice(days, F.col("__from") + 1, F.col("__end") - F.col("__from"))).alias("__k", "dt"))
    d = d.withColumn("bar", F.col("__from") + F.col("__k"))
    here = F.col("bar") == at
    return d.select(
        "symbol", "dt", "bar", F.coalesce(here & F.col("__traded"), F.lit(False)).alias("traded"),
        *[F.when(F.col("bar") >= at, F.col(c)).alias(c) for c in columns], *[F.when(here, F.col(c)).alias(c) for c in keep],
    )


def panel(spark: SparkSession, sf_dir: str, kind: str = "brand", side: bool = True) -> DataFrame:
    """Panel with prices and volume; `side` adds the cumulative shares outstanding and the weekly side quantities."""

    def build():
        p = align(facts(spark, sf_dir, kind, side))
        if side:
            p = p.withColumn("fd_share", running(F.sum("net_qty")))
            p = p.withColumn("unit_nav", F.col("nav_value") / F.when(F.col("traded"), F.col("volume")))
        return p.withColumn("pool", pool_of("symbol"))

    return stage(spark, sf_dir, f"panel:{kind}" if side else f"panel:{kind}:bars", build)
