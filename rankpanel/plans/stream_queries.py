"""ST-01..ST-08 over the events table and over the candidates of the stateful selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as S
from ..oracle.base import PANEL
from ..oracle.holding import hysteresis
from ..oracle.research import LONG, t_two_sided as sql_t
from ..sources.io import scratch_path
from ..sources.stages import stage
from ..sources.tables import table
from ..streaming import bars as SB
from ..streaming import portfolio as SP
from .cross_section_queries import CW
from .portfolio_queries import DELTA, FREQ, K, MIN_DAYS, SC, scores
from .registry import query, rounded

_DAY = "CAST(ts AS DATE)"


def arrivals(spark, sf):
    return SB.slices(table(spark, sf, "events"), "ts")


@query("st_01_incremental_intake", f"SELECT event_type, {_DAY} AS dt, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st01(spark, sf):
    d = SB.intake(spark, arrivals(spark, sf), scratch_path(spark, "intake"))
    return d.groupBy("event_type", F.to_date("ts").alias("dt")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("st_02_newest_wins", "SELECT user_id, event_type, max(ts) AS ts, arg_max(value, ts) AS value, arg_max(event_id, ts) AS event_id FROM events GROUP BY ALL".replace("max(ts) AS ts", "epoch_us(max(ts)) AS ts_us"))
def st02(spark, sf):
    d = SB.upsert_stream(spark, arrivals(spark, sf), scratch_path(spark, "upsert"), ["user_id", "event_type"], "ts")
    return d.select("user_id", "event_type", F.unix_micros("ts").alias("ts_us"), "value", "event_id")


@query("st_03_daily_bars", f"SELECT {_DAY} AS dt, event_type AS symbol, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, round(sum(value), 4) AS volume, count(*) AS n FROM events GROUP BY ALL")
def st03(spark, sf):
    return SB.stream_bars(spark, arrivals(spark, sf), scratch_path(spark, "bars"))


def candidates(spark, sf, kinds=("live",)):
    """Candidate rows of every decision, only symbols that ever reach the top."""

    def build():
        c = S.ranked_candidates(scores(spark, sf), ["combo", "period"])
        ever = c.where(F.col("pos") <= K).select("combo", "symbol").distinct()
        return c.join(ever, ["combo", "symbol"], "left_semi").select("combo", "period", "symbol", "pos", "r01", "n_valid")

    return stage(spark, sf, "stream_candidates", build).withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))


def processor(version="1"):
    return SP.PortfolioProcessor(K, FREQ, DELTA, MIN_DAYS, version)


def feed(spark, parts, versions):
    """Land each part, then run; the state carries over. One processor version per part."""
    root = scratch_path(spark, "portfolio")
    for part, v in zip(parts, versions):
        part.write.mode("append").parquet(f"{root}/in")
        SP.run_portfolio(spark, f"{root}/in", part.schema, root, processor(v))
    return SP.read_log(spark, root)


_HELD = f"WITH RECURSIVE {LONG}, {CW}, {SC}, {hysteresis('sr', 'combo', K, str(FREQ), [(DELTA, MIN_DAYS)])}"


@query("st_04_stateful_portfolio", f"{_HELD} SELECT combo, period, symbol, hold_days FROM hy")
def st04(spark, sf):
    return feed(spark, SB.slices(candidates(spark, sf), "period", 3), "111").select("combo", "period", "symbol", "hold_days")


@query("st_05_state_validation")
def st05(spark, sf):
    log = feed(spark, SB.slices(candidates(spark, sf), "period", 2), "12")
    n = log.where("note = ''").groupBy("combo").agg(F.concat(F.lit("decisions "), F.countDistinct("period").cast("string")).alias("note"))
    return log.where("note like 'cold start%'").select("combo", "note").unionByName(n)


@query("st_06_elapsed_hold_days")
def st06(spark, sf):
    """The second run skips five decisions: hold days must still count the bars that passed."""
    a, b = SB.slices(candidates(spark, sf), "period", 2)
    mid = a.agg(F.max("period")).first()[0]
    return feed(spark, [a, b.where(F.col("period") > mid + 5)], "11").where("note = ''").select("combo", "period", "symbol", "hold_days")


@query("st_07_shadow_strategies", f"{_HELD} SELECT kind, combo, period, symbol, hold_days FROM hy, (VALUES ('live'), ('shadow')) v(kind)")
def st07(spark, sf):
    log = feed(spark, SB.slices(candidates(spark, sf, ("live", "shadow")), "period", 2), "11")
    return log.select("kind", "combo", "period", "symbol", "hold_days")


@query("st_08_late_rows", f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def st08(spark, sf):
    """Rows split into on-time and late while streaming; together they are the whole input."""
    ontime, late = SB.split_late(spark, arrivals(spark, sf), scratch_path(spark, "late"))
    d = spark.read.parquet(ontime).unionByName(spark.read.parquet(late))
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


_HELD_BACK = "ts < TIMESTAMP '2024-01-16' AND event_id % 7 = 0"


def late_arrivals(spark, sf):
    """Every seventh event of the first half arrives after the second half."""
    d = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, held = F.col("ts") < F.to_timestamp(F.lit("2024-01-16")), F.col("event_id") % 7 == 0
    return [d.where(first & ~held), d.where(~first), d.where(first & held)]


@query("st_08_late_rows_corrected", f"""WITH m AS (SELECT max(ts) - INTERVAL 24 HOURS AS mark FROM events WHERE NOT ({_HELD_BACK})), e AS (SELECT {_DAY} AS dt, event_type, value, {_HELD_BACK} AND ts < mark AS late FROM events, m)
 SELECT dt, event_type, count(*) AS n, CAST(sum(CAST(late AS INT)) AS BIGINT) AS n_late, round(coalesce(sum(value) FILTER (NOT late), 0), 4) AS volume_before, round(sum(value), 4) AS volume, max(value) AS high FROM e GROUP BY ALL""")
def st08c(spark, sf):
    """Slices out of order: late rows go to a table of their own, and the day's bar is corrected by them."""
    ontime, late = SB.split_late(spark, late_arrivals(spark, sf), scratch_path(spark, "late"))
    d = spark.read.parquet(ontime).unionByName(spark.read.parquet(late))
    value = F.col("value")
    return d.groupBy(F.to_date("ts").alias("dt"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"), F.round(F.coalesce(F.sum(F.when(~F.col("late"), value)), F.lit(0.0)), 4).alias("volume_before"), F.round(F.sum(value), 4).alias("volume"), F.max(value).alias("high")
    )


@query("u_01_student_t", "WITH g AS (SELECT l_suppkey, avg(l_discount - 0.05) / (stddev_samp(l_discount) / sqrt(count(*))) AS t, count(*) - 1 AS nu FROM lineitem GROUP BY l_suppkey HAVING count(*) > 2 AND stddev_samp(l_discount) > 0) SELECT l_suppkey, nu, round(" + sql_t("t", "nu") + ", 6) AS p_value FROM g")
def u01(spark, sf):
    from ..functions.student import t_two_sided

    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg(F.col("l_discount") - 0.05).alias("m"), F.stddev_samp("l_discount").alias("s"), F.count(F.lit(1)).alias("n")).where("n > 2 and s > 0")
    g = g.withColumn("t", F.try_divide(F.col("m"), F.col("s") / F.sqrt("n")))
    return rounded(g.select("l_suppkey", (F.col("n") - 1).alias("nu"), t_two_sided("t", F.col("n") - 1).alias("p_value")))


@query("u_06_registered_factor", "WITH " + PANEL + " SELECT symbol, dt, round(close / lag(close, 13) OVER (PARTITION BY symbol ORDER BY dt) - 1, 6) AS value FROM panel QUALIFY value IS NOT NULL")
def u06(spark, sf):
    """The user hook: register a factor as a column builder, then compute it like any other."""
    from ..functions import rolling as R
    from ..functions.expr import ratio
    from ..operators.factors import factors_wide, register
    from ..sources.panel import panel

    register("USER_MOM_13", lambda: ratio("close", R.lag("close", 13)) - 1)
    d = factors_wide(panel(spark, sf), ["USER_MOM_13"])
    return rounded(d.select("symbol", "dt", F.col("USER_MOM_13").alias("value")).where("value is not null"))
