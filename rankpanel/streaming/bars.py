"""Incremental intake, newest-wins upsert, streaming bars, late rows (ST-01..ST-03, ST-08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import scratch_path
from ..sources.side_tables import keep_last


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """File-source stream with an explicit schema; event time as a zoned timestamp so watermarks work."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def slices(d: DataFrame, column: str, n: int = 4) -> list[DataFrame]:
    """The table cut into n consecutive ranges, in the order they would arrive (three cut points reach the driver)."""
    cuts = d.agg(F.percentile_approx(F.unix_micros(F.col(column).cast("timestamp")) if column == "ts" else F.col(column), [k / n for k in range(1, n)])).first()[0]
    key = F.unix_micros(F.col(column).cast("timestamp")) if column == "ts" else F.col(column)
    bounds = [None, *cuts, None]
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (key > lo)
        if hi is not None:
            cond = cond & (key <= hi)
        out.append(d.where(cond))
    return out


def run_available(writer, checkpoint: str):
    """Everything that has arrived, then stop; the checkpoint remembers where to go on."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def land(parts: list[DataFrame], source: str, run) -> None:
    """One slice arrives, one run follows, and so on."""
    for part in parts:
        part.write.mode("append").parquet(source)
        run()


def intake(spark: SparkSession, parts: list[DataFrame], root: str) -> DataFrame:
    """Append new files only; a run without new files adds nothing."""
    schema = parts[0].schema

    def run():
        run_available(event_stream(spark, f"{root}/in", schema).writeStream.format("parquet").option("path", f"{root}/data").outputMode("append"), f"{root}/ck")

    land(parts, f"{root}/in", run)
    run()
    return spark.read.parquet(f"{root}/data")


def upsert_stream(spark: SparkSession, parts: list[DataFrame], root: str, keys: list[str], version: str) -> DataFrame:
    """Newest row per key. Each batch writes only its own winners; the table is their newest by key."""
    schema = parts[0].schema

    def write(batch: DataFrame, batch_id: int) -> None:
        keep_last(batch, keys, version).write.mode("overwrite").parquet(f"{root}/table/batch={batch_id}")

    land(parts, f"{root}/in", lambda: run_available(event_stream(spark, f"{root}/in", schema).writeStream.foreachBatch(write), f"{root}/ck"))
    return keep_last(spark.read.parquet(f"{root}/table").drop("batch"), keys, version)


def daily_bars(events: DataFrame) -> DataFrame:
    """Open, high, low, close, volume and count per (day, symbol) with a one-day watermark."""
    order = F.struct("ts", "event_id")
    return (
        events.withWatermark("ts", "1 day")
        .groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("symbol"))
        .agg(
            F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"),
            F.round(F.sum("value"), 4).alias("volume"), F.count(F.lit(1)).alias("n"),
        )
        .select(F.to_date("w.start").alias("dt"), "symbol", "open", "high", "low", "close", "volume", "n")
    )


def stream_bars(spark: SparkSession, parts: list[DataFrame], root: str) -> DataFrame:
    """Update mode: a bar is rewritten when more of its rows arrive; readers take the newest version."""
    schema = parts[0].schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/bars/batch={batch_id}")

    land(parts, f"{root}/in", lambda: run_available(daily_bars(event_stream(spark, f"{root}/in", schema)).writeStream.outputMode("update").foreachBatch(write), f"{root}/ck"))
    return keep_last(spark.read.parquet(f"{root}/bars").drop("batch"), ["dt", "symbol"], "version").drop("version")


def split_late(spark: SparkSession, parts: list[DataFrame], root: str, delay_hours: int = 24) -> tuple[str, str]:
    """On-time rows to one table, rows older than the newest seen minus the delay to another."""

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = f"{root}/seen"
        mark = None
        if batch_id > 0:
            mark = spark.read.parquet(seen).where(F.col("batch_id") < batch_id).agg(F.max("ts")).first()[0]  # one timestamp
        late = (F.col("ts") < F.lit(mark) - F.expr(f"INTERVAL {delay_hours} HOURS")) if mark is not None else F.lit(False)
        flagged = batch.withColumn("late", F.coalesce(late, F.lit(False)))
        flagged.where(~F.col("late")).write.mode("overwrite").parquet(f"{root}/ontime/batch={batch_id}")
        flagged.where("late").write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
        batch.agg(F.max("ts").alias("ts"), F.lit(batch_id).alias("batch_id")).write.mode("append").parquet(seen)

    schema = parts[0].schema
    land(parts, f"{root}/in", lambda: run_available(event_stream(spark, f"{root}/in", schema).writeStream.foreachBatch(write), f"{root}/ck"))
    return f"{root}/ontime", f"{root}/late"
