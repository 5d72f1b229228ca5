"""Readers and sinks for stage outputs (S-15..S-18) on plain folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

FORMATS = ("parquet", "csv", "json")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints: reachable by every executor."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def read_table(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    r = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    return r.load(path)


def publish_run(df: DataFrame, root: str, run_id: str) -> None:
    """Write one attempt of a run, then the marker row that names it.

    Readers see marked attempts only: a run that fails before its marker stays invisible, also once it is retried.
    """
    spark = df.sparkSession
    attempt = uuid.uuid4().hex
    df.withColumn("run_id", F.lit(run_id)).withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("run_id", "attempt").parquet(f"{root}/data")
    spark.createDataFrame([(run_id, attempt)], "run_id string, attempt string").withColumn("committed_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/runs")


def read_latest_run(spark: SparkSession, root: str) -> DataFrame:
    latest = spark.read.parquet(f"{root}/runs").agg(F.max_by("attempt", "committed_at").alias("attempt")).first()["attempt"]
    return spark.read.parquet(f"{root}/data").where(F.col("attempt") == latest).drop("run_id", "attempt")
