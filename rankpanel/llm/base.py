"""Shared pieces: input tables, settled tables in the shared folder, positions without a global sort."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.io import scratch_path

WORD = r"[^\x20\x09-\x0D]+"  # the words of every operator here
SPACES = " \t\n\x0b\x0c\r"
BATCH_ROWS = 1000  # whole texts that cross to a Python worker at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, after seeing to it that this session's Arrow batches hold BATCH_ROWS rows at most: rows here are whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(df.sparkSession.conf.get(key))
    if not 0 < rows <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df


CARRIED = "__carried"


def carried(docs: DataFrame, *own: str) -> DataFrame:
    """`docs` with the columns `own` as they are and all others inside one, out of the way of what an operator adds."""
    return docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias(CARRIED))


def restored(df: DataFrame, docs: DataFrame, *changed: str) -> DataFrame:
    """Rows of `df` with the columns of `docs` as `carried` put them away; those in `changed` come from `df` itself."""
    return df.select(*[F.col(f"`{c}`") if c in ("text", *changed) else F.col(f"{CARRIED}.`{c}`").alias(c) for c in docs.columns])


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: short plans, fixed row placement, nothing to recompute."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: str, out: str = "rank") -> DataFrame:
    """Number the rows of each `by` value from 0 in a settled table, without sorting or gathering a group.

    Each task counts its own rows per value; a window over one row per (value, task) gives the offsets.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        part = TaskContext.get().partitionId()
        for pdf in batches:
            local = pdf.groupby(by, dropna=False).cumcount()
            before = pdf[by].map(lambda k: seen.get(k, 0))
            for k, n in pdf[by].value_counts(dropna=False).items():
                seen[k] = seen.get(k, 0) + n
            yield pdf.assign(__part=part, __local=(local + before).astype("int64"))

    laid = settle(df.mapInPandas(count, f"{_ddl(df)}, __part int, __local long"), "numbered")
    sizes = laid.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy(by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(by, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return laid.join(offsets, [by, "__part"]).withColumn(out, F.col("__before") + F.col("__local")).drop("__part", "__local", "__before")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
