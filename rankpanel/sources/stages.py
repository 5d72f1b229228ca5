"""Stage tables shared by many queries of one session.

A stage is written once, as parquet, into the shared checkpoint folder the cluster names, and read
back with its schema. The plans built on top start from a file scan: they stay short, prune columns,
know their sizes (so small stages are broadcast by the optimizer's own size check), and a lost
executor costs nothing but its running tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .io import scratch_path

_STAGES: dict[tuple, tuple[str, object]] = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        df = build()
        path = scratch_path(spark, "stage-" + "".join(c if c.isalnum() else "_" for c in name))
        df.write.parquet(path)
        _STAGES[key] = (path, df.schema)
    path, schema = _STAGES[key]
    return spark.read.schema(schema).parquet(path)
