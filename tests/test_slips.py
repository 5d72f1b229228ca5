"""Small tests of rules that the registered queries do not reach."""

from pyspark.sql import functions as F

from rankpanel.operators import mining, risk
from rankpanel.sources import io, side_tables


def test_retried_run_is_read_once(spark):
    root = io.scratch_path(spark, "runs")
    d = spark.range(5)
    # an attempt that failed before its marker
    d.withColumn("run_id", F.lit("r")).withColumn("attempt", F.lit("lost")).write.partitionBy("run_id", "attempt").parquet(f"{root}/data")
    io.publish_run(d, root, "r")
    assert io.read_latest_run(spark, root).count() == 5


def test_equal_versions_keep_one_whole_row(spark):
    rows = [("k", 1, "a", 2), ("k", 1, "b", 1), ("k", 0, "z", 9)]
    for order in (rows, rows[::-1]):
        got = side_tables.keep_last(spark.createDataFrame(order, "k string, v int, x string, y int"), ["k"], "v").first()
        assert (got.x, got.y) == ("b", 1)


def test_long_correlation_chain(spark):
    n = 70
    nodes = spark.createDataFrame([(f"f{i:03d}",) for i in range(n)], "factor string")
    edges = spark.createDataFrame([(f"f{i:03d}", f"f{i + 1:03d}") for i in range(n - 1)], "a string, b string")
    assert {r.component for r in mining.components(nodes, edges).collect()} == {"f000"}


def test_bootstrap_of_a_short_series(spark):
    d = spark.sql("SELECT 'c' AS combo, id AS dt, 0.01 * (id + 1) AS r FROM range(3)")
    draws = risk.block_bootstrap(d, 20, 4, 1)
    assert draws.count() == 20 and {r.n for r in draws.collect()} == {3}
    assert risk.block_bootstrap(spark.sql("SELECT 'c' AS combo, id AS dt, 0.01 * (id + 1) AS r FROM range(30)"), 5, 4, 1).select("total_return").distinct().count() > 1
