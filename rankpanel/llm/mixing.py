"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A source's target is its share of all words, stopped at `cap` times its own words, the excess reshared by weight.
The level at which stops and shares balance comes from one ordered pass over one row per source. A source then
gives whole epochs, and the rest of its target from a weighted order of its documents: the key -ln(u) / w
with u from a hash of the id and w the document's quality weight; small keys first, until the words run out. The document
at the border is taken if that comes nearer to the target.

No source is sorted as a whole: narrow rows (no texts) are range-partitioned by source and order, words are summed
per source and range, and only documents of the range that holds a source's border are ordered. Ranges are cut at
sampled quantiles of the whole order, so they are even whatever the weights and repeats. All other documents
compare with the last one taken.

Null texts have size 0; null sources are one source, the last. Ties of keys are ordered by id, size, a hash of the
kept columns and a number of the row, so repeated rows are documents of their own, also at the border, where
any of several equal rows may go. A null id hashes like an empty one. Reruns give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import WORD, settle

ADDED = ("size", "source_size", "target", "taken")  # a column of these names is replaced
ORDER = ("key", "doc_id", "size", "hash", "nr")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def symbol_weight(text: Column, size: Column) -> Column:
    """Quality weight of a document: the share of its words that a markup symbol could not have spoilt, 0.05 at least."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.lit(1.0) - symbols / F.greatest(size, F.lit(1)), F.lit(1.0)))


def uniform(doc_id: Column) -> Column:
    """(0, 1] from 48 bits of a hash of the id; the id as text, so that any engine gives the same."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10)
    return (digits.cast("double") + 1.0) / F.lit(float(1 << 48))


def targets(sources: DataFrame, cap: int = 3, cycle: int = 3) -> DataFrame:
    """Adds `target` to one row per source (`source`, `source_size`). Weights 1..cycle repeat in source order."""
    everything = W.partitionBy(F.lit(1))  # one row per source
    s = sources.withColumn("w", (F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1)
    s = s.withColumn("stop", F.col("source_size") * cap).withColumn("ratio", F.col("stop") / F.col("w"))
    upto = everything.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    # level if all sources before this one stop: shares of the others per unit of weight
    level = (total - F.coalesce(F.sum("stop").over(upto), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0)))
    s = s.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return s.withColumn("target", F.least(F.col("stop").cast("double"), F.col("level") * F.col("w"))).select("source", "source_size", "target", *[c for c in sources.columns if c not in ("source", "source_size")])


def mix(docs: DataFrame, cap: int = 3, cycle: int = 3, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all by default) and size, source_size, target, taken. `docs` has doc_id, source and text.

    Texts are read once: the kept columns are settled with sizes and keys, and later passes read narrow columns.
    """
    keep = list(docs.columns if keep is None else keep)
    columns = [F.col(f"`{c}`") for c in keep if c not in ADDED]
    # names of the mix's own columns may be among the kept ones: all but the text are put away in one column first
    row = F.struct(F.lit(True).alias("__any"), *[F.col(f"`{c}`") for c in keep if c not in (*ADDED, "text")]).alias("row")
    sized = docs.select(row, "text", "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(*columns).alias("hash"))
    key = -F.log(uniform(F.col("doc_id"))) / symbol_weight(F.col("text"), F.col("size"))
    keyed = sized.select("row", *(["text"] if "text" in keep else []), "doc_id", "source", "size", key.alias("key"), "hash", F.monotonically_increasing_id().alias("nr"))
    keyed = settle(keyed, "sized")
    light = keyed.select("source", *ORDER)
    per_source = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = targets(per_source, cap, cycle).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    src = src.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    src = settle(src, "targets")  # one row per source: small ones are broadcast by the optimizer's own size check
    place = F.struct(*ORDER)

    def with_source(df: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
        return df.join(facts.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), how).drop("__s")

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = settle(light.repartitionByRange(parts, "source", *ORDER).withColumn("part", F.spark_partition_id()), "ordered")
    sums = laid.groupBy("source", "part").agg(F.sum("size").alias("words"), F.max(place).alias("top"))
    before = W.partitionBy("source").orderBy("part")  # one row per source and range
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("earlier", F.lag("top").over(before))
    border = with_source(sums, src.select("source", "rest")).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    border = settle(border.select("source", "part", "before", "earlier", "rest"), "borders")
    near = laid.join(border.select(F.col("source").alias("b"), F.col("part").alias("at"), "before", "rest"), F.col("source").eqNullSafe(F.col("b")) & (F.col("part") == F.col("at")))
    order = W.partitionBy("source").orderBy(*ORDER)
    near = near.withColumn("upto", F.col("before") + F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # the last document that still brings the sum nearer, as a struct to compare with
    last = near.where(F.col("upto") + F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max(place).alias("in_range"))
    last = with_source(border.select("source", "earlier"), last, "left")
    edge = with_source(src, last.select("source", F.coalesce("in_range", "earlier").alias("last"), F.lit(True).alias("cut")), "left")
    out = with_source(keyed, settle(edge, "edges"))
    chosen = F.when(F.col("cut").isNull(), F.col("rest") > 0).otherwise(F.coalesce(place <= F.col("last"), F.lit(False)))
    taken = F.col("size") * (F.col("epochs") + F.when(chosen, 1).otherwise(0))
    kept = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in keep if c not in ADDED]
    return out.select(*kept, "size", "source_size", "target", taken.cast("long").alias("taken"))
