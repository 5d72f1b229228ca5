"""Document fingerprints as Merkle trees, in DataFrame operations only.

A text's leaves are runs of words that end after a word whose digest is a multiple of LEAF_WORDS; leaves hash into
paragraphs (lines), paragraphs into sections, which end after a paragraph whose digest ends in one of four digits, and
sections into the root. All these ends depend on what stands there, so an insertion moves no later border, however long the
line. The fingerprint lists root, sections, paragraphs and leaf digests. Equal roots mean equal texts; likeness is the share
of leaf digests in common; `changed` descends differing sections only.

Null texts count as empty: one paragraph without leaves. Two texts without leaves are alike (1.0). Rows that
repeat both id and text share one place in the id order and one result each; repeated ids are ordered by a
hash of their text; a null id comes first. The next document of the last is the first. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import settle

TOKEN = r"\S+\s*|\s+"
LEAF_WORDS = 4  # on average
FIRST = -(1 << 63)


def _digest(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def with_tree(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `<out>` (the fingerprint) and `<out>_leaves` (its leaf digests as numbers)."""
    rest = df.columns
    marked = lambda w: F.concat(F.hex(w), F.when(F.pmod(w, F.lit(LEAF_WORDS)) == 0, F.lit(",")).otherwise(F.lit("-")))
    words = lambda p: F.transform(F.regexp_extract_all(p, F.lit(TOKEN), F.lit(0)), lambda x: marked(F.xxhash64(x)))
    leaves_of = lambda p: F.filter(F.split(F.array_join(words(p), ""), ","), lambda x: x != "")
    hashed = F.transform(F.split(text, "\n"), lambda p: F.transform(leaves_of(p), lambda x: F.xxhash64(x)))
    d = df.select(*rest, hashed.alias("__h"))
    tree = F.array_join(F.transform("__h", lambda leaves: _digest(F.xxhash64(leaves, F.size(leaves)))), ",")
    d = d.select(*rest, F.regexp_replace(tree, "([0-3]),", "$1;").alias("__p"), F.flatten("__h").alias(f"{out}_leaves"))
    sections = F.array_join(F.transform(F.split("__p", ";"), lambda s: _digest(F.xxhash64(s))), ",")
    d = d.select(*rest, f"{out}_leaves", "__p", sections.alias("__s"))
    leaves = F.array_join(F.transform(f"{out}_leaves", _digest), "")
    root = F.substring(F.sha2(F.concat_ws("|", "__s", "__p"), 256), 1, 32)
    return d.select(*rest, f"{out}_leaves", F.concat_ws("|", root, "__s", "__p", leaves).alias(out))


def likeness(a: str, b: str) -> Column:
    x, y = F.array_distinct(F.col(f"{a}_leaves")), F.array_distinct(F.col(f"{b}_leaves"))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(f"{a}_leaves", f"{b}_leaves")) / most)


def changed(a: Column, b: Column) -> Column:
    """Paragraph digests of fingerprint `a` that lie in sections which `b` has not, and are not in `b` either."""
    part = lambda f, k: F.split(F.get(F.split(f, r"\|"), F.lit(k)), ";" if k == 2 else ",")
    theirs = part(b, 1)
    pairs = F.zip_with(part(a, 1), part(a, 2), lambda s, p: F.struct(s.alias("s"), p.alias("p")))
    differing = F.transform(F.filter(pairs, lambda x: ~F.array_contains(theirs, x["s"])), lambda x: F.split(x["p"], ","))
    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), F.array().cast("array<string>")).otherwise(F.array_except(F.flatten(differing), F.flatten(F.transform(part(b, 2), lambda p: F.split(p, ",")))))


def successors(keys: DataFrame) -> DataFrame:
    """(id, h, n, next_id, next_h) of distinct (id, h, n) rows, in order, the last followed by the first.

    Rows are range-partitioned and settled with their partition number; only one row per partition meets in one task.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = settle(keys.repartitionByRange(parts, "id", "h").withColumn("part", F.spark_partition_id()), "ordered")
    firsts = laid.groupBy("part").agg(F.min(F.struct("id", "h")).alias("f"))
    w = W.partitionBy(F.lit(1)).orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("f").over(w), F.min("f").over(W.partitionBy(F.lit(1)))).alias("f"))
    here = F.lead(F.struct("id", "h")).over(W.partitionBy("part").orderBy("id", "h"))
    d = laid.withColumn("x", here).join(firsts, "part").withColumn("x", F.coalesce("x", "f"))
    return d.select("id", "h", "n", F.col("x.id").alias("next_id"), F.col("x.h").alias("next_h"))


def compare(docs: DataFrame) -> DataFrame:
    """Every document against its own edited text and against the next document; `changed`: digests of edited paragraphs it has not."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    order = settle(successors(base.select("id", "h", F.length("text").alias("n")).distinct()), "successors")
    asked = order.select(F.col("id").alias("c_id"), F.col("h").alias("c_h"), "n", F.col("next_id").alias("id"), F.col("next_h").alias("h"))
    heads = base.join(asked, ["id", "h"]).select("c_id", "c_h", "text", F.expr("substring(text, 1, cast(floor(n / 4) as int))").alias("head"))
    heads = with_tree(heads, "text", "next").select(F.col("c_id").alias("id"), F.col("c_h").alias("h"), "head", "next_leaves")
    again = base.groupBy("id", "h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    if not again.isEmpty():  # rows that repeat id and text would each answer
        heads = heads.dropDuplicates(["id", "h"])
    d = base.join(heads, ["id", "h"])
    n = F.length("text")
    # both joins take the same columns, so texts are shuffled once; the id stands for doc_id
    doc_id = F.when(F.col("id") != FIRST, F.col("id")).alias("doc_id")
    d = d.select(doc_id, "text", "head", "next_leaves", n.cast("long").alias("n_chars"), F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.col("head")).alias("edited"))
    d = with_tree(with_tree(d, "text", "fingerprint"), "edited", "edited_fingerprint")
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next").alias("near_next"),
        changed(F.col("edited_fingerprint"), F.col("fingerprint")).alias("changed"),
    )
