"""A training corpus in five stages: each reads what its predecessor kept, as Parquet in the shared folder.

quality classifier -> SimHash near-dedup -> secret scans -> mixing to target weights -> best-fit packing.
All stages but the last return the columns of `documents`; the last returns the packed pieces. Mixing
repeats a document as often as the mix takes it, so later rows may share a doc_id; packing treats every row
as a document of its own. Columns that the input has beside those of `documents` go through unchanged, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankpanel.llm.base import CARRIED, carried, restored, settle, table
from rankpanel.llm.mixing import mix
from rankpanel.llm.packing import pack, token_pieces
from rankpanel.llm.queries import SEQUENCE, TOKENIZER
from rankpanel.llm.secret_scan import without_secrets
from rankpanel.llm.simhash import survivors, text_key
from rankpanel.llm.subword_classifier import THRESHOLD, fit, score
from rankpanel.llm.token_ids import share_vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at THRESHOLD or more; trained on the labels of `sf_dir`."""
    scored = score(carried(docs, "text"), fit(docs, table(spark, sf_dir, "labels")))
    return restored(scored.where(F.col("score") >= THRESHOLD), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of smallest id (null after all others), then of smallest text hash.

    Rows are told apart by id and text, so a null id or an id with several texts loses no unique text. Of rows that
    repeat both, the one of smallest other columns stays; only such rows are gathered.
    """
    kept = survivors(docs).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("n").alias("__n"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (text_key(F.col("text")) == F.col("__key"))
    repeats = kept.where("__n > 1")
    if repeats.isEmpty():
        return docs.join(kept, same, "left_semi")
    once = docs.join(kept.where("__n = 1"), same, "left_semi")
    row = F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], "text")).alias("row")
    twice = docs.join(repeats, same).groupBy("__id", "__key").agg(row).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return once.unionByName(twice)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return without_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words have no share and stay once."""
    mixed = mix(carried(docs, "doc_id", "source", "text"), keep=["text", CARRIED])
    copies = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    return restored(mixed.where(copies > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return pack(token_pieces(docs, share_vocabulary(spark, TOKENIZER), SEQUENCE), SEQUENCE)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing sources", mixing),
    ("best-fit packing", packing),
]
ORACLE_SQL = None  # a trained classifier and XXH64 bit votes have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
