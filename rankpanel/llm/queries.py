"""The registered queries of this subpackage, their expected SQL, and the tables they read."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ledger, periods, spelling, suffix_dedup
from .base import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SEQUENCE = 1024


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces
    from .token_ids import share_vocabulary

    return pack(token_pieces(table(spark, sf_dir, "documents"), share_vocabulary(spark, TOKENIZER), SEQUENCE), SEQUENCE)


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_digits, near_groups

    g = near_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .subword_classifier import THRESHOLD, fit, held_out, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("redacted")


@query
def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id"])


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ledger import evaluate, passes

    led = evaluate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), "failed")


ORACLE["op6_quality_rules"] = ledger.ORACLE


@query
def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import compare

    return compare(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_token_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.io import scratch_path
    from .keyed_shards import read_all, write_shards
    from .token_ids import share_vocabulary

    root = scratch_path(spark, "shards")
    manifest = write_shards(table(spark, sf_dir, "documents"), share_vocabulary(spark, TOKENIZER), root)
    return read_all(spark, root, manifest)


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_cut import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "pages").select("page_id", "url", "html"), table(spark, sf_dir, "documents"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE["op13_spelling_variants"] = spelling.ORACLE


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periods import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE["op12_periodic_runs"] = periods.ORACLE


@query
def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE["op11_suffix_array_dedup"] = suffix_dedup.ORACLE
