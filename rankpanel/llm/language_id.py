"""Language of web pages by fusing Bayesian evidence.

Four kinds of evidence meet in log space: the likelihood of the page's text under byte-trigram models counted over all
labelled documents, P(declared markup language | language), P(address suffix | language), and the prior of the
host, smoothed towards its domain, and that towards all pages. The last three are grouped sums of the text's
posteriors over all pages, each page leaving itself out of its host and domain, so a page never confirms itself.

Counts reach the driver only per (language, bucket); the languages are a small closed set. Null html or url count
as empty; a page without text or address gets the prior. Languages that are null train nothing. Without any
labelled document the language is null. Repeated rows count as pages of their own; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import settle

BUCKETS = 1 << 15
EVIDENCE = 60.0  # overlapping trigrams depend on one another: a text counts as this many independent ones at most
SMOOTH, TABLE_SMOOTH = 5.0, 0.5
_MARKUP = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<title\b[^>]*>[^<]*|<!--.*?(?:-->|\Z)|<[^>]*>|&#?\w+;?", re.DOTALL | re.IGNORECASE)


def trigrams(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    return (((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-likelihood per bucket, from every labelled document."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    known = docs.where("lang is not null and text is not null").select("lang", "text")
    rows = known.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.full((len(langs), BUCKETS), TABLE_SMOOTH)
    for k, lang in enumerate(langs):
        mine = rows[rows["lang"] == lang]
        table[k, mine["bucket"]] += mine["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """(page_id, url, declared, logs): tempered log-likelihoods of the page's visible text."""
    shared = pages.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            logs = []
            for page in pdf["html"]:
                grams = trigrams(" ".join(_MARKUP.sub(" ", page or "").split()))
                total = shared.value[:, grams].sum(axis=1, dtype=np.float64) if len(grams) else np.zeros(len(langs))
                logs.append((total * min(1.0, EVIDENCE / max(1, len(grams)))).tolist())
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "declared": pdf["declared"], "logs": logs})

    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    kind = dict(pages.dtypes)
    return pages.select("page_id", "url", "html", declared.alias("declared")).mapInPandas(run, f"page_id {kind['page_id']}, url string, declared string, logs array<double>")


def _softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, url, lang, confidence, text_lang, declared, suffix, host for every page."""
    langs, table = model(docs)
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select("page_id", "url", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), none.alias("declared"), none.alias("suffix"), none.alias("host"))
    n = len(langs)
    d = text_evidence(pages, langs, table)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    d = d.withColumn("host", host).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1))
    d = settle(d.withColumn("p", _softmax(F.col("logs"))), "page_evidence")

    def sums(by: str | None) -> DataFrame:
        g = d.groupBy(by) if by else d.groupBy()
        return g.agg(F.array(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in range(n)]).alias(f"{by or 'all'}_n"))

    overall = sums(None).first()["all_n"]
    total = sum(overall)
    prior = F.array(*[F.lit((x + 1.0) / (total + n)) for x in overall])
    for by in ("host", "domain", "declared", "suffix"):
        d = d.join(settle(sums(by), f"sums_{by}"), by)  # settled: a key with many pages can be split in the join

    def toward(counts: str, base: Column) -> Column:
        """Own page left out, pulled to `base` by SMOOTH pages."""
        rest = F.zip_with(counts, "p", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        size = F.aggregate(rest, F.lit(0.0), lambda a, b: a + b)
        return F.transform(F.zip_with(rest, base, lambda a, b: a + b * SMOOTH), lambda v: v / (size + SMOOTH))

    def given(counts: str) -> Column:
        """P(this value | language); an absent value says nothing."""
        rest = F.zip_with(counts, "p", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        return F.zip_with(rest, F.array(*[F.lit(float(x)) for x in overall]), lambda a, b: (a + 0.5) / (b + 1.0))

    d = d.withColumn("by_domain", F.when(F.col("domain") != "", toward("domain_n", prior)).otherwise(prior))
    d = d.withColumn("by_host", F.when(F.col("host") != "", toward("host_n", F.col("by_domain"))).otherwise(prior))
    flat = F.array(*[F.lit(1.0)] * n)
    for c in ("declared", "suffix"):
        d = d.withColumn(f"like_{c}", F.when(F.col(c) != "", given(f"{c}_n")).otherwise(flat))
    post = F.array(*[F.col("logs")[i] + F.log(F.col("by_host")[i]) + F.log(F.col("like_declared")[i]) + F.log(F.col("like_suffix")[i]) for i in range(n)])
    d = d.withColumn("post", post).withColumn("q", _softmax(F.col("post")))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return d.select("page_id", "url", best("q").alias("lang"), F.array_max("q").alias("confidence"), best("p").alias("text_lang"), "declared", "suffix", "host")
