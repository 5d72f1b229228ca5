"""Rule ledger: every quality rule is evaluated once per document and kept as one bit beside its measurements.

Policies are versioned sets of rules, that is, bit masks; applying one is a bitwise test. Ablations count, per
rule of a policy, the documents that fail it and those that only it rejects, from one count per bit pattern.
DataFrame functions only. Repeated five-word windows are found inside the row: window hashes are sorted with
their positions and the covered words counted from the gaps; most documents have none and skip the sort.

Null texts have no words. Repeated rows are judged row by row. Extra columns pass through `evaluate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACES, WORD

# fixed order: a rule's place is its bit; new rules go to the end
RULES = ("few_words", "repeated_windows", "symbols", "capitals", "repeated_lines", "word_length")
POLICIES = {"base": ("few_words", "repeated_windows"), "v1": RULES}
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words", "failed")


def mask(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def evaluate(docs: DataFrame) -> DataFrame:
    """`docs` without its text, with measurements and `failed`, the failure bits."""
    rest = [c for c in docs.columns if c not in ("text", *MEASURES)]  # same names are replaced
    t = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    d = docs.select(*rest, t.alias("__t"))
    d = d.select(*rest, "__t", F.regexp_extract_all("__t", F.lit(f"({WORD})"), F.lit(1)).alias("__w"), lines.alias("__l"))
    w = F.col("__w")
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    d = d.select(
        *rest,
        F.size(w).cast("long").alias("n_words"),
        _without(F.col("__t"), SPACES).cast("long").alias("word_chars"),
        (F.length("__t") - _without(F.col("__t"), "#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.length("__t") - _without(F.col("__t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_capitals"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")).alias("__h"),
    )
    kept = [c for c in d.columns if c != "__h"]
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.select(*kept, F.when(F.size(F.array_distinct("__h")) < F.size("__h"), placed).otherwise(none).alias("__s"))
    s = F.col("__s")

    def twice(x: Column, k: Column) -> Column:
        before, after = F.when(k > 0, F.get(s, k - 1)["h"]), F.get(s, k + 1)["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    d = d.select(*kept, F.array_sort(F.transform(F.filter(s, twice), lambda x: x["i"])).alias("__p"))
    p = F.col("__p")
    gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
    d = d.select(*kept, F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))
    n = F.col("n_words")
    fails = {
        "few_words": n < 10,
        "repeated_windows": F.col("n_repeat_words") * 100 > n * 20,
        "symbols": F.col("n_symbols") * 10 > n,
        "capitals": F.col("n_capitals") * 10 > F.col("word_chars") * 3,
        "repeated_lines": F.col("n_dup_lines") * 2 > F.col("n_lines"),
        "word_length": (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 30),
    }
    bits = [F.when(fails[r], F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    return d.withColumn("failed", sum(bits[1:], bits[0]).cast("long"))


def passes(policy: str) -> Column:
    return F.col("failed").bitwiseAND(mask(policy)) == 0


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents failing it, and documents kept if it alone were dropped."""
    patterns = ledger.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))  # at most 2 ** rules rows
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    r = patterns.select("failed", "n", rules.alias("r")).select("failed", "n", "r.rule", "r.bit")
    alone = F.col("failed").bitwiseAND(mask(policy)) == F.col("bit")
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    return r.groupBy("rule").agg(F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY 1),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, (n_words < 10)::BIGINT + 2 * (n_repeat_words * 100 > n_words * 20)::BIGINT + 4 * (n_symbols * 10 > n_words)::BIGINT + 8 * (n_capitals * 10 > word_chars * 3)::BIGINT
  + 16 * (n_dup_lines * 2 > n_lines)::BIGINT + 32 * (word_chars < n_words * 2 OR word_chars > n_words * 30)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""
