"""Spelling variants of a corpus vocabulary: generated edits probed against Bloom filters, then an exact join.

Words are counted over all documents. Their edits (every deleted code point, every one replaced by a larger one of the
alphabet; inserted ones are deletions seen from the other word) are generated as hashes from prefix and suffix
sums and probed against blocked Bloom filters of the vocabulary, one range of blocks for each word length. Only edits that the
filter lets pass become strings, and an exact join with the vocabulary removes the false ones; nothing real is lost.

The filters are broadcast. One broadcast holds FILTER_BYTES at most: a larger vocabulary is cut into slices by hash,
and each slice has filters of its own and a pass of its own. A near pair is met once, from its longer word or, at
equal length, from the one with the smaller code point.

A word's form is its near word of largest n (ties: the smallest) where that n is at least twice its own; forms lead to
roots by pointer doubling (n at least doubles on the way, so chains are short). Null and empty texts have no words; a null doc_id
counts as the empty string. Repeated rows count again. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import settle, small_batches

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, ONE_IN = 5, 3, 97
HELD = 200_000  # distinct words that a task counts before it hands them on
FILTER_BYTES = 32 << 20
KEY_BITS, BLOCK_BITS, PROBES = 12, 512, 6
CHUNK = 4096  # blocks that one group builds
CELLS = 1 << 20  # edits probed at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)


def misspelt(doc: str, run: str) -> str:
    """The lower-cased run, one code point short where the hash of document and run asks for it."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _rows(seen: Counter) -> pd.DataFrame:
    return pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    for pdf in batches:
        for doc, text in zip(pdf["doc"], pdf["text"]):
            if not text:
                continue
            low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only
            for run, n in Counter(RUN.findall(low)).items():
                if len(run) >= LEAST_LENGTH and len(word := misspelt(doc, run)) >= LEAST_LENGTH:
                    seen[word] += n
            if len(seen) > HELD:
                yield _rows(seen)
                seen.clear()
    yield _rows(seen)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n), settled."""
    texts = small_batches(docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text"))
    counted = texts.mapInPandas(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return settle(counted.where(F.col("n") >= LEAST_COUNT), "vocabulary")


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer (constants of a common avalanche mix, fixed values)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(length: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(length, _BASE), dtype=np.uint64)])


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.uint64)


def _cells(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block within a length's range, and the source of the bit positions, of each hash."""
    first = _mixed(h)
    return ((first >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), _mixed(first ^ _BASE)


def _bit(source: np.ndarray, k: int) -> np.ndarray:
    return (source >> np.uint64(9 * k)) & np.uint64(BLOCK_BITS - 1)


class Filters:
    """Blocked Bloom filters by word length: `lengths` maps a length to its first block and number of blocks."""

    def __init__(self, lengths: dict[int, tuple[int, int]], data: bytes):
        self.lengths, self._words = lengths, np.frombuffer(data, "<u8")

    def passing(self, length: int, h: np.ndarray) -> np.ndarray:
        """Positions in `h` of the hashes that may be those of words of `length`."""
        if length not in self.lengths:
            return np.zeros(0, np.int64)
        first, blocks = self.lengths[length]
        block, source = _cells(h, blocks)
        at = np.arange(len(h))
        for k in range(PROBES):
            bit = _bit(source, k)
            word = self._words[((block + np.uint64(first)) * np.uint64(BLOCK_BITS // 64) + (bit >> np.uint64(6))).astype(np.int64)]
            hit = (word >> (bit & np.uint64(63))) & np.uint64(1) == 1
            at, block, source = at[hit], block[hit], source[hit]
        return at


def build_filters(words: DataFrame) -> Filters:
    """Filters of the words of a settled table; its size on the driver is KEY_BITS a word."""
    sizes = sorted((r["length"], r["n"]) for r in words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect())
    lengths, total = {}, 0
    for length, n in sizes:
        blocks = -(-n * KEY_BITS // BLOCK_BITS)
        lengths[length] = (total, blocks)
        total += blocks

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for length, part in pdf.groupby(pdf["word"].str.len())["word"]:
                first, blocks = lengths[int(length)]
                block, source = _cells(_codes(part.tolist()) @ _powers(int(length))[:-1], blocks)
                block = block.astype(np.int64) + first
                yield pd.DataFrame({"chunk": block // CHUNK, "block": block % CHUNK, "source": source.view(np.int64)})

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros((CHUNK, BLOCK_BITS), bool)
        for k in range(PROBES):
            bits[pdf["block"].to_numpy(), _bit(pdf["source"].to_numpy().view(np.uint64), k).astype(np.int64)] = True
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "bits": [np.packbits(bits, axis=1, bitorder="little").tobytes()]})

    rows = words.select("word").mapInPandas(place, "chunk long, block long, source long").groupBy("chunk").applyInPandas(fill, "chunk long, bits binary").collect()
    empty = bytes(CHUNK * BLOCK_BITS // 8)
    found = {r["chunk"]: bytes(r["bits"]) for r in rows}
    return Filters(lengths, b"".join(found.get(k, empty) for k in range(-(-total // CHUNK))))


def _edits(words: list[str], alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[int, str]]:
    """(row, edit) of the edits of words of one length that pass the filters; each near pair from one side only."""
    c = _codes(words)
    length = c.shape[1]
    powers = _powers(length)
    terms = c * powers[:-1]
    whole = terms.sum(axis=1, dtype=np.uint64)
    if length > LEAST_LENGTH:
        before = np.cumsum(terms, axis=1) - terms
        after = c * np.concatenate([powers[:1], powers[: length - 1]])  # each code point one place further to the left
        after = after.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(after, axis=1)
        row, at = np.nonzero(np.concatenate([np.ones((len(words), 1), bool), c[:, 1:] != c[:, :-1]], axis=1))  # of equal neighbours, the first
        for k in filters.passing(length - 1, (before + after)[row, at]).tolist():
            w, i = words[row[k]], int(at[k])
            yield int(row[k]), w[:i] + w[i + 1 :]
    if length in filters.lengths:
        for i in range(length):
            row, a = np.nonzero(alphabet[None, :] > c[:, i, None])
            symbol = alphabet[a]
            h = whole[row] + (symbol - c[row, i]) * powers[i]
            for k in filters.passing(length, h).tolist():
                w = words[row[k]]
                yield int(row[k]), w[:i] + chr(int(symbol[k])) + w[i + 1 :]


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, near, near_n), settled: each near pair of a settled vocabulary once."""
    total = words.count()
    slices = max(1, -(-total * KEY_BITS // (8 * filter_bytes)))

    def letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"c": pd.Series(sorted(set("".join(pdf["word"]))), dtype=object)})

    alphabet = np.array(sorted(ord(r["c"]) for r in words.select("word").mapInPandas(letters, "c string").distinct().collect()), np.uint64)  # 116 at most
    found = None
    for s in range(slices):
        part = words if slices == 1 else words.where(F.pmod(F.xxhash64("word"), F.lit(slices)) == s)
        shared = words.sparkSession.sparkContext.broadcast(build_filters(part))

        def probe(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for length, part in pdf.groupby(pdf["word"].str.len()):
                    step = max(1, CELLS // (int(length) + len(alphabet)))
                    for lo in range(0, len(part), step):
                        some = part.iloc[lo : lo + step]
                        texts, n = some["word"].tolist(), some["n"].to_numpy()
                        hits = list(_edits(texts, alphabet, shared.value))
                        rows = np.array([r for r, _ in hits], np.int64)
                        yield pd.DataFrame({"word": pd.Series([texts[r] for r in rows], dtype=object), "n": n[rows], "near": pd.Series([e for _, e in hits], dtype=object)})

        hits = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word").mapInPandas(probe, "word string, n long, near string")
        exact = hits.join(part.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
        found = exact if found is None else found.unionByName(exact)
    return settle(found.select("word", "n", "near", "near_n"), "near_pairs")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of settled (word, form) links without cycles: every pass doubles the steps."""
    at = links.select("word", F.col("form").alias("root"))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = settle(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = vocabulary(docs)
    pairs = near_pairs(words)
    both = pairs.select("word", "n", "near", "near_n").union(pairs.select("near", "near_n", "word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    leads = -F.col("best.less") >= 2 * F.col("n")
    near = settle(near.select("word", "n_near", F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")), "forms")
    led = roots(near.where("form IS NOT NULL").select("word", "form"))
    out = words.join(near, "word", "left").join(led, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


# CRC-32 as SQL: the table from the polynomial, then one step for each byte
CRC_TABLE = "(SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl)"


def crc_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a SQL text expression, beside a column `tbl` of CRC_TABLE."""
    digits = f"hex(encode({text}))"
    parts = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr({digits}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {parts}), lambda c, b: xor(c >> 8, tbl[xor(c & 255, b) + 1])))"


ORACLE = f"""
WITH RECURSIVE runs AS (
  SELECT doc, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
  GROUP BY 1, 2
), hashed AS (
  SELECT run, k, {crc_sql("doc || ':' || run")} AS h FROM runs, {CRC_TABLE} WHERE length(run) >= 5
), words AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3
), cuts AS (
  SELECT DISTINCT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON w.word = c.a || c.b
  UNION SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON w.word = c.a || c.b
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), walk AS (
  SELECT word, word AS at, form AS ahead FROM forms
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON f.word = w.ahead
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word AND w.ahead IS NULL
"""
