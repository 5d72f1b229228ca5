"""Maximal periodic runs of words in whole texts, by longest common extensions over a difference cover.

The positions whose number modulo 7 lies in {0, 1, 3} form the cover: for any two positions there is a shift below 7
that takes both into it. Only cover suffixes are sorted (seven words first, then by doubling, which stays inside the
cover), a sparse table answers minima of their neighbours' common prefixes, and a longest common extension compares
at most six words and asks the table once. For each period p a grid of places 2p apart is enough, since a run of
four periods matches itself p words on over three periods; grid places whose cell matches at both ends are extended
forwards and backwards to the run that holds them. Documents go through these steps many at a time; one that is
longer than BATCH_WORDS goes alone, with arrays in proportion to its words.

A run found with several periods has the smallest. A null text counts as empty: no words, no runs. A null doc_id
plants nothing. Repeated rows give repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import small_batches
from .spelling import CRC_TABLE, crc_sql

MODULUS, COVER = 7, (0, 1, 3)
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
BATCH_WORDS = 200_000
CELLS = 1 << 20  # grid places looked at in one go
_IN = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
SHIFT = np.array([[next(d for d in range(MODULUS) if _IN[a + d] and _IN[b + d]) for b in range(MODULUS)] for a in range(MODULUS)])


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, with a periodic stretch at the end where the hash of the id asks for one."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


class Extensions:
    """Longest common extensions to the right inside documents: `x` words from 1, `end` of each position's document."""

    def __init__(self, x: np.ndarray, end: np.ndarray):
        n = len(x)
        self._end = end
        self._x = x = np.concatenate([x, np.zeros(2 * MODULUS, x.dtype)])
        at = np.flatnonzero(_IN[np.arange(n) % MODULUS])
        self._index = index = np.full(n + 2 * MODULUS, -1, np.int32)
        index[at] = np.arange(len(at), dtype=np.int32)
        first = [end[at]] + [x[at + k] for k in range(MODULUS)]  # the document comes first: only its own suffixes matter
        ranks = [self._named(np.lexsort(first[::-1]), first)]
        while len(ranks[-1]) and ranks[-1].max() + 1 < len(at):
            last = ranks[-1].astype(np.int64)
            ahead = at + (MODULUS << (len(ranks) - 1))
            there = np.where(ahead < n, last[index[np.minimum(ahead, n - 1)]], -1)  # the shift is a multiple of 7: still in the cover
            key = last * (len(at) + 1) + there + 1
            ranks.append(self._named(np.argsort(key, kind="stable"), [key]))
        self._rank = ranks[-1]
        order = np.empty(len(at), np.int64)
        order[self._rank] = at
        a, b, common = order[:-1], order[1:], np.zeros(max(0, len(at) - 1), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            p, q = a + common, b + common
            inside = (p < n) & (q < n)
            same = inside & (ranks[k][index[np.minimum(p, n - 1)]] == ranks[k][index[np.minimum(q, n - 1)]])
            common += np.where(same, MODULUS << k, 0)
        common += self._few(np.minimum(a + common, n), np.minimum(b + common, n), np.full(len(a), MODULUS - 1))
        self._table = [common.astype(np.int32)]
        while 2 << (len(self._table) - 1) <= len(common):
            t, half = self._table[-1], 1 << (len(self._table) - 1)
            self._table.append(np.minimum(t[:-half], t[half:]))

    @staticmethod
    def _named(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        """Dense names of rows in `order`; rows of equal keys share one."""
        new = np.zeros(len(order), bool)
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
        names = np.empty(len(order), np.int32)
        names[order] = np.cumsum(new)
        return names

    def _few(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many of the next `most` (below 7) words are equal."""
        equal, on = np.zeros(len(i), np.int64), np.ones(len(i), bool)
        for k in range(MODULUS - 1):
            on &= (k < most) & (self._x[i + k] == self._x[j + k])
            equal += on
        return equal

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from `i` and from `j` on (i < j, one document)."""
        shift = SHIFT[i % MODULUS, j % MODULUS]
        out = self._few(i, j, shift)
        on = np.flatnonzero((out == shift) & (j + shift < len(self._end)))
        r, s = self._rank[self._index[i[on] + shift[on]]], self._rank[self._index[j[on] + shift[on]]]
        lo, hi = np.minimum(r, s), np.maximum(r, s)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        least = np.zeros(len(on), np.int64)
        for k in np.unique(level):
            m = level == k
            t = self._table[k]
            least[m] = np.minimum(t[lo[m]], t[hi[m] - (1 << int(k))])
        out[on] += least
        return np.minimum(out, self._end[i] - j)


def _candidates(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the grid cells that match one period on, at both ends."""
    periods = sizes // LEAST_EXPONENT
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    p = np.arange(periods.sum(), dtype=np.int64) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    start, cells = np.repeat(starts, periods), np.repeat(sizes, periods) // (2 * p)
    upto, places, found = np.cumsum(cells), [], []
    lo = 0
    while lo < len(p):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CELLS, side="right")))
        c = cells[lo:hi]
        period = np.repeat(p[lo:hi], c)
        at = np.repeat(start[lo:hi], c) + 2 * period * (np.arange(len(period)) - np.repeat(np.cumsum(c) - c, c))
        keep = x[at] == x[at + period]
        at, period = at[keep], period[keep]
        keep = x[at + period - 1] == x[at + 2 * period - 1]
        places.append(at[keep])
        found.append(period[keep])
        lo = hi
    return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def find_runs(docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every maximal run of each document (words as numbers from 1), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    sizes = np.array([len(d) for d in docs], np.int64)
    if not sizes.sum():
        return out
    at, period = _candidates(np.concatenate(docs), sizes)
    if not len(at):
        return out
    # only documents with candidates are indexed
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, at, side="right")
    used, doc = np.unique(doc, return_inverse=True)
    at = at - (ends - sizes)[used][doc]
    x, sizes = np.concatenate([docs[d] for d in used]), sizes[used]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    at = at + starts[doc]
    n = len(x)
    forth = Extensions(x, np.repeat(ends, sizes))(at, at + period)
    mirrored = np.repeat(n - starts, sizes)[::-1]
    back = np.zeros(len(at), np.int64)
    inner = at > starts[doc]
    # to the left of `at` is to the right of its mirror image; the place one period on comes first there
    rest = Extensions(x[::-1], mirrored)
    i, j = n - (at[inner] + period[inner]), n - at[inner]
    back[inner] = np.minimum(rest(i, j), at[inner] - starts[doc[inner]])
    first, length = at - back - starts[doc], back + period + forth
    long_enough = length >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period)
    doc, first, length, period = doc[long_enough], first[long_enough], length[long_enough], period[long_enough]
    order = np.lexsort((period, length, first, doc))
    doc, first, length, period = doc[order], first[order], length[order], period[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1]) | (length[1:] != length[:-1])
    for d, s, m, p in zip(doc[new].tolist(), first[new].tolist(), length[new].tolist(), period[new].tolist()):
        out[used[d]].append((s, m, p))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def _row(doc_id: int | None, words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    kept = words
    if found:
        change = np.zeros(len(words) + 1, np.int64)
        for s, m, p in found:
            change[s + p] += 1
            change[s + m] -= 1
        kept = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    milli = 1000 * best[1] // best[2] if best else None
    return (doc_id, len(found), *(best or (None, None, None)), milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, plant: bool = True) -> DataFrame:
    """One row per document; `plant` edits the words first, as the contract of the query asks."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def rows(group: list[tuple[int | None, list[bytes]]]) -> pd.DataFrame:
        numbers: dict[bytes, int] = defaultdict(count(1).__next__)
        coded = [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) for _, words in group]
        out = pd.DataFrame([_row(d, words, found) for (d, words), found in zip(group, find_runs(coded))], columns=names)
        return out.astype({c: "Int64" for c in names[:6]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            group, held = [], 0
            for doc_id, text in zip(pdf["id"], pdf["text"]):
                words = text.encode("utf-8", "surrogatepass").split() if text else []  # bytes split at ASCII white space only
                doc = int(doc_id) if doc_id else None
                group.append((doc, planted(words, doc) if plant else words))
                held += len(words)
                if held >= BATCH_WORDS:
                    yield rows(group)
                    group, held = [], 0
            if group:
                yield rows(group)

    # the id crosses as text: a null would turn a whole batch of longs into floats
    return small_batches(docs.select(F.col("doc_id").cast("long").cast("string").alias("id"), "text")).mapInPandas(run, COLUMNS)


ORACLE = f"""
WITH hashed AS (
  SELECT row_number() OVER () AS rid, doc_id, w, CAST(len(w) AS BIGINT) AS n, CASE WHEN h % 10 = 0 THEN h // 10 END AS g
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents, {CRC_TABLE})
), planted AS (
  SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM hashed
), words AS MATERIALIZED (
  SELECT rid, n, i, CASE WHEN g IS NOT NULL AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM planted)
), matches AS (
  SELECT x.rid, y.i - x.i AS p, x.i FROM words x JOIN words y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT rid, p, min(i) AS s, count(*) + p AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS k FROM matches) GROUP BY rid, p, k
), runs AS MATERIALIZED (
  SELECT rid, s, m, min(p) AS p FROM islands WHERE m >= greatest(6, 4 * p) GROUP BY rid, s, m
), summary AS (
  SELECT rid, count(*) AS n_runs, first(s ORDER BY m DESC, s, p) AS start, first(m ORDER BY m DESC, s, p) AS length, first(p ORDER BY m DESC, s, p) AS period,
    string_agg(s || ',' || m || ',' || p || chr(10), '' ORDER BY s, p) AS listed FROM runs GROUP BY rid
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS joined FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.rid = w.rid AND w.i >= r.s + r.p AND w.i < r.s + r.m) GROUP BY rid
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(joined, '')) AS collapsed_sha256
FROM planted d LEFT JOIN summary USING (rid) LEFT JOIN kept USING (rid)
"""
