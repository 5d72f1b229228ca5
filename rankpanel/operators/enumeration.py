"""Combinations by number: tasks turn ranges of ranks into combinations, pruned while they grow (C-01, C-02).

The k-subsets of n names are numbered 0 .. C(n, k) - 1. A task takes ranges of numbers, finds the largest member of every
subset by one search in a column of binomials, then the next one in the column before, and so on: no join, no
enumeration on the driver, and any range can be redone by itself. How often a bucket or a parent occurs in what
has grown so far is counted in four bits of a long for each; a partial combination that breaks a limit, or whose remaining
picks cannot reach enough buckets, goes before it grows further.

Names (and their buckets and parents) are broadcast: MOST_NAMES at most, which is far more than can be combined.
A null or repeated name counts once; a name without a bucket enters no bucketed combination. Sizes above 15 or above
the number of names give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import parents_of

MOST_NAMES = 5000
RANGE = 1 << 16  # numbers turned into combinations at a time
LARGEST = 15
_ONES = np.uint64(0x1111111111111111)


def _packed(groups: list[list[int]], n: int) -> np.ndarray:
    """Row i: one count, four bits wide, for each group of name i, over as many longs as needed."""
    out = np.zeros((n, max((g for gs in groups for g in gs), default=0) // 16 + 1), np.uint64)
    for i, gs in enumerate(groups):
        for g in gs:
            out[i, g // 16] += np.uint64(1) << np.uint64(4 * (g % 16))
    return out


def _over(counts: np.ndarray, limit: int) -> np.ndarray:
    """Rows in which a count exceeds `limit` (at most 7; counts exceed it by one at most)."""
    return (((counts + _ONES * np.uint64(7 - limit)) & (_ONES << np.uint64(3))) != 0).any(axis=1)


def _distinct(counts: np.ndarray) -> np.ndarray:
    any_bit = counts | counts >> np.uint64(1) | counts >> np.uint64(2) | counts >> np.uint64(3)
    return np.bitwise_count(any_bit & _ONES).sum(axis=1)


def unrank(numbers: np.ndarray, n: int, k: int, limits: Sequence[tuple[np.ndarray, int]] = (), buckets: np.ndarray | None = None, need: int = 0) -> np.ndarray:
    """Members (ascending, one row each) of the k-subsets of 0..n-1 with these numbers that keep the limits.

    `limits`: (packed counts of every name, most of any). `need`: how many buckets a subset must touch.
    """
    table = np.array([[comb(c, j) for c in range(n + 1)] for j in range(k + 1)], np.int64)
    left = numbers.astype(np.int64)
    chosen = np.zeros((len(left), 0), np.int64)
    sums = [np.zeros((len(left), p.shape[1]), np.uint64) for p, _ in limits]
    seen = np.zeros((len(left), buckets.shape[1]), np.uint64) if buckets is not None else None
    for j in range(k, 0, -1):
        c = np.searchsorted(table[j], left, side="right") - 1
        left = left - table[j][c]
        keep = np.ones(len(c), bool)
        for i, (p, most) in enumerate(limits):
            sums[i] = sums[i] + p[c]
            keep &= ~_over(sums[i], most)
        if seen is not None:
            seen = seen + buckets[c]
            keep &= _distinct(seen) + (j - 1) >= need
        chosen = np.concatenate([c[:, None], chosen], axis=1)[keep]
        left = left[keep]
        sums = [s[keep] for s in sums]
        seen = seen[keep] if seen is not None else None
    return chosen


def combinations(names: DataFrame, sizes: Sequence[int], min_buckets: int = 0, max_per_bucket: int = 0, max_parent: int = 0) -> DataFrame:
    """(combo, names, size, n_buckets) of all combinations of `names.factor` with the given sizes; 0 means no such limit.

    With bucket limits `names.bucket` is read; at least min(size, min_buckets) buckets must be touched. `max_parent` limits
    how often a factor enters, by itself or inside a derived name. `n_buckets` is null without buckets.
    """
    spark = names.sparkSession
    if max(max_per_bucket, max_parent) > 7 or min(sizes, default=1) < 1:
        raise ValueError("limits go to 7, sizes start at 1")
    bucketed = min_buckets > 0 or max_per_bucket > 0
    d = names.where("factor IS NOT NULL").select("factor", (F.col("bucket") if bucketed else F.lit("")).alias("bucket"), F.array_distinct(parents_of("factor")).alias("parents"))
    rows = d.where("bucket IS NOT NULL").groupBy("factor").agg(F.min("bucket").alias("bucket"), F.first("parents").alias("parents")).limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    rows = sorted(rows, key=lambda r: r["factor"].encode())
    n = len(rows)
    number = lambda values: {v: i for i, v in enumerate(sorted(set(values)))}
    bucket_ids, parent_ids = number(r["bucket"] for r in rows), number(p for r in rows for p in r["parents"])
    per_bucket, per_parent = _packed([[bucket_ids[r["bucket"]]] for r in rows], n), _packed([[parent_ids[p] for p in r["parents"]] for r in rows], n)
    limits = [(per_bucket, max_per_bucket)] * (max_per_bucket > 0) + [(per_parent, max_parent)] * (max_parent > 0)
    shared = spark.sparkContext.broadcast(([r["factor"] for r in rows], per_bucket if bucketed else None, limits))
    if bucketed and len(bucket_ids) < min_buckets:
        sizes = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, buckets, caps = shared.value
        texts = pa.array(texts, pa.string())
        for b in batches:
            for size, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                got = unrank(np.arange(lo, hi), len(texts), size, caps, buckets, min(size, min_buckets))
                if not len(got):
                    continue
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * size), texts.take(pa.array(got.ravel())))
                touched = _distinct(sum((buckets[got[:, j]] for j in range(size)), np.uint64(0))).astype(np.int32) if buckets is not None else None
                yield pa.RecordBatch.from_arrays(
                    [pc.binary_join(lists, " + "), lists, pa.array(np.full(len(got), size, np.int32)), pa.nulls(len(got), pa.int32()) if touched is None else pa.array(touched)],
                    names=["combo", "names", "size", "n_buckets"],
                )

    work = [spark.range(-(-comb(n, k) // RANGE)).select(F.lit(k).alias("size"), (F.col("id") * RANGE).alias("lo"), F.least((F.col("id") + 1) * RANGE, F.lit(comb(n, k))).alias("hi")) for k in sorted(set(sizes)) if k <= min(n, LARGEST)]
    if not work:
        return spark.createDataFrame([], "combo string, names array<string>, size int, n_buckets int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return reduce(DataFrame.union, work).repartition(parts).mapInArrow(run, "combo string, names array<string>, size int, n_buckets int")
