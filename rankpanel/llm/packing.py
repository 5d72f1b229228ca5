"""Best-two-fit packing of token pieces into sequences of a fixed size.

A bin is filled greedily with the longest piece that still fits; then its smallest piece is exchanged for
two unpacked pieces that fill the widened gap more tightly, as long as such a pair exists. What a bin looks
like depends on the lengths alone, so the choice is made on the histogram of lengths (at most `size` rows,
whatever the corpus): a filling repeats until one of its lengths runs out, which gives a short list of
fillings with copy counts. Rows are then dealt to the fillings' slots by their position within their
length; no group of equal lengths is sorted or gathered.

Null texts count as empty and yield the end id alone. Repeated rows are packed as separate documents.
Columns of the input other than `doc_id` and `text` are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import numbered, small_batches
from .token_ids import END_ID, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the shorter one first."""
    first = (total - 1) % size + 1
    return [(0, first)] + [(s, size) for s in range(first, total, size)]


def token_pieces(docs: DataFrame, vocabulary: Broadcast, size: int, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece of every document; `keep_ids` adds the raw ids (little-endian, 4 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1), end_id)):
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    raw = ids[4 * start : 4 * (start + length)]
                    for c, v in zip(cols, (doc, k, start, length, zlib.crc32(raw), raw)):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], kinds)], names=names[:n])

    return small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Fillings and how often each is used. Copies taken together are what one-by-one packing would choose."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 1 <= length <= size:
            raise ValueError(f"piece of length {length} for sequences of {size}")
        left[length] += n
    every = np.arange(size + 1)
    out = []
    while left.any():
        bin_: list[int] = []
        gap, free = size, left.copy()

        def largest(most: int) -> int:
            at = np.flatnonzero(free[: most + 1])
            return int(at[-1]) if len(at) else 0

        while gap and (x := largest(gap)):
            bin_.append(x)
            free[x] -= 1
            gap -= x
        while gap:
            small = min(bin_)
            room = gap + small
            below = np.maximum.accumulate(np.where(free > 0, every, 0))  # largest free length up to x
            a = np.flatnonzero(free[: min(room, size) + 1])
            b = below[np.minimum(a, room - a)]
            b = np.where((b == a) & (free[a] < 2), below[np.maximum(a - 1, 0)], b)
            total = np.where((b > 0) & (a + b <= room), a + b, 0)
            if not len(a) or (k := int(total.argmax()), total[k])[1] <= small:
                break
            bin_.remove(small)
            free[small] += 1
            for x in (int(a[k]), int(b[k])):
                bin_.append(x)
                free[x] -= 1
            gap = room - int(total[k])
        need = np.bincount(bin_, minlength=size + 1)
        used = np.flatnonzero(need)
        copies = int((left[used] // need[used]).min())
        left -= need * copies
        out.append((bin_, copies))
    return out


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Adds `sequence_id` and `offset` to pieces with a `length` of 1..size."""
    ranked = numbered(pieces, "length")
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int]]] = {}  # length -> (first rank, first sequence, offset)
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, copies in best_two_fit(counts, size):
        at = 0
        for x in lengths:
            slots.setdefault(x, []).append((taken.get(x, 0), sequence, at))
            taken[x] = taken.get(x, 0) + copies
            at += x
        sequence += copies
    shared = pieces.sparkSession.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in slots.items()})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for length, rows in pdf.groupby("length").indices.items():
                s, r = shared.value[int(length)], pdf["rank"].to_numpy()[rows]
                k = np.searchsorted(s[:, 0], r, side="right") - 1
                seq[rows], off[rows] = s[k, 1] + r - s[k, 0], s[k, 2]
            yield pdf.drop(columns="rank").assign(sequence_id=seq, offset=off)

    kept = [(c, t) for c, t in ranked.dtypes if c != "rank"]
    return ranked.mapInPandas(place, ", ".join(f"`{c}` {t}" for c, t in kept) + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ids joined by offset; a group is one sequence, so at most `size` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "").alias("h")).select(
        "sequence_id", F.unhex("h").alias("ids")
    )
