"""Token ids in shards with a minimal perfect hash index: constant-time access by document key.

A shard is two files. `<name>.ids` is the raw payload: little-endian unsigned ids, documents back to back in
ascending key order; an id takes `width` bytes, 2 where the whole vocabulary fits and else 4. `<name>.idx` is an uncompressed numpy archive with: the keys in order (`keys`), a
minimal perfect hash of the distinct keys (`sizes`, `bits`, `ranks`: one bit array per level, keys that
collide on a level go on to the next, a key's slot is the number of set bits before its own), and per slot a
32-bit fingerprint (`prints`), the first document's place (`first`) and the number of documents of that key (`times`);
`starts` has the id offset of each document in order and the total; `width` the bytes of an id.

Shards are cut by range on (key, hash of the text), so neither order nor a repeated key gathers in one task.
Every task attempt writes files of its own name and returns one manifest row; the manifest is written
by Spark's committer, so lost executors, retries and speculative attempts leave at most files nobody names.

Null texts count as empty: the end id alone. A null key is stored as the smallest long and returned as
null. Repeated keys are kept, in the order of their text's hash. An empty table gives no shards and no rows.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import settle, small_batches
from .token_ids import END_ID, encoder

NULL_KEY = -(1 << 63)
MANIFEST = "name string, low long, high long, n_docs long, n_ids long"
LEVELS_WIDTH = 2  # bits per remaining key on each level


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finalizer of a key and a seed (constants of a common avalanche mix, fixed values)."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_index(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Index of keys in ascending order (repeats adjacent)."""
    distinct, first, times = np.unique(keys, return_index=True, return_counts=True)
    left, sizes, bits = distinct, [], []
    while len(left):
        size = -(-len(left) * LEVELS_WIDTH // 8) * 8
        at = (_mix(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    index = {"sizes": np.array(sizes, np.int64), "bits": np.packbits(flat, bitorder="little"), "ranks": np.r_[0, np.cumsum(flat.reshape(-1, 8).sum(1))].astype(np.int64)}
    slots = _slots(index, distinct)
    out = np.empty_like(first), np.empty_like(times), np.empty(len(distinct), np.uint32)
    for into, values in zip(out, (first, times, _prints(distinct))):
        into[slots] = values
    return index | {"first": out[0], "times": out[1], "prints": out[2]}


def _prints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 0) >> np.uint64(32)).astype(np.uint32)


def _slots(index: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where every level rules the key out; about two probes a key."""
    slots, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(index["sizes"].tolist(), 1):
        at = base + (_mix(keys[todo], level) % np.uint64(size)).astype(np.int64)
        byte = index["bits"][at >> 3]
        hit = (byte >> (at & 7).astype(np.uint8)) & 1 == 1
        below = np.bitwise_count(byte & ((1 << (at & 7)) - 1).astype(np.uint8))
        slots[todo[hit]] = (index["ranks"][at >> 3] + below)[hit]
        todo, base = todo[~hit], base + size
    return slots


def find(index: dict[str, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first document, number of documents) of each key; 0 documents where the stored fingerprint differs."""
    slots = _slots(index, keys)
    there = slots >= 0
    there[there] = index["prints"][slots[there]] == _prints(keys[there])
    at = np.where(there, slots, 0)
    if not len(index["first"]):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    return np.where(there, index["first"][at], 0), np.where(there, index["times"][at], 0)


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def write_shards(docs: DataFrame, vocabulary: Broadcast, root: str, end_id: int = END_ID) -> DataFrame:
    """Encode `docs` (doc_id, text) into shards under `root`; returns the settled manifest."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = keyed.repartitionByRange(parts, "key", "h").sortWithinPartitions("key", "h").select("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        enc, keys, sizes, out = encoder(vocabulary), [], [], None
        narrow = max(enc.largest_id, end_id) < 1 << 16
        store, folder = _open(root)
        name = uuid.uuid4().hex
        for b in batches:
            if out is None and b.num_rows:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{folder}/{name}.ids")
            keys += b.column(0).to_pylist()
            for ids in enc.encode(b.column(1), end_id):
                out.write(np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else ids)
                sizes.append(len(ids) // 4)
        if out is None:
            return
        out.close()
        order = np.array(keys, np.int64)
        packed = io.BytesIO()
        np.savez(packed, width=np.array(2 if narrow else 4), keys=order, starts=np.r_[0, np.cumsum(sizes)].astype(np.int64), **build_index(order))
        with store.open_output_stream(f"{folder}/{name}.idx") as f:
            f.write(packed.getbuffer())
        row = [name], [keys[0]], [keys[-1]], [len(keys)], [int(sum(sizes))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=["name", "low", "high", "n_docs", "n_ids"])

    return settle(small_batches(laid).mapInArrow(write, MANIFEST), "manifest")


class Shard:
    """One shard opened for keyed reads: the index in memory, the payload by ranges."""

    def __init__(self, root: str, name: str):
        store, folder = _open(root)
        with store.open_input_file(f"{folder}/{name}.idx") as f:
            self.index = dict(np.load(io.BytesIO(f.read())))
        self._payload = store.open_input_file(f"{folder}/{name}.ids")

    def documents(self, keys: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(position of the key asked for, start in the shard, ids of 4 bytes) of every document found."""
        starts, width = self.index["starts"], int(self.index["width"])
        for k, (first, times) in enumerate(zip(*find(self.index, keys))):
            for doc in range(first, first + times):
                a, b = int(starts[doc]), int(starts[doc + 1])
                self._payload.seek(width * a)
                yield k, a, np.frombuffer(self._payload.read(width * (b - a)), f"<u{width}").astype("<u4").tobytes()

    def close(self) -> None:
        self._payload.close()


def read_all(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Every stored document through the index: doc_id, start over all shards, n_tokens, ids_crc32."""
    before = W.partitionBy(F.lit(1)).orderBy("low", "high").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    offsets = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files = offsets.select("name", "base").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, base in zip(pdf["name"], pdf["base"]):
                shard = Shard(root, name)
                keys = np.unique(shard.index["keys"])
                rows = [(int(keys[k]), base + start, len(raw) // 4, zlib.crc32(raw)) for k, start, raw in shard.documents(keys)]
                shard.close()
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    got = files.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return got.withColumn("doc_id", F.when(F.col("doc_id") != NULL_KEY, F.col("doc_id")))


def lookup(manifest: DataFrame, root: str, keys: list[int]) -> dict[int, list[bytes]]:
    """Ids of the documents of a few keys, read from the shards whose range holds them."""
    found: dict[int, list[bytes]] = {k: [] for k in keys}
    want = np.array(keys, np.int64)
    near = F.lit(False)
    for k in keys:
        near = near | F.lit(k).between(F.col("low"), F.col("high"))
    for row in manifest.where(near).orderBy("low", "high").collect():
        shard = Shard(root, row["name"])
        for k, _, raw in shard.documents(want):
            found[keys[k]].append(raw)
        shard.close()
    return found
