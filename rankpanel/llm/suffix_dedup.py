"""Removal of repeated 200-byte strings from whole texts, by a distributed difference-cover suffix order.

1. Synchronising places. A place is a sample if the hash of its 8 bytes is least among its 28 neighbours on either side. That
   depends on the 64 bytes around it alone, so equal texts have equal samples. Each 200-byte window belongs to the first
   sample that it shows with these 64 bytes; windows without one (long periodic stretches) are compared as they stand.
2. Only windows whose sample has its 64 bytes elsewhere too can repeat. Where the whole hull of a sample's windows
   stands elsewhere, and all others of these 64 bytes do so, the windows repeat, and nothing is left to sort. The rest,
   near the ends of repeats, goes on as strings of phrases (the bytes from one sample to the next with its 64 bytes; no phrase
   is the beginning of another one, so phrases order like the bytes they stand for).
3. `suffix_ranks` orders the suffixes of these strings: triples of names at two of three places are sorted, named, and the
   strings of names are ordered in the same way, until a name covers more than 200 bytes; the places left out are merged by
   their own name and the rank of the sample behind them.
4. Neighbours in that order are compared byte by byte, to the right and to the left. Windows which that leaves open are suffixes
   between samples: they are merged by (bytes to their sample, its rank), and neighbours' prefixes are compared.

A window is known by 64-bit digests of its bytes. Key lists are exchanged as blocks of distinct keys, so a passage of a
third of all texts is one key a block. Key states are broadcast up to `most_keys`, beyond it they are joined by document.

A null text counts as empty: no bytes, nothing removed. Repeated rows are documents of their own, and remove each other. A null
doc_id stays null. Extra columns are ignored; an empty table gives an empty result. A task holds about 60 bytes for
each byte of the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import settle, small_batches

LENGTH = 200  # bytes of a string that may not repeat
GRAM, REACH = 8, 28
BEHIND = REACH + GRAM  # bytes from a sample to the end of what decides on it
FARTHEST = LENGTH - BEHIND  # from a window's start to its sample
PHRASE = LENGTH + 1
PART = 2 << 20  # bytes looked at in one go
HELD = 1 << 21  # keys that a task gathers before it hands them on
MOST_KEYS = 4_000_000
MOST_SIDE = 1_000_000  # documents with removed bytes whose spans are broadcast
CLOSED, OPEN, TWIN, STRAY = 1, 2, 3, 4  # windows repeat; to be ordered; hull of an open context that repeats; none can repeat
_BASE = 0x9E3779B97F4A7C15
_HULL, _ALONE = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
NONE = np.uint64(0)


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer (constants of a common avalanche mix, fixed values)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least `n` of them."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, PART)
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64), dtype=np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


class Digests:
    """Digests of byte ranges of a buffer: sums of mixed 8-byte grams times powers, brought to a common origin."""

    def __init__(self, raw: bytes):
        n = len(raw)
        self.grams = _mixed(np.ndarray((max(0, n - GRAM + 1),), "<u8", raw, strides=(1,)) * np.uint64(_BASE)) if n >= GRAM else np.zeros(0, np.uint64)
        powers, self._back = _powers(n + 1)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.grams * powers[: len(self.grams)], dtype=np.uint64)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of bytes a..b-1, 8 at least."""
        return _mixed((self._sums[b - GRAM + 1] - self._sums[a]) * self._back[a] + (b - a).astype(np.uint64))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minima over `width` values from each place on (shorter at the end)."""
    m, k = h.copy(), 1
    while 2 * k <= width:
        m[:-k] = np.minimum(m[:-k], m[k:])
        k *= 2
    if k < width and width - k < len(m):
        m[: k - width] = np.minimum(m[: k - width], m[width - k :])
    return m


class Parsed:
    """Samples and windows of texts laid end to end (each of LENGTH bytes or more)."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.digests = Digests(self.raw)
        h = (self.digests.grams >> np.uint64(32)).astype(np.uint32)
        low = _least(h, REACH)
        at = np.arange(REACH, max(REACH, len(h) - REACH))
        at = at[(h[at] < low[at - REACH]) & (h[at] <= low[at + 1])]
        doc = np.searchsorted(self.ends, at, side="right")
        inside = (at - REACH >= self.starts[doc]) & (at + BEHIND <= self.ends[doc])
        self.at, self.doc = at, doc = at[inside], doc[inside]
        head = np.ones(len(at), bool)
        head[1:] = doc[1:] != doc[:-1]
        self.head = head
        low_end = self.starts[doc]
        self.free = np.where(head, low_end, np.concatenate([[0], at[:-1]])[: len(at)] - REACH + 1)  # first window behind those of the sample before
        self.free = np.maximum(self.free, low_end)
        self.lo = np.maximum(self.free, at - FARTHEST)
        self.hi = np.minimum(at - REACH, self.ends[doc] - LENGTH)
        self.context = self.digests.of(at - REACH, at + BEHIND)
        has = self.hi >= self.lo
        self.hull = np.full(len(at), NONE)
        lo, hi = self.lo[has], self.hi[has]
        self.hull[has] = _mixed(self.digests.of(lo, hi + LENGTH) ^ ((at[has] - lo).astype(np.uint64) * np.uint64(256) + _HULL)) | np.uint64(1)

    def alone(self) -> np.ndarray:
        """Starts of windows that show no sample."""
        tail = np.ones(len(self.at), bool)
        tail[:-1] = self.head[1:]
        without = np.setdiff1d(np.arange(len(self.ends)), self.doc[tail], assume_unique=True)
        a = np.concatenate([self.free, self.at[tail] - REACH + 1, self.starts[without]])
        last = self.ends - LENGTH
        b = np.concatenate([np.minimum(self.at - FARTHEST - 1, last[self.doc]), last[self.doc[tail]], last[without]])
        a = np.maximum(a, 0)
        n = np.maximum(0, b - a + 1)
        return np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def alone_keys(self, at: np.ndarray) -> np.ndarray:
        return _mixed(self.digests.of(at, at + LENGTH) ^ _ALONE)


def _parts(texts: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Groups of (..., bytes) of about PART bytes; texts shorter than LENGTH are left out."""
    group, held = [], 0
    for row in texts:
        if len(row[-1]) < LENGTH:
            continue
        group.append(row)
        held += len(row[-1])
        if held >= PART:
            yield group
            group, held = [], 0
    if group:
        yield group


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _distinct_pairs(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, hull) rows in order and how often each came, 2 standing for more."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs, times = pairs[order], times[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    return pairs[first], np.minimum(2, np.add.reduceat(times, first)) if len(first) else times


def key_states(docs: DataFrame) -> DataFrame:
    """(key, state), settled, of the contexts that stand at two places or more and of twin hulls among open ones."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def hand_on() -> pa.RecordBatch:
            pairs, times = _distinct_pairs(np.concatenate(held), np.ones(sum(map(len, held)), np.int64))
            bucket = (pairs[:, 0] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            pairs, times, bucket = pairs[order], times[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            blobs = np.split(np.arange(len(pairs)), cut[1:])
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[cut]), *(pa.array([pairs[rows[times[rows] == k]].tobytes() for rows in blobs], pa.binary()) for k in (1, 2))], names=["bucket", "once", "more"]
            )

        texts = ((_bytes(t),) for b in batches for t in b.column(0).to_pylist())
        for group in _parts(texts):
            p = Parsed([t for t, in group])
            alone = p.alone_keys(p.alone())
            held += [np.stack([p.context, p.hull], axis=1), np.stack([alone, alone | np.uint64(1)], axis=1)]
            if sum(map(len, held)) > HELD:
                yield hand_on()
        if sum(map(len, held)):
            yield hand_on()

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        blobs = [[np.frombuffer(x, np.uint64).reshape(-1, 2) for x in pdf[c]] for c in ("once", "more")]
        raw = np.concatenate(blobs[0] + blobs[1])
        times = np.repeat([1, 2], [sum(map(len, b)) for b in blobs])
        pairs, times = _distinct_pairs(raw, times)
        first = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]]))
        total = np.add.reduceat(times, first)
        with_windows = pairs[:, 1] != NONE
        single = np.add.reduceat((with_windows & (times == 1)).astype(np.int64), first) > 0
        shown = np.add.reduceat(np.where(with_windows, times, 0), first) > 1
        state = np.where(total < 2, 0, np.where(~single, CLOSED, np.where(shown, OPEN, STRAY)))
        twin = np.repeat(state == OPEN, np.diff(np.append(first, len(pairs)))) & with_windows & (times == 2)
        known = state > 0
        keys = np.concatenate([pairs[first[known], 0], pairs[twin, 1]])
        return pd.DataFrame({"key": keys.view(np.int64), "state": np.concatenate([state[known], np.full(twin.sum(), TWIN)]).astype(np.int32)})

    found = small_batches(docs.select("text")).mapInArrow(gather, "bucket long, once binary, more binary")
    return settle(found.groupBy("bucket").applyInPandas(decide, "key long, state int"), "key_states")


class States:
    """States of keys, looked up in sorted arrays."""

    def __init__(self, keys: np.ndarray, states: np.ndarray):
        order = np.argsort(keys)
        self._keys, self._states = keys[order], states[order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self._keys):
            return np.zeros(len(keys), np.int8)
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._states[at], 0)


SAMPLES = "h long, g int, lo int, hi int, sid long, pos long, p int, witness boolean, c long, n int, bytes binary"


def _samples(group: list[tuple], states: States, at: int) -> tuple[list[dict], int]:
    """Columns of SAMPLES of texts (h, g, bytes): decided windows lo..hi (`pos` null), and elements of the strings to order."""
    p = Parsed([t for *_, t in group])
    state = states.of(p.context)
    has = p.hull != NONE
    asked = has & (state == OPEN)
    twin = np.zeros(len(state), bool)
    twin[asked] = states.of(p.hull[asked]) == TWIN
    sure = has & ((state == CLOSED) | twin)
    alone = p.alone()
    alone = alone[states.of(p.alone_keys(alone)) == CLOSED]
    lo, hi = np.concatenate([p.lo[sure], alone]), np.concatenate([p.hi[sure], alone])
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], hi[order]
    doc = np.searchsorted(p.ends, lo, side="right")
    if len(lo):  # windows of one text that follow each other are one row
        new = np.ones(len(lo), bool)
        new[1:] = (lo[1:] > hi[:-1] + 1) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        lo, hi, doc = lo[first], np.maximum.reduceat(hi, first), doc[first]
    h, g = np.array([r[0] for r in group], np.int64), np.array([r[1] for r in group], np.int32)
    out = [{"h": h[doc], "g": g[doc], "lo": lo - p.starts[doc], "hi": hi - p.starts[doc]}] if len(lo) else []
    # elements: open samples and what follows them within a window's length
    last = np.maximum.accumulate(np.where(asked, p.at, -LENGTH)) if len(p.at) else p.at
    needed = (state > 0) & (p.at - last < LENGTH) & (last >= p.starts[p.doc])
    k = np.flatnonzero(needed)
    if not len(k):
        return out, at
    ahead = np.append(p.at[1:], 0)
    follows = np.append(~p.head[1:], False) & (ahead - p.at <= FARTHEST + 1)
    ends = p.ends[p.doc]
    until = np.where(follows, ahead + BEHIND, np.minimum(ends, p.at + PHRASE))
    joined = np.zeros(len(k), bool)
    joined[1:] = (k[1:] == k[:-1] + 1) & follows[k[:-1]]
    start = np.flatnonzero(~joined)
    sizes = np.diff(np.append(start, len(k)))
    base = at + np.cumsum(sizes) - sizes
    sid = np.repeat(base, sizes)
    pos = at + np.arange(len(k))
    a, d = p.at[k], p.doc[k]
    s = p.starts[d]
    origin = np.where(asked[k], p.lo[k], a)
    stop = np.minimum(ends[k], a + PHRASE)
    raw = [p.raw[x:y] for x, y in zip(origin.tolist(), stop.tolist())]
    found = {"h": h[d], "g": g[d], "lo": origin - s, "hi": np.where(asked[k], p.hi[k] - s, -1), "sid": sid, "pos": pos, "p": a - s, "witness": twin[k], "c": p.digests.of(a, until[k]).view(np.int64), "n": until[k] - a, "bytes": raw}
    return [*out, found], at + len(k)


def samples(docs: DataFrame, states: DataFrame, most_keys: int = MOST_KEYS) -> DataFrame:
    """SAMPLES of all documents, settled. `docs`: h, g, text."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = {c.split()[0]: kinds[c.split()[1]] for c in SAMPLES.split(", ")}
    spark = docs.sparkSession
    shared = None
    if states.count() <= most_keys:
        rows = states.toArrow()
        shared = spark.sparkContext.broadcast((rows["key"].to_numpy().view(np.uint64), rows["state"].to_numpy().astype(np.int8)))
        texts = docs.select("h", "g", "text", F.lit(None).cast("array<struct<key:bigint,state:int>>").alias("known"))
    else:

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((h, g, _bytes(t)) for b in batches for h, g, t in zip(*(c.to_pylist() for c in b.columns)))
            for group in _parts(rows):
                for h, g, t in group:
                    p = Parsed([t])
                    keys = np.unique(np.concatenate([p.context, p.hull, p.alone_keys(p.alone())])).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), h)), pa.array(np.full(len(keys), g, np.int32)), pa.array(keys)], names=["h", "g", "key"])

        keyed = small_batches(docs.select("h", "g", "text").dropDuplicates(["h", "g"])).mapInArrow(own, "h long, g int, key long")
        known = keyed.join(states, "key").groupBy("h", "g").agg(F.collect_list(F.struct("key", "state")).alias("known"))  # keys of one text
        texts = docs.join(known, ["h", "g"]).select("h", "g", "text", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        everywhere = States(*shared.value) if shared else None
        rows = ((h, g, k, _bytes(t)) for b in batches for h, g, t, k in zip(*(c.to_pylist() for c in b.columns)))
        for group in _parts(rows):
            for some in [group] if shared else [[r] for r in group]:
                states = everywhere or States(np.array([k["key"] for k in some[0][2]], np.int64).view(np.uint64), np.array([k["state"] for k in some[0][2]], np.int8))
                got, at = _samples([(h, g, t) for h, g, _, t in some], states, at)
                for cols in got:
                    n = len(cols["h"])
                    yield pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in types.items()], names=list(types))

    return settle(small_batches(texts).mapInArrow(run, SAMPLES), "samples")


def ordered(keys: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Distinct rows of `by` in order: every column of `sums` replaced by its sum over all smaller keys."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, total = TaskContext.get().partitionId(), np.zeros(len(sums), np.int64)
        for pdf in batches:
            own = pdf[sums].to_numpy(np.int64)
            upto = np.cumsum(own, axis=0) + total
            before = upto - own
            total = upto[-1] if len(own) else total
            yield pdf.assign(part=part, **{c: before[:, k] for k, c in enumerate(sums)}, **{f"own_{c}": own[:, k] for k, c in enumerate(sums)})

    types = dict(keys.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), *(f"{c} long, own_{c} long" for c in sums), "part int"])
    sorted_keys = keys.select(*by, *sums).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    laid = settle(sorted_keys.mapInPandas(run, schema), "ordered")
    ends = laid.groupBy("part").agg(*[F.sum(f"own_{c}").alias(c) for c in sums])
    earlier = W.partitionBy(F.lit(1)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    offsets = ends.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"o_{c}") for c in sums])
    return laid.join(offsets, "part").select(*by, *[(F.col(c) + F.col(f"o_{c}")).alias(c) for c in sums])


def suffix_ranks(strings: DataFrame, levels: int) -> DataFrame:
    """(sid, pos, rank) of every suffix of the strings (sid, pos, c): the number of smaller ones and 1. Names c start at 1.

    A string's places are sid, sid + 1, ... Equal suffixes share a rank. Those that 3 ** levels names (four levels
    at most) do not tell apart stay together, in any order.
    """
    return _ranks(strings, levels, 0)


def _ranks(strings: DataFrame, levels: int, depth: int) -> DataFrame:
    along = W.partitionBy("sid").orderBy("pos")
    ahead = lambda c, k: F.coalesce(F.lead(c, k).over(along), F.lit(0).cast("long"))
    kind = (F.col("pos") - F.col("sid")) % 3
    rows = settle(strings.select("sid", "pos", "c", ahead("c", 1).alias("c1"), ahead("c", 2).alias("c2"), kind.cast("int").alias("kind")), "triples")
    sampled = rows.where("kind > 0")
    triple = ["c", "c1", "c2"]
    distinct = settle(sampled.groupBy(*triple).agg(F.count(F.lit(1)).alias("times")), "distinct")
    names = ordered(distinct.withColumn("name", F.lit(1).cast("long")), triple, ["name", "times"])  # before: distinct triples, places
    named = sampled.join(names, triple)
    repeats = not distinct.where("times > 1").isEmpty()
    if repeats and levels > 1:
        shift = 3 << (54 + 3 * depth)
        inner_sid = F.col("sid") + F.col("kind") * F.lit(shift)
        inner = named.select("pos", inner_sid.alias("sid"), (inner_sid + F.floor((F.col("pos") - F.col("sid")) / 3)).cast("long").alias("inner"), (F.col("name") + 1).alias("c"))
        inner = settle(inner, "names")
        found = _ranks(inner.select("sid", F.col("inner").alias("pos"), "c"), levels - 1, depth + 1)
        ranked = inner.join(found.select(F.col("pos").alias("inner"), "rank"), "inner").select("pos", F.col("rank").alias("r"))
    else:
        ranked = named.select("pos", (F.col("times") + 1).alias("r"))
    # what is left out is merged: against places of kind 1 by (name, rank behind), against kind 2 by two names
    full = rows.join(ranked, "pos", "left")
    full = settle(full.select("sid", "pos", "kind", "c", "c1", "r", ahead("r", 1).alias("r1"), ahead("r", 2).alias("r2")), "merged")
    short, wide = ["c", "r1"], ["c", "c1", "r2"]
    is_kind = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0))
    one = ordered(full.where("kind < 2").groupBy(*short).agg(is_kind(0).alias("b0"), is_kind(1).alias("b1")), short, ["b0", "b1"])
    two = ordered(full.where("kind <> 1").groupBy(*wide).agg(is_kind(0).alias("d0"), is_kind(2).alias("d2")), wide, ["d0", "d2"])
    out = full.join(one, short, "left").join(two, wide, "left")
    rank = F.when(F.col("kind") == 0, F.lit(1) + F.col("b0") + F.col("b1") + F.col("d2")).when(F.col("kind") == 1, F.col("r") + F.col("b0")).otherwise(F.col("r") + F.col("d0"))
    return settle(out.select("sid", "pos", rank.alias("rank")), "ranks")


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Equal leading bytes of each row of a padded matrix and the row before; the first has none before."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        differs = np.concatenate([differs, np.ones((len(differs), 1), bool)], axis=1)
        out[1:] = np.minimum(differs.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))
    return out


def _padded(blobs: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(b[:width].ljust(width, b"\0") for b in blobs), np.uint8).reshape(len(blobs), width)


WINDOWS = "key long, rank long, digest long, sure boolean, h long, g int, lo int, hi int, witness boolean"


def _turn(rows: pd.DataFrame, skip: int, final: bool) -> pd.DataFrame:
    """WINDOWS of rows in suffix order: decided ones, and those that stay open. The first `skip` rows and, unless `final`, the last one only serve as neighbours."""
    p, lo, hi = (rows[c].to_numpy(np.int64) for c in ("p", "lo", "hi"))
    blobs, bucket = rows["bytes"].tolist(), rows["bucket"].to_numpy()
    left = p - lo
    sizes = np.array([len(b) for b in blobs], np.int64)
    right = _common(_padded([b[k:] for b, k in zip(blobs, left.tolist())], PHRASE), sizes - left)
    back = _common(_padded([b[:k][::-1] for b, k in zip(blobs, left.tolist())], FARTHEST), left)
    edge = np.ones(len(rows) + 1, bool)  # between buckets the neighbour is elsewhere
    edge[1:-1] = bucket[1:] != bucket[:-1]
    most = np.maximum(np.where(edge[:-1], LENGTH, right), np.where(edge[1:], LENGTH, np.append(right[1:], 0)))
    far, near = left, p - hi  # greatest and least distance from a window to its sample
    low = np.maximum(near, LENGTH - most)  # nearer ones reach further to the right than any neighbour agrees
    # windows that a row and the one before both show
    pair_lo, pair_hi = np.maximum(LENGTH - right, near), np.minimum(back, far)
    pair_lo[1:], pair_hi[1:] = np.maximum(pair_lo[1:], near[:-1]), np.minimum(pair_hi[1:], far[:-1])
    pair = pair_lo <= pair_hi
    pair[0] = False
    h, g, witness = rows["h"].to_numpy(np.int64), rows["g"].to_numpy(np.int32), rows["witness"].to_numpy(bool)
    told = np.flatnonzero(pair)
    row, span = np.concatenate([told, told - 1]), np.tile(told, 2)
    row, span = row[~witness[row]], span[~witness[row]]
    sure = pd.DataFrame({"key": h[row] ^ p[row], "rank": 0, "digest": 0, "sure": True, "h": h[row], "g": g[row], "lo": p[row] - pair_hi[span], "hi": p[row] - pair_lo[span], "witness": False})
    # the row before keeps the windows of a pair open for others; this one gives the rest
    width = np.maximum(0, far - low + 1)
    width[:skip] = 0
    if not final:
        width[-1] = 0
    row = np.repeat(np.arange(len(rows)), width)
    d = low[row] + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    rest = ~(pair[row] & (d >= pair_lo[row]) & (d <= pair_hi[row]))
    row, d = row[rest], d[rest]
    at = (np.cumsum(sizes) - sizes + left)[row]
    digests = Digests(b"".join(blobs))
    key = _mixed(digests.of(at - d, at) + d.astype(np.uint64)).view(np.int64)
    windows = pd.DataFrame({"key": key, "rank": rows["rank"].to_numpy(np.int64)[row], "digest": digests.of(at - d, at - d + LENGTH).view(np.int64), "sure": False, "h": h[row], "g": g[row], "lo": p[row] - d, "hi": p[row] - d, "witness": witness[row]})
    return pd.concat([sure, windows], ignore_index=True) if len(sure) else windows


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in suffix order -> WINDOWS. The last row waits for the one behind it, and the one before it goes along."""
    held, skip = None, 0
    for pdf in batches:
        rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if len(rows) > 1:
            yield _turn(rows, skip, False)
            rows, skip = rows.iloc[-2:].reset_index(drop=True), 1
        held = rows if len(rows) else held
    if held is not None and len(held):
        yield _turn(held, skip, True)


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows in the order (key, rank) -> those whose neighbour has the same prefix; decided ones pass."""
    last = None
    for pdf in batches:
        sure = pdf["sure"].to_numpy(bool)
        yield pdf.loc[sure, ["h", "g", "lo", "hi"]]
        rows = pdf[~sure]
        if last is not None:
            rows = pd.concat([last, rows], ignore_index=True)
        if not len(rows):
            continue
        key, digest = rows["key"].to_numpy(), rows["digest"].to_numpy()
        same = (key[1:] == key[:-1]) & (digest[1:] == digest[:-1])
        found = np.append(False, same) | np.append(same, False)
        yield rows.loc[found & ~rows["witness"].to_numpy(bool), ["h", "g", "lo", "hi"]]
        last = rows.iloc[-1:].reset_index(drop=True)


def repeated_windows(docs: DataFrame, most_keys: int = MOST_KEYS) -> DataFrame:
    """(h, g, lo, hi): starts of strings of LENGTH bytes that stand elsewhere too. `docs`: h, g (of the text), text."""
    rows = samples(docs, key_states(docs), most_keys)
    elements = rows.where("pos IS NOT NULL")
    phrases = elements.select(F.expr("substring(bytes, p - lo + 1, n)").alias("phrase"), "c").distinct()
    named = ordered(phrases.withColumn("name", F.lit(1).cast("long")), ["phrase", "c"], ["name"]).select("c", (F.col("name") + 1).alias("name"))
    strings = elements.select("sid", "pos", "c").join(named, "c").select("sid", "pos", F.col("name").alias("c"))
    ranks = suffix_ranks(strings, levels=2)  # nine phrases: more than 9 * 28 bytes
    total = max(1, ranks.count())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = elements.where("hi >= lo").join(ranks.select("pos", "rank"), "pos")
    wide = wide.withColumn("bucket", F.floor((F.col("rank") - 1) * parts / total).cast("int"))
    in_order = wide.select("bucket", "rank", "pos", "h", "g", "p", "lo", "hi", "witness", "bytes").repartition(parts, "bucket").sortWithinPartitions("bucket", "rank", "pos")
    windows = in_order.mapInPandas(_neighbours, WINDOWS)
    merged = windows.repartition(parts, "key").sortWithinPartitions("key", "rank").mapInPandas(_merged, "h long, g int, lo int, hi int")
    return rows.where("pos IS NULL").select("h", "g", "lo", "hi").union(merged)


def _spans(starts: list) -> np.ndarray:
    """Byte spans (from, to) that the windows at `starts` (lo, hi) cover, joined where they touch."""
    a = np.array([(r["lo"], r["hi"] + LENGTH) for r in starts], np.int64)
    a = a[np.argsort(a[:, 0], kind="stable")]
    far = np.maximum.accumulate(a[:, 1])
    new = np.append(True, a[1:, 0] > far[:-1])
    first = np.flatnonzero(new)
    return np.stack([a[first, 0], np.append(far[first[1:] - 1], far[-1])], axis=1)


def dedup(docs: DataFrame, most_keys: int = MOST_KEYS, most_side: int = MOST_SIDE, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with `keep_text` the bytes left."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.hash("text", F.length("text")).alias("g"), "text")
    covered = repeated_windows(keyed.select("h", "g", "text"), most_keys).distinct()
    side = settle(covered.groupBy("h", "g").agg(F.collect_list(F.struct("lo", "hi")).alias("starts")), "covered")  # windows of one text
    texts, spans = side.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()
    small = texts <= most_side and spans <= 8 * most_side
    texts = keyed.join(F.broadcast(side) if small else side, ["h", "g"], "left").select("doc_id", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text, starts in zip(*(c.to_pylist() for c in b.columns)):
                raw = _bytes(text)
                spans = _spans(starts) if starts else np.zeros((0, 2), np.int64)
                edges = [0, *spans.ravel().tolist(), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
                out.append((doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            n = 6 if keep_text else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:n])

    return small_batches(texts).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))


ORACLE = """
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), windows AS (
  SELECT rid, i, md5(substr(x, 2 * i + 1, 400)) AS w FROM (SELECT rid, x, unnest(range(CAST(length(x) // 2 - 199 AS BIGINT))) AS i FROM docs WHERE length(x) >= 400)
), repeated AS (
  SELECT rid, i FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)
), ends AS (
  SELECT rid, i, max(i) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 200 AS reach FROM repeated
), parts AS (
  SELECT rid, i, sum(CASE WHEN reach >= i THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS k FROM ends
), spans AS (
  SELECT rid, k, min(i) AS a, max(i) + 200 AS b FROM parts GROUP BY rid, k
), gaps AS (
  SELECT rid, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS before FROM spans
), kept AS (
  SELECT g.rid, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM gaps g JOIN docs d ON d.rid = g.rid GROUP BY g.rid
)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""
