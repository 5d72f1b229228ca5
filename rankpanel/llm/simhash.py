"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints at 3 or fewer differing bits share at least 5 of their 8 positional bytes. The bytes
are indexed by position; postings are kept under three positions at a time (all triples inside bytes 0-3
and inside bytes 4-7), because any 5 shared positions contain such a triple, while the list of a single
byte value would hold 1/256 of the corpus. Within a list the shared positional bytes of each pair are tallied,
pairs that reach the guaranteed 5 are kept, and their differing bits are counted.

Equal fingerprints are one entry of the index. Long lists are dealt as block pairs, so no task holds a whole
list and no pair is lost; a task hands on a spanning forest of the links that it verified, not the pairs.
Components come from alternating large-star and small-star steps, each settled in the shared folder.

Null and empty texts have fingerprint zero and link like any other. Repeated rows stay, one output row each.
Extra columns are ignored; an empty table gives an empty result. A null doc_id counts only if no other is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import settle, small_batches

SHINGLE, SEED, MAX_BITS = 3, 42, 3
MIN_BYTES = 8 - MAX_BITS
TRIPLES = [(a, b, c) for half in (0, 4) for a in range(half, half + 4) for b in range(a + 1, half + 4) for c in range(b + 1, half + 4)]
BLOCK = 1000  # rows of a posting list in one block


def fingerprint(text: str | None) -> int:
    """Unsigned SimHash of a whole text: bit set if set in over half of the shingle hashes."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), max(1, len(words) - SHINGLE + 1)
    for lo in range(0, n, 50_000):
        hashes = np.array([digest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(lo, min(n, lo + 50_000))], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id, fp) and the columns `extra`: the fingerprint as a signed long with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], names=["doc_id", "fp", *extra])

    types = dict(docs.dtypes)
    schema = ", ".join(["doc_id long, fp long", *(f"`{c}` {types[c]}" for c in extra)])
    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)).mapInArrow(run, schema)


def _forest(cells: np.ndarray, fps: np.ndarray) -> dict[int, int]:
    """Spanning forest (fingerprint -> smallest linked one) of the verified pairs that share a cell."""
    order = np.argsort(cells, kind="stable")
    cells, fps = cells[order], fps[order]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    width = int(np.diff(np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])).max(initial=1))
    live = np.arange(len(cells))
    for d in range(1, width):
        live = live[live + d < len(cells)]
        live = live[cells[live] == cells[live + d]]  # only lists longer than d go on
        if not len(live):
            break
        x = fps[live] ^ fps[live + d]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)  # tally of positional bytes
        near = live[(shared >= MIN_BYTES) & (np.bitwise_count(x) <= MAX_BITS) & (x != 0)]
        for a, b in zip(fps[near].tolist(), fps[near + d].tolist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root) if find(x) != x}


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what the verified pairs connect; `fps`: settled, one column of distinct fp."""
    keys = [F.struct(F.lit(i).alias("slot"), sum((F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255) * (1 << (8 * j)) for j, p in enumerate(t)), F.lit(0)).alias("value")) for i, t in enumerate(TRIPLES)]
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", (F.col("k.value") * 8 + F.col("k.slot")).alias("key"))
    lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK)
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    cells = (
        postings.join(lists, "key")
        .withColumn("blocks", blocks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("fp", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"))
    )
    groups = 4 * int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _forest(pdf["cell"].to_numpy(), pdf["fp"].to_numpy())
        return pd.DataFrame({"u": list(found), "v": list(found.values())}, dtype="int64")

    return cells.withColumn("g", F.pmod(F.col("cell"), F.lit(groups))).groupBy("g").applyInPandas(verify, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest node of its component."""
    e, last = settle(edges.where("u <> v"), "edges"), None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select("v", "m").where("v <> m").union(low).distinct().toDF("u", "v")
        e = settle(small, "stars")
        mark = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == last:
            break
        last = mark
    return e.toDF("node", "root").union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def rooted(first: DataFrame) -> DataFrame:
    """A settled table of distinct `fp` with `root`, the same for all fingerprints of a component and for no others."""
    found = first.join(components(links(first.select("fp"))), F.col("fp") == F.col("node"), "left")
    return settle(found.select(*first.columns, F.coalesce("root", "fp").alias("root")), "roots")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs`."""
    marked = settle(fingerprints(docs), "fingerprints")
    roots = rooted(settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct"))
    ids = roots.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = roots.join(ids, "root").select("fp", "component_id")
    return marked.join(named, "fp")


def text_key(text: Column) -> Column:
    """Tells texts apart; null is not the empty text."""
    return F.coalesce(F.md5(text), F.lit(""))


def survivors(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n): of each component the row of least (doc_id, nulls last, text_key), and how many rows repeat it."""
    marked = settle(fingerprints(docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")), "text_key"), "fingerprints")
    rows = marked.groupBy("fp", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key", "n")
    roots = rooted(settle(rows.groupBy("fp").agg(F.min(row).alias("row")), "distinct"))
    return settle(roots.groupBy("root").agg(F.min("row").alias("row")).select("row.doc_id", "row.text_key", "row.n"), "survivors")


def hex_digits(fp) :
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
