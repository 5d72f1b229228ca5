"""Quality scores from supervised subword embeddings.

Every word gives hashed features: the word and its character n-grams (case kept, ends marked). A word that repeats
the one before it adds a repeat mark, one feature for all words. A document is the mean of its features' vectors; a softmax over the classes reads it. Vectors and output weights are learned together by
stochastic gradient descent in numpy, on at most SAMPLE labelled documents per class, taken in hash order.

With the output layer linear in the mean, a trained model for two classes needs one number per feature: the
difference of the class weights times its vector. Scoring is a mean of those numbers over the whole text, a word's
sum being remembered by each worker.

Null and empty texts get the score of an empty mean. Labels that are null, and ids that repeat in the labels,
are handled: null labels are ignored, a repeated id counts once with its largest label. Documents repeat as
their rows do. Without labels of both classes every score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .base import small_batches

SAMPLE = 1200  # labelled documents of each class that the fit uses at most
BUCKETS = 1 << 18
DIM, EPOCHS, RATE, GRAMS = 8, 6, 0.5, (3, 4)
REPEAT_WEIGHT = 8  # a repeat counts as this many features
MEMO_WORDS = 150_000  # words in each of a worker's two generations
THRESHOLD = 0.7
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SAME = zlib.crc32(b"=\0=") % BUCKETS


def word_features(word: str) -> list[int]:
    """Buckets of a word and of its n-grams (over UTF-8 bytes); a very long word counts all of its n-grams too."""
    w = b"<" + word.encode("utf-8", "surrogatepass") + b">"
    crc = zlib.crc32
    return [crc(w) % BUCKETS] + [crc(w[i : i + n]) % BUCKETS for n in GRAMS for i in range(len(w) - n + 1)]


def n_features(words: list[str]) -> int:
    """Size of the bag of these words: one each, and for n-grams of n their bytes + 3 - n."""
    sizes = Counter(map(len, " ".join(words).encode("utf-8", "surrogatepass").split(b" ")))
    return sum(c * (1 + sum(max(0, k + 3 - n) for n in GRAMS)) for k, c in sizes.items())


def repeats(words: list[str]) -> int:
    return sum(map(str.__eq__, words, words[1:]))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their shares."""
    words = _WORD.findall(text or "")
    counts: Counter = Counter()
    for w, n in Counter(words).items():
        for f in word_features(w):
            counts[f] += n
    if same := REPEAT_WEIGHT * repeats(words):
        counts[_SAME] += same
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    ids, n = np.fromiter(counts, np.int64), np.fromiter(counts.values(), np.float32)
    return ids, n / n.sum()


def train(rows: list[tuple[str | None, int]], seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight of each feature, bias) of class 1 against class 0; rows in a fixed order give the same model."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    bags = [(bag(t), y) for t, y in rows]
    weight = [len(rows) / max(1, 2 * sum(y == c for _, y in rows)) for c in (0, 1)]  # both classes count alike
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS if len({y for _, y in rows}) == 2 else 0):
        for i in rng.permutation(len(bags)):
            (ids, share), y = bags[i]
            rate = RATE * (1 - done / steps) * weight[y]
            done += 1
            h = share @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = out @ h + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y] -= 1
            back = out.T @ g
            out -= rate * np.outer(g, h)
            bias -= rate * g
            if len(ids):  # shares are small: the step is scaled by the inverse of their mean square
                vectors[ids] -= rate * np.outer(share / (share @ share), back) * np.float32(0.2)
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self._w, self._bias = weights.astype(np.float64).tolist(), bias
        self._memo: dict[str, float] = {}
        self._older: dict[str, float] = {}

    def score(self, text: str | None) -> float:
        words = _WORD.findall(text or "")
        memo, weights = self._memo, self._w
        new = set(words).difference(memo)
        if len(memo) > MEMO_WORDS and new:  # what is not met again during a generation is forgotten
            self._older, self._memo = memo, {}
            memo, new = self._memo, set(words)
        for w in new:
            known = self._older.get(w)
            memo[w] = sum([weights[f] for f in word_features(w)]) if known is None else known
        same = REPEAT_WEIGHT * repeats(words)
        total = sum(map(memo.__getitem__, words)) + same * weights[_SAME]
        n = (n_features(words) if words else 0) + same
        z = self._bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-min(60.0, max(-60.0, z)))))


_SCORERS: dict[int, Scorer] = {}


def held_out(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model from at most `sample` documents per class; held-out ids never enter it."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    n0, n1 = known.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    order = F.xxhash64("id", F.lit(1))
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(order, "id").limit(sample)
        picked = some if picked is None else picked.union(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(picked), "id")  # at most 2 * sample rows
    rows = texts.groupBy("id", "y").agg(F.max("text").alias("text")).collect()
    weights, bias = train([(r["text"], r["y"]) for r in sorted(rows, key=lambda r: r["id"])])
    # both classes weigh alike in the fit; the labels' own odds are put back
    return weights, bias + float(np.log(n1 / n0)) if n0 and n1 else bias


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Every column of `docs`, and `score`."""
    docs = docs.drop("score")  # a column of this name is replaced
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(shared.value[0].tobytes())
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(*shared.value)
        scorer = _SCORERS[key]
        for b in batches:
            scores = pa.array(array("d", map(scorer.score, b.column(at).to_pylist())), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, "score"])

    return small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
