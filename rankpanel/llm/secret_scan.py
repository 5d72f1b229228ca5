"""Secrets in whole texts: fixed patterns, and guess costs of values that stand in a credential context.

Base spans are the leftmost non-overlapping matches of three patterns (assign, access, hex) that are long enough.
The method looks at values after credential words (also those the patterns do not know, and bearer or URL
passwords), and asks how many guesses the cheapest segmentation into words, dates, repeats, keyboard walks,
sequences and brute-force spans needs; values that cost at least MIN_GUESSES become spans of kind `guess`.

Words are ranked by the number of documents that have them outside credential contexts (so no secret lists itself),
after a few fixed ones. A word needs MIN_DOCS documents, and the most frequent ones up to LISTED are listed; a word
beyond the list costs what its letters cost, so a missing word can mask too much, but never leaves a secret.

Offsets are code points, ends exclusive. Null texts count as empty and have no spans. Values overlapping a base
span add nothing. The cost of a value is computed whole, however long it is. Extra columns pass through.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import CARRIED, carried, restored, settle, small_batches

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs are maximal either way: the same as matching all and dropping the short
_HEX = re.compile(r"[0-9a-f]{24,}")
# after a name (short ones stand alone, longer ones may end one), or in a URL; a quoted value goes to its quote, a bare one
# may hold commas and semicolons, but none that ends it
_CONTEXT = re.compile(
    r"""(?:(?:pass(?:word|wd|phrase|code)|(?<![a-z0-9])(?:pass|pwd)|secret|token|credentials?|(?:api|access|private|auth|secret)[_-]?key)\b["']?\s*(?:[:=]|\bis\b)\s*|(?<![a-z0-9])Bearer\s+)"""
    r"""(?:"([^"\n]+)"|'([^'\n]+)'|["']?((?:[^\s"'<>,;]|[,;](?![\s"']|\Z|[a-z_][\w.-]*[:=]))+))"""
    r"""|(?<=[a-z0-9+])://[^\s/:@]+:([^\s/@]+)@""",
    re.IGNORECASE | re.ASCII,
)
MIN_GUESSES = 1e8
MIN_DOCS, LISTED = 3, 200_000
HELD = 200_000  # distinct words that a task counts before it hands them on
# fixed values: everyday words by rank, keyboard rows
WORDS = (
    "password pass admin user login welcome letmein secret token test demo example sample changeme default guest root master hello monkey dragon sunshine princess "
    "football baseball shadow love the and for you with this that your none null true false value string here placeholder insert enter redacted hidden xxxx key api id "
    "account email name house summer winter spring autumn january february march april may june july august september october november december monday friday"
).split()
_RANK = {w: i + 2 for i, w in enumerate(dict.fromkeys(WORDS))}
_LETTERS = re.compile(r"[^\W\d_]{3,}")
_WORD_LENGTH = 32
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
_STEPS = {(a, b) for row in _ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in _ROWS for a, b in zip(row, row[1:])}
_LEET = str.maketrans("@4301$57!", "aaeoisstl")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")


def _space(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, n): documents of this task that have the word outside credential contexts."""
    seen: Counter = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            if text:
                seen.update(w for w in set(_LETTERS.findall(_CONTEXT.sub(" ", text).lower())) if len(w) <= _WORD_LENGTH)
            if len(seen) > HELD:
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                seen.clear()
    yield pd.DataFrame({"word": list(seen), "n": list(seen.values())}).astype({"word": "object", "n": "int64"})


def ranked_words(docs: DataFrame) -> list[str]:
    """The words of `docs`, most frequent first; of equally frequent ones at the end of the list, all or none."""
    words = small_batches(docs.select("text")).mapInPandas(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS)
    words = settle(words, "words")
    least, total = MIN_DOCS, 0
    for n, k in sorted(map(tuple, words.groupBy("n").agg(F.count(F.lit(1))).collect()), reverse=True):
        total += k
        if total > LISTED:
            least = n + 1
            break
    return [r.word for r in sorted(words.where(F.col("n") >= least).collect(), key=lambda r: (-r.n, r.word))]


def ranks_of(words: Iterable[str]) -> dict[str, int]:
    return {w: i + 2 for i, w in enumerate(dict.fromkeys([*WORDS, *words]))}


_LISTS: dict[int, dict[str, int]] = {}


def _ranks(shared: Broadcast) -> dict[str, int]:
    """This worker's ranks of a broadcast list."""
    if (key := hash(shared.value)) not in _LISTS:
        _LISTS.clear()
        _LISTS[key] = ranks_of(shared.value.split())
    return _LISTS[key]


class _Starts:
    """Starts of a run that goes on (repeats of `width`, or a walk), each with a cost that grows with the log of its units.

    A start that the run itself reaches as cheaply and goes on from is never better than the earlier one, and a later start that an earlier
    one has overtaken stays behind; so only the few starts that something else made cheap are kept.
    """

    def __init__(self, width: int):
        self.width, self.live = width, []

    def at(self, j: int) -> list[float]:
        """Costs at `j` of the starts that are left, without those that an earlier one has overtaken."""
        costs, live = [], []
        for i, base in self.live:
            cost = base + math.log10((j - i) // self.width)
            if not costs or cost < min(costs):
                costs.append(cost)
                live.append((i, base))
        self.live = live
        return costs

    def broken(self, since: int) -> None:
        """Starts before `since` end here."""
        if self.live:
            self.live = [x for x in self.live if x[0] >= since]


def guess_cost(value: str, ranks: dict[str, int] = _RANK, enough: float = math.inf) -> float:
    """log10 of the guesses of the cheapest segmentation, or a bound of at least `enough` below it: dynamic programming over end positions."""
    low, n = value.lower(), len(value)
    if len(low) != n:  # a letter whose small form is longer
        low = "".join(x if len(x := c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    log = [math.log10(_space(c)) for c in value]
    best = [0.0] + [math.inf] * n
    repeats = {w: [_Starts(w) for _ in range(w)] for w in (1, 2, 3, 4)}  # a repeated unit of up to four characters
    walk = _Starts(1)
    for j in range(n + 1):
        if j:
            cost = min(best[j], best[j - 1] + log[j - 1] + (0.0 if value[j - 1].islower() or not value[j - 1].isalpha() else math.log10(2)))
            for i in range(max(0, j - _WORD_LENGTH), j):
                if (rank := ranks.get(plain[i:j])) is not None:
                    cost = min(cost, best[i] + math.log10(rank * (1 if value[i:j] == plain[i:j] else 4)))
            for w, starts in repeats.items():
                if j > w and value[j - 1] != value[j - 1 - w]:
                    for x in starts:
                        x.broken(j - w)
                x = starts[j % w]
                if x.live:
                    cost = min([cost, *(c for c, (i, _) in zip(x.at(j), x.live) if j - i >= 2 * w)])
            if j > 1 and (low[j - 2], low[j - 1]) not in _STEPS:
                walk.broken(j - 1)
            if walk.live:
                cost = min([cost, *(c for c, (i, _) in zip(walk.at(j), walk.live) if j - i >= 3)])
            best[j] = cost
        if j == n:
            break
        if m := _DATE.match(value, j):
            best[m.end()] = min(best[m.end()], best[j] + math.log10(200.0 if m.end() - j == 4 else 200.0 * 365 * 4))
        for w, starts in repeats.items():
            if j + w <= n and (value[j : j + w] != value[j - w : j] or all(best[j] < c for c in starts[j % w].at(j))):
                starts[j % w].live.append((j, best[j] + sum(log[j : j + w])))
        if not j or (low[j - 1], low[j]) not in _STEPS or all(best[j] < c for c in walk.at(j)):
            walk.live.append((j, best[j] + math.log10(50.0)))
        if j % 8 == 0 and best[j] >= enough:
            # all that follows starts at one of these
            least = min([*best[max(0, j - _WORD_LENGTH) : j + 1], *(b for x in [walk, *sum(repeats.values(), [])] for _, b in x.live)])
            if least >= enough:
                return least
    return best[n]


def spans(text: str | None, ranks: dict[str, int] = _RANK) -> list[tuple[int, int, int]]:
    """(start, kind as a position in KINDS, end), ordered."""
    if not text:
        return []
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base = sorted(found)
    for m in _CONTEXT.finditer(text):
        a, b = m.span(m.lastindex)
        while b > a and text[b - 1] in ".!?)]":
            b -= 1
        if b - a >= 6 and not any(s < b and a < e for s, _, e in base) and guess_cost(text[a:b], ranks, math.log10(MIN_GUESSES)) >= math.log10(MIN_GUESSES):
            found.append((a, 3, b))
    return sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def redact(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
    """The text with every span (overlapping ones merged) replaced by a mark."""
    out, at = [], 0
    for s, k, e in found:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if found else text


def scan(docs: DataFrame) -> DataFrame:
    """Every column of `docs` but the text, with counts, digests, spans and the redacted text."""
    added = "n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, redacted string"
    names = [c.split()[0] for c in added.split(", ")]
    keep = [c for c in docs.columns if c != "text" and c not in names]  # same names are replaced

    shared = docs.sparkSession.sparkContext.broadcast("\n".join(ranked_words(docs)))

    at, through = docs.columns.index("text"), [docs.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(shared)
        for batch in batches:
            rows = []
            for text in batch.column(at).to_pylist():
                found = spans(text, ranks)
                base = [f for f in found if f[1] < 3]
                n = [sum(f[1] == k for f in found) for k in range(4)]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), redact(text, found)))
            cols = list(zip(*rows)) or [()] * len(names)
            new = [pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in through), *new], names=[*keep, *names])

    schema = StructType([*(docs.schema.fields[k] for k in through), *StructType.fromDDL(added).fields])
    return small_batches(docs).mapInArrow(run, schema)


def without_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with secrets masked in the text and, where there is one, `n_chars` brought up to date."""
    found = scan(carried(docs, "text")).withColumn("text", F.col("redacted"))
    if "n_chars" not in docs.columns:
        return restored(found, docs)
    n = F.when(F.col("spans") != "", F.length("text")).otherwise(F.col(f"{CARRIED}.n_chars")).cast(docs.schema["n_chars"].dataType)
    return restored(found.withColumn("n_chars", n), docs, "n_chars")
