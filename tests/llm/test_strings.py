"""Suffix order and repeated strings, periodic runs, spelling variants: against brute force, with odd inputs."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankpanel.llm import periods, spelling, suffix_dedup

SCHEMA = "doc_id long, text string, h int, g string, key string, rank long, bytes string, state int"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(d, t, 1, "x", "k", 2, "b", 3) for d, t in rows], SCHEMA).repartition(parts)


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


# repeated strings


def removed(texts):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        mark = bytearray(len(r))
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                mark[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, m in zip(r, mark) if not m)
        spans = sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark))
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def repeats():
    rnd = random.Random(5)
    passages = [prose(rnd, n) for n in (30, 40, 60, 200, 400)]  # 200 bytes and less up to some thousand
    line = prose(rnd, 14)
    rows = [(None, passages[3]), (1, None), (2, ""), (3, "short"), (4, "a" * 900), (5, "a" * 199), (6, "a" * 200), (7, "ab" * 300), (8, "é" * 250), (9, (line + "\n") * 40), (10, (line + "\n") * 3)]
    for i in range(60):
        parts = [prose(rnd, rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 60)
            parts += [p[a : len(p) - rnd.randint(0, 60)], rnd.choice(["", " ", prose(rnd, rnd.randint(1, 50)), "ü" * rnd.randint(1, 9)])]
        rows.append((20 + i, "".join(parts)))
    for i in range(12):  # near copies, and exact ones with the same and with other ids
        t = rows[11 + i][1]
        k = len(t) // 2
        rows += [(100 + i, t[:k] + "X" + t[k + 1 :]), (100 + i, t), (20 + i, t)]
    exact = "".join(passages[4][:200])
    rows += [(200, "left one " + exact + " right"), (201, "other " + exact), (202, exact[1:] + "end")]
    return rows


@pytest.mark.parametrize("limits", [{}, {"most_keys": 0, "most_side": 0}])
def test_repeated_strings(spark, repeats, limits):
    want = sorted(str((d, *r)) for (d, _), r in zip(repeats, removed([t for _, t in repeats])))
    got = suffix_dedup.dedup(frame(spark, repeats), **limits).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want
    assert sum(r.n_spans for r in got) > 50


def test_ordering_decides_windows_between_samples(spark, repeats):
    """Some windows are left to the suffix order; without its result they would stay."""
    keyed = frame(spark, repeats).select(F.xxhash64("text").alias("h"), F.hash("text", F.length("text")).alias("g"), "text")
    rows = suffix_dedup.samples(keyed, suffix_dedup.key_states(keyed))
    assert rows.where("pos IS NOT NULL AND hi >= lo AND NOT witness").count() > 100
    keys = lambda df: {(r.h, r.g, i) for r in df.collect() for i in range(r.lo, r.hi + 1)}
    assert len(keys(suffix_dedup.repeated_windows(keyed)) - keys(rows.where("pos IS NULL"))) > 100


def test_kept_bytes_and_empty_table(spark):
    t = prose(random.Random(1), 120)
    got = suffix_dedup.dedup(frame(spark, [(1, "p" * 5 + t), (2, t + "q" * 7)]), keep_text=True).collect()
    assert {(r.doc_id, bytes(r.kept)) for r in got} == {(1, b"ppppp"), (2, b"qqqqqqq")}
    assert suffix_dedup.dedup(frame(spark, []).where("false")).collect() == []


def test_long_text(spark):
    t = prose(random.Random(2), 120_000)
    r = suffix_dedup.dedup(frame(spark, [(1, t), (2, t[300_000:301_000])])).where("doc_id = 1").first()
    assert (r.n_removed, r.n_spans) == (1000, 1)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_suffix_ranks(spark, levels):
    rnd = random.Random(levels)
    strings = [[rnd.randint(1, 2) for _ in range(rnd.randint(1, 26))] for _ in range(25)]
    strings += [strings[0], [1] * 20, [1] * 7, [3]]
    rows = [(1000 * k, 1000 * k + i, c) for k, s in enumerate(strings) for i, c in enumerate(s)]
    got = {r.pos: r.rank for r in suffix_dedup.suffix_ranks(spark.createDataFrame(rows, "sid long, pos long, c long"), levels).collect()}
    assert len(got) == len(rows)
    tail = {1000 * k + i: tuple(s[i:]) for k, s in enumerate(strings) for i in range(len(s))}
    at = sorted(got, key=got.get)
    sure = 3**levels
    for x, y in zip(at, at[1:]):
        a, b = tail[x], tail[y]
        if got[x] == got[y]:
            assert a[:sure] == b[:sure]
        else:
            assert a < b or a[:sure] == b[:sure]
    for x in at if levels == 3 else []:  # fully told apart: a rank counts what is smaller
        assert got[x] == 1 + sum(got[y] < got[x] for y in at)


# periodic runs


def runs_of(x):
    found = {}
    for p in range(1, len(x) // 4 + 1):
        i = 0
        while i + p < len(x):
            s = i
            while i + p < len(x) and x[i] == x[i + p]:
                i += 1
            m = i - s + p
            if i > s and m >= max(6, 4 * p):
                found[s, m] = min(p, found.get((s, m), p))
            i += i == s
    return sorted(((s, m, p) for (s, m), p in found.items()), key=lambda r: (r[0], r[2]))


def summary(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs_of(words)
    dropped = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_runs_of_numbers():
    rnd = np.random.default_rng(3)
    for _ in range(400):
        docs = [np.concatenate([np.tile(rnd.integers(1, rnd.integers(2, 5), rnd.integers(1, 9)), rnd.integers(1, 12)) for _ in range(rnd.integers(1, 5))]).astype(np.int32) for _ in range(rnd.integers(1, 5))]
        assert periods.find_runs(docs) == [runs_of(d.tolist()) for d in docs]
    assert periods.find_runs([np.zeros(0, np.int32)]) == [[]]


def test_runs_of_one_long_text():
    x = np.concatenate([np.arange(1, 40_001), np.tile(np.arange(50_000, 53_000), 5), np.full(30_000, 7), np.arange(60_000, 70_000)]).astype(np.int32)
    assert periods.find_runs([x]) == [[(40_000, 15_000, 3000), (55_000, 30_000, 1)]]


def test_periodic_runs(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(None, "a b " * 9), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "x " * 6), (5, "x " * 5), (6, "é\x85x é\x85x \x1c " * 4)]
    for i in range(300):
        words = []
        for _ in range(rnd.randint(0, 5)):
            base = [rnd.choice("abc") for _ in range(rnd.randint(1, 12))]
            words += base * rnd.randint(1, 7)
        rows.append((i, rnd.choice([" ", "\n", "\t \r\n"]).join(words)))
    rows += rows[20:30]
    got = sorted(str(tuple(r)) for r in periods.periodic_runs(frame(spark, rows)).collect())
    assert got == sorted(str(summary(d, t)) for d, t in rows)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 20
    assert periods.periodic_runs(frame(spark, rows[:1]).where("false")).collect() == []


# spelling


def near_words(vocabulary):
    near = collections.defaultdict(list)
    for u in vocabulary:
        for v in vocabulary:
            if len(u) == len(v) and sum(a != b for a, b in zip(u, v)) == 1 or len(u) == len(v) + 1 and any(u[:i] + u[i + 1 :] == v for i in range(len(u))):
                near[u].append(v)
                if len(u) != len(v):
                    near[v].append(u)
    return near


def spelt(rows):
    n = collections.Counter()
    for d, t in rows:
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            w = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
            n[w] += len(w) >= 5
    n = {w: k for w, k in n.items() if k >= 3}
    near = near_words(n)
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in near if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def misspellings():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcß") for _ in range(rnd.randint(5, 7))) for _ in range(120)] + ["Straße", "ÀÉÎõü", "aaaaa", "aaaaaa", "aaaaaaa", "abcabcabc" * 5]
    rows = [(None, "Straße straße STRASSE strasse strasse"), (1, None), (2, ""), (3, "12 _ ×÷×÷× ×÷×÷×"), (3, "abcab"), (3, "abcab")]
    for i in range(150):
        rows.append((i, rnd.choice([" ", "1", "\n-"]).join(rnd.choices(words, weights=[1 + 60 // (k + 1) for k in range(len(words))], k=rnd.randint(0, 60)))))
    return rows


@pytest.mark.parametrize("size", [spelling.FILTER_BYTES, 64])
def test_near_pairs_and_forms(spark, misspellings, size, monkeypatch):
    """With small filters the vocabulary goes in many slices."""
    real = spelling.near_pairs
    monkeypatch.setattr(spelling, "near_pairs", lambda words: real(words, size))
    got = sorted(str(tuple(r)) for r in spelling.variants(frame(spark, misspellings)).collect())
    assert got == spelt(misspellings)
    assert sum(", None, " not in r for r in got) > 5


def test_saturated_filters_lose_nothing(spark, misspellings, monkeypatch):
    """Filters that let nearly all edits pass still give the same pairs."""
    monkeypatch.setattr(spelling, "KEY_BITS", 1)
    assert sorted(str(tuple(r)) for r in spelling.variants(frame(spark, misspellings)).collect()) == spelt(misspellings)


def test_long_chains_lead_to_one_root(spark):
    links = spark.createDataFrame([(f"w{i:03d}", f"w{i + 1:03d}") for i in range(100)], "word string, form string")
    assert {r.root for r in spelling.roots(links).collect()} == {"w100"}


def test_no_words(spark):
    assert spelling.variants(frame(spark, [(1, None), (2, "a b")])).collect() == []
    assert spelling.variants(frame(spark, [(1, "x")]).where("false")).collect() == []
