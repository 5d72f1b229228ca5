"""Combinations by number against itertools, and the known counts."""

import collections
import itertools

import pytest

from rankpanel.operators import enumeration as EN

SIZES_OF = {"A": 6, "B": 2, "C": 2, "D": 3, "E": 4}


@pytest.fixture(scope="module")
def seventeen(spark):
    return spark.createDataFrame([(f"{b}{i}", b) for b, n in SIZES_OF.items() for i in range(n)], "factor string, bucket string")


@pytest.mark.parametrize("size, count", [(3, 340), (4, 1876), (5, 4501)])
def test_known_counts(seventeen, size, count):
    assert EN.combinations(seventeen, [size], 3, 2).count() == count


def expected(rows, sizes, min_buckets=0, max_per_bucket=0, max_parent=0):
    rows = {f: b for f, b in rows if f is not None and (b is not None or not (min_buckets or max_per_bucket))}
    out = set()
    if len(set(rows.values())) < min_buckets:
        return out
    for k in sizes:
        for names in itertools.combinations(sorted(rows), k):
            per = collections.Counter(rows[x] for x in names)
            parents = collections.Counter(p for x in names for p in (set(x.split("__")[::2]) if x.count("__") == 2 else {x}))
            if (not max_per_bucket or max(per.values()) <= max_per_bucket) and len(per) >= min(k, min_buckets) and (not max_parent or max(parents.values()) <= max_parent):
                out.add(" + ".join(names))
    return out


ODD = [("x", "A"), ("y", "B"), ("z", "C"), ("x__add__y", "A"), ("x__sub__z", "B"), ("y__mul__z", "C"), ("y__mul__y", "D"), ("w", "D"), ("v", None), (None, "A"), ("x", "A"), ("é", "E")]


@pytest.mark.parametrize("limits", [(0, 0, 0), (3, 2, 0), (3, 2, 2), (2, 1, 1), (0, 0, 2), (4, 0, 0), (9, 2, 0), (0, 3, 0)])
def test_against_itertools(spark, limits, monkeypatch):
    monkeypatch.setattr(EN, "RANGE", 7)  # many ranges
    rows = EN.combinations(spark.createDataFrame(ODD, "factor string, bucket string"), [1, 2, 3, 4, 20], *limits).collect()
    assert len(rows) == len({r.combo for r in rows})
    assert {r.combo for r in rows} == expected(ODD, [1, 2, 3, 4], *limits)
    bucket = dict(x for x in ODD if x[0])
    for r in rows:
        assert r.combo == " + ".join(r.names) and r.size == len(r.names)
        assert r.n_buckets == (len({bucket[x] for x in r.names}) if limits[0] or limits[1] else None)


def test_many_buckets_and_parents(spark):
    """More groups than one long counts."""
    rows = [(f"n{i:02d}", f"b{i % 40:02d}") for i in range(44)]
    got = {r.combo for r in EN.combinations(spark.createDataFrame(rows, "factor string, bucket string"), [3], 3, 1, 1).collect()}
    assert got == expected(rows, [3], 3, 1, 1)


def test_nothing_to_combine(spark):
    none = spark.createDataFrame([], "factor string, bucket string")
    assert EN.combinations(none, [2, 3], 3, 2).collect() == []
    assert EN.combinations(none, []).collect() == []
    with pytest.raises(ValueError):
        EN.combinations(none, [2], 3, 9)
