"""Brute-force versions: rule ledger, Merkle trees, keyed shards, minimum cuts, language fusion, the pipeline."""

import collections
import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rankpanel.llm import html_cut, keyed_shards, language_id, ledger, merkle, simhash, subword_classifier
from rankpanel.llm.token_ids import share_vocabulary
from rankpanel.sources.io import scratch_path

from .test_core import PATH, WORDS, docs  # noqa: F401

ODD = [None, "", " \n ", "a b c d e f g h i j k", "x y z w v " * 30, "one\none\n\ntwo\none", "A### b&&& c", "é" * 40 + "\x1c日本 \x0b tab", "same same same same same same", "\n".join(["a line of text here"] * 4)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD)] + [(3, ODD[3], 9), (None, "null id", 1)], "doc_id long, text string, failed long")


def test_ledger_against_loops(spark, odd, docs):  # noqa: F811
    texts = {i: t or "" for i, t in enumerate(ODD)}
    for r in ledger.evaluate(odd).collect():
        t = texts.get(r.doc_id, "null id")
        w = WORDS.findall(t)
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many = collections.Counter(wins)
        covered = {i + k for i, g in enumerate(wins) if many[g] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered)), t
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t)) and r.n_dup_lines == len(lines) - len(set(lines))
    led = ledger.evaluate(docs)
    rows = led.collect()
    got = {r.rule: (r.n_failed, r.n_only) for r in ledger.ablations(led, "v1").collect()}
    for i, rule in enumerate(ledger.RULES):
        assert got[rule] == (sum(r.failed >> i & 1 for r in rows), sum(r.failed == 1 << i for r in rows))
    assert ledger.evaluate(docs.where("false")).count() == 0


def test_merkle_edits_and_order(spark, odd):
    rows = merkle.compare(odd).collect()
    assert len(rows) == odd.count()
    order = [(None, "null id")] + [(i, t or "") for i, t in enumerate(ODD)]
    prints = {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        want = hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
        for r in (r for r in rows if r.doc_id == i):
            assert (r.n_chars, r.edited_sha256) == (len(t), want)
            assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
            assert prints.setdefault(r.fingerprint, t) == t
            if q == 0:
                assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1.0
    assert len(prints) == len({t for _, t in order})
    assert merkle.compare(odd.where("false")).count() == 0


def test_merkle_locates_an_edit(spark):
    lines = [f"line {i} has its own words" for i in range(40)]
    other = lines[:17] + ["something else"] + lines[18:]
    d = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    d = merkle.with_tree(merkle.with_tree(d, "a", "fa"), "b", "fb")
    assert len(d.select(merkle.changed(d.fa, d.fb)).first()[0]) == 1
    assert d.select(merkle.changed(d.fa, d.fa)).first()[0] == []


def test_shards_round_trip(spark, docs):  # noqa: F811
    t = Tokenizer.from_file(PATH)
    root = scratch_path(spark, "shards")
    manifest = keyed_shards.write_shards(docs, share_vocabulary(spark, PATH), root)
    got = sorted(keyed_shards.read_all(spark, root, manifest).collect(), key=lambda r: r.start)
    raw = lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
    want = collections.Counter((r.doc_id, len(raw(r.text)) // 4, zlib.crc32(raw(r.text))) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == list(itertools.accumulate([0] + [r.n_tokens for r in got]))[:-1]
    ids = [r.doc_id if r.doc_id is not None else keyed_shards.NULL_KEY for r in got]
    assert ids == sorted(ids)
    found = keyed_shards.lookup(manifest, root, [7, 10, 12345])
    assert found[7] == [raw("a")] and len(found[10]) == 3 and found[12345] == []
    none = keyed_shards.write_shards(docs.where("false"), share_vocabulary(spark, PATH), root)
    assert keyed_shards.read_all(spark, root, none).count() == 0


def test_index_is_minimal_and_perfect():
    rnd = np.random.default_rng(5)
    keys = np.sort(rnd.integers(-(2**62), 2**62, 5000))
    index = keyed_shards.build_index(keys)
    slots = keyed_shards._slots(index, keys)
    assert sorted(slots) == list(range(len(keys)))
    first, times = keyed_shards.find(index, keys)
    assert (keys[first] == keys).all() and (times == 1).all()
    assert keyed_shards.find(index, rnd.integers(2**62, 2**63 - 1, 5000))[1].sum() == 0


def test_cut_is_least():
    rnd = np.random.default_rng(2)
    for _ in range(60):
        n = int(rnd.integers(1, 8))
        scores = rnd.normal(size=n).round(2).tolist()
        edges = [(a, b, float(rnd.uniform(0, 1))) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5]
        cost = lambda lab: sum(s for s, k in zip(scores, lab) if s > 0 and not k) - sum(s for s, k in zip(scores, lab) if s < 0 and k) + sum(c for a, b, c in edges if lab[a] != lab[b])
        least = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(html_cut.least_cut(scores, edges)) == pytest.approx(least)


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site.</div>
    <div id="wrap"><article><h1>A &amp; B</h1><p>First  <b>bold<br>text</b>&nbsp;here.<p>Second.<div class="ad">Buy now</div><ul><li>point</li></ul>
    <form><input name=q><p>Your name</p></form><p>Last.</p><section class="comments"><p>Nice post, thanks for all the details in this article!</p></section></article>
    <aside class="sidebar"><p>A long list of other things that you may want to read some day.</p></aside></div><footer>&copy; me</footer><p unfinished"""
    assert html_cut.main_text(page) == "A & B\n\nFirst bold text here.\n\nSecond.\n\npoint\n\nLast."
    assert html_cut.main_text(None) == html_cut.main_text("") == html_cut.main_text("<script>x") == ""
    plain = "<body><div class=menu><a href=a>One</a></div><div><p>" + "Plain words of a page without an article. " * 5 + "</p><p>Short.</p></div>"
    assert html_cut.main_text(plain).endswith("Short.") and "One" not in html_cut.main_text(plain)


def test_extract_and_language(spark, sf):
    pages = spark.createDataFrame([(1, "http://a.example.de/x", "<html lang='de'><p>der die und nicht</p>", "x"), (2, None, None, "y"), (2, "", "", "y"), (3, "http://a.example.de/y", "<p>the and of with this that</p>", "z")], "page_id long, url string, html string, text string")
    assert {(r.page_id, r.n_chars) for r in html_cut.extract(pages).collect()} == {(1, 17), (2, 0), (3, 25)}
    d = spark.createDataFrame([("de", "der die das und nicht ein eine " * 20), ("en", "the and of with this that is a " * 20), (None, "zzz"), ("en", None)], "lang string, text string")
    got = language_id.identify(pages, d).collect()
    assert len(got) == 4 and {r.page_id: r.lang for r in got if r.page_id != 2} == {1: "de", 3: "en"}
    assert all(0 < r.confidence <= 1 for r in got)
    assert language_id.identify(pages, d.where("false")).where("lang is not null").count() == 0
    assert language_id.identify(pages.where("false"), d).count() == 0


def test_ledger_sql(spark, sf):
    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(entry.oracle_sql()["op6_quality_rules"])
    names = [c[0] for c in want.description]
    got = entry.queries()["op6_quality_rules"](spark, sf).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_pipeline_stages(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.quality(spark, d, sf)
    assert good.columns == d.columns
    scorer = subword_classifier.Scorer(*subword_classifier.fit(d, spark.read.parquet(f"{sf}/labels.parquet")))
    kept = [r for r in d.collect() if scorer.score(r.text) >= 0.7]
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in kept}
    single = corpus_pipeline.near_dedup(spark, good, sf)
    fp = {r.doc_id: simhash.fingerprint(r.text) for r in kept}
    alone = [a for a in fp if not any(b < a and bin(fp[a] ^ fp[b]).count("1") <= 3 for b in fp)]
    got = {r.doc_id for r in single.collect()}
    assert got <= set(alone) | got and single.count() == len(got) and min(fp) in got
    linked = {a: [b for b in fp if bin(fp[a] ^ fp[b]).count("1") <= 3] for a in fp}
    seen, heads = set(), set()
    for a in sorted(fp):
        if a not in seen:
            heads.add(a)
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += linked[x]
    assert got == heads
    again = corpus_pipeline.near_dedup(spark, good.unionByName(good), sf)
    assert again.count() == len(got)
    clean = corpus_pipeline.secrets(spark, single, sf)
    assert clean.columns == d.columns and clean.count() == len(got)
    mixed = corpus_pipeline.mixing(spark, clean, sf)
    assert mixed.columns == d.columns and mixed.count() > 0


def test_leaves_follow_what_stands_there(spark):
    """A word put in front of one long line leaves nearly all its leaves alone; equal fingerprints mean equal texts."""
    rnd = np.random.default_rng(4)
    line = " ".join("".join(rnd.choice(list("abcdefgh"), 5)) for _ in range(600))
    rows = [(1, line), (2, "new " + line), (3, line.replace(" ", "  ", 1)), (4, line + "\n"), (5, line + "\n" + line[:40]), (6, "word " * 20_000), (7, "word " * 19_999)]
    got = {r.doc_id: r for r in merkle.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_next > 0.95 and got[2].near_next > 0.95
    assert len({r.fingerprint for r in got.values()}) == len(rows)
    assert got[1].changed and all(len(d) == 16 for d in got[1].changed)
