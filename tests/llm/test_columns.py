"""Clashing columns through the stages, long pages, credential contexts, the language posterior by hand."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankpanel.llm import html_cut, language_id, secret_scan
from rankpanel.llm.base import table

OWN = "key score spans redacted n_hex n_guess size target taken source_size long string row words hash nr fp root level label id y u v n text_key".split()


def test_stages_leave_columns_alone(spark, sf):
    """Every stage returns the columns of its input as they were, whatever they are called; only text and n_chars may change."""
    docs = table(spark, sf, "documents").limit(120)
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in OWN}).withColumn("a.b", F.col("doc_id") * 2)
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([tuple([None] * len(docs.columns))] * 2, docs.schema))
    path = corpus_pipeline.settle(docs, "clashing")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, path, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) > 20, name
        for r in rows:
            d = r["doc_id"]
            assert all(r[c] == (None if d is None else f"{c}-{d}") for c in OWN) and r["a.b"] == (None if d is None else 2 * d), name
            if name == "secret scans" and r["text"] and "[assign]" in r["text"]:
                assert r["n_chars"] == len(r["text"])
        assert stage(spark, path.where("false"), sf).collect() == []
    assert corpus_pipeline.packing(spark, path, sf).agg(F.countDistinct("doc_id")).first()[0] == docs.agg(F.countDistinct("doc_id")).first()[0]


def page_of(n):
    return "<html><body><article>" + "".join(f"<p>This is paragraph number {i} of an article with many words in it, and it goes on.</p><div class='ad'>Buy {i}</div>" for i in range(n)) + "</article></body></html>"


def test_long_pages_take_time_in_proportion():
    t = time.process_time()
    text = html_cut.main_text(page_of(20_000))
    assert time.process_time() - t < 6
    assert text.count("\n\n") == 19_999 and "Buy" not in text
    assert html_cut.main_text(page_of(5)) == "\n\n".join(f"This is paragraph number {i} of an article with many words in it, and it goes on." for i in range(5))


def test_cut_of_undecided_blocks_is_least_and_smallest():
    """Weak terminals and strong ties, so that the flow decides; against all sides."""
    rnd = random.Random(8)
    for _ in range(150):
        n = rnd.randint(1, 9)
        scores = [rnd.choice([-2, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(n)]
        edges = [(i, i + 1, rnd.choice([0.5, 1.0, 1.5])) for i in range(n - 1)] + [(i, j, 1.0) for i in range(n) for j in range(i + 2, n) if rnd.random() < 0.2]
        cost = lambda s: sum(max(x, 0) if not k else max(-x, 0) for x, k in zip(scores, s)) + sum(c for a, b, c in edges if s[a] != s[b])  # noqa: E731, B023
        sides = [[bool(m >> i & 1) for i in range(n)] for m in range(1 << n)]
        least = min(map(cost, sides))
        got = html_cut.least_cut(scores, edges)
        assert cost(got) == pytest.approx(least)
        assert sum(got) == min(sum(s) for s in sides if cost(s) < least + 1e-9)


SECRET = "qX7#kV9!mZ2w"


@pytest.mark.parametrize(
    "before",
    ["password" + " " * 30 + ":" + " " * 30, "PGPASSWORD=", "dbPassword: ", "AWS_SECRET_ACCESS_KEY = ", "https://" + "u" * 300 + ":", "my+very+long+scheme+name+of+thirty://user:", "pwd: ", "Bearer" + "\t" * 12, "the passphrase is "],
)
def test_contexts_have_no_caps(before):
    text = f"see {before}{SECRET}" + ("@host/x" if "://" in before else " end")
    at = text.index(SECRET)
    found = secret_scan.spans(text)
    assert any(s <= at and e >= at + len(SECRET) - 3 for s, _, e in found), found


def test_values_with_separators_and_quotes():
    covered = lambda text, value: any(s <= text.index(value) and e >= text.index(value) + len(value) for s, _, e in secret_scan.spans(text))
    assert covered("pwd: qX7,#kV9;mZ", "qX7,#kV9;mZ")
    assert covered('passphrase: "q7# zK, vW9! m2"', "q7# zK, vW9! m2")
    assert not covered("pwd=qX7#kV9!mZ2w;host=example", "host")
    assert [e for _, _, e in secret_scan.spans("pwd: qX7#kV9!mZ2w, and more")] == [17]


def test_scan_of_repetitive_text_ends():
    t = time.process_time()
    for piece in ("password ", "a" * 50, "://", "token:,", "pwd: a,", "http://x:", '"', "secret is "):
        secret_scan.spans(piece * (100_000 // len(piece)))
    assert time.process_time() - t < 20


def test_text_behind_an_open_head():
    page = "<html lang=en><head><title>A title<meta charset=x><body><p>plain visible words</p>"
    assert language_id._MARKUP.sub(" ", page).split() == ["plain", "visible", "words"]


def test_posterior_by_hand(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog went to the house " * 5, "en"), (2, "der hund und die katze gehen in das haus " * 5, "de"), (3, "el perro y el gato van a la casa " * 5, "es")], "doc_id long, text string, lang string")
    rnd = random.Random(3)
    vocabulary = {"en": "the cat and dog went to house".split(), "de": "der hund und die katze gehen haus".split(), "es": "el perro y gato van a la casa".split()}
    rows = []
    for i in range(60):
        lang = rnd.choice(list(vocabulary))
        declared = rnd.choice([lang, lang, "en", ""])  # some are wrong
        host = rnd.choice([f"{lang}.site.org", "big.example.com", "big.example.com", f"shop.{lang}"])
        n = rnd.choice([0, 1, 3, 30])
        url = rnd.choice([f"https://{host}/p{i}"] * 9 + [None, "mailto:x"])
        rows.append((i, url, f"<html lang='{declared}'><body><p>" + " ".join(rnd.choices(vocabulary[lang], k=n)) + "</p>" if i % 13 else None))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    langs, logs = language_id.model(docs)
    evidence = {r.page_id: r for r in language_id.text_evidence(pages, langs, logs).collect()}
    soft = lambda x: [math.exp(v - max(x)) / sum(math.exp(w - max(x)) for w in x) for v in x]
    facts = {}
    for i, url, _ in rows:
        host = url.split("/")[2] if url and "//" in url else ""
        facts[i] = (soft(evidence[i].logs), host, ".".join(host.split(".")[-2:]), evidence[i].declared, host.split(".")[-1])
    n = len(langs)
    overall = [sum(f[0][k] for f in facts.values()) for k in range(n)]
    prior = [(x + 1) / (sum(overall) + n) for x in overall]
    got = {r.page_id: r for r in language_id.identify(pages, docs).collect()}
    for i, (p, host, domain, declared, suffix) in facts.items():
        rest = lambda at, value: [max(0.0, sum(f[0][k] for f in facts.values() if f[at] == value) - p[k]) for k in range(n)]  # noqa: E731, B023
        toward = lambda counts, base: [(c + 5 * b) / (sum(counts) + 5) for c, b in zip(counts, base)]
        base = toward(rest(2, domain), prior) if host else prior
        base = toward(rest(1, host), base) if host else prior
        like = [1.0] * n
        for at, value in ((3, declared), (4, suffix)):
            if value:
                like = [x * (c + 0.5) / (o + 1) for x, c, o in zip(like, rest(at, value), overall)]
        post = soft([g + math.log(b) + math.log(x) for g, b, x in zip(evidence[i].logs, base, like)])
        assert got[i].confidence == pytest.approx(max(post), rel=1e-9) and got[i].lang == langs[post.index(max(post))]
    assert len({r.lang != r.text_lang for r in got.values()}) == 2  # the fusion decides some pages
