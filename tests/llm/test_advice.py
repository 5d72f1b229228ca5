
import itertools
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from rankpanel.llm import html_cut, keyed_shards, mixing, packing, secret_scan
from rankpanel.llm.token_ids import TextEncoder, share_vocabulary
from rankpanel.sources.io import scratch_path

from .test_core import PATH


def test_near_dedup_keeps_null_ids_and_every_text_of_an_id(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcd")
    rows = [(None, a, "x"), (None, b, "x"), (1, c, "x"), (1, d, "x"), (2, d, "x"), (3, c, "y"), (3, c, "x"), (5, None, "x"), (5, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(corpus_pipeline.near_dedup(spark, docs, "").collect(), key=str)
    assert {(r.doc_id, r.text) for r in got if r.text} == {(None, a), (None, b), (1, c), (1, d)}
    assert [r.doc_id for r in got if not r.text] == [5] and len(got) == 5
    again = corpus_pipeline.near_dedup(spark, docs.where("doc_id = 3").repartition(3), "").collect()
    assert [(r.doc_id, r.text, r.source) for r in again] == [(3, c, "x")]


def test_secrets_of_letters_and_prefixed_names(spark):
    kinds = lambda t: [(t[a:b], secret_scan.KINDS[k]) for a, k, b in secret_scan.spans(t)]
    assert kinds("pwd: qXzKvWmRtBnJ") == [("qXzKvWmRtBnJ", "guess")]
    assert kinds("Bearer qXzKvWmRtBnJ") == [("qXzKvWmRtBnJ", "guess")]
    assert kinds("see ftp://me:qXzKvWmRtBnJ@host") == [("qXzKvWmRtBnJ", "guess")]
    assert kinds("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPx") == [("wJalrXUtnFEMIK7MDENGbPx", "guess")]
    assert kinds("db_pwd: Xk9#vQ2!mZ7p and my-pwd: Xk9#vQ2!mZ7p") == [("Xk9#vQ2!mZ7p", "guess")] * 2
    assert kinds("bypwd: Xk9#vQ2!mZ7p") == []
    # ordinary words are known from the documents; a secret that many copies repeat does not list itself
    texts = ["it is an important question of trust"] * 5 + ["the pwd is important", "passphrase: important-question", *["pwd: qXzKvWmRtBnJ"] * 6, None, ""]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.spans for r in secret_scan.scan(docs).collect()}
    assert got == {i: "guess:5:17" if 7 <= i <= 12 else "" for i in range(len(texts))}
    assert {r.text for r in corpus_pipeline.secrets(spark, docs.where("doc_id between 7 and 12"), "").collect()} == {"pwd: [guess]"}


def test_marks_do_not_swallow_articles():
    article = "".join(f"<p>{w} tells a part of the story, in a sentence or two that are long enough to be read as prose by anybody.</p>" for w in ("One", "Two", "Three"))
    text = html_cut.main_text("<body>" + article)
    assert text.count("\n\n") == 2
    nav, foot = "<nav><a href=a>Home</a></nav>", "<footer>&copy; me</footer>"
    side = "<div class=sidebar><p>Other stories that may be of some interest to the readers of this one, in a list of links.</p></div>"
    assert html_cut.main_text(f"<body><form>{nav}{article}{side}{foot}</form>") == text
    assert html_cut.main_text(f"<body>{nav}<div class='content has-sidebar'>{article}</div>{side}{foot}") == text
    assert html_cut.main_text(f"<body>{nav}<div class='search-page'>{article}</div>{side}{foot}") == text
    assert html_cut.main_text("<body><form><article><h1>Title</h1><p>Short text.</p></article></form>") == "Title\n\nShort text."
    head = html_cut.main_text(f"<body><header><h1>Site</h1></header><div class='entry-header'><h1>The headline of it all</h1></div>{article}{foot}")
    assert head == "The headline of it all\n\n" + text
    for mark in ("title='The hidden costs'", "data-id='search'", 'title="role=menu" data-class="ad"', "class=no-comments"):
        assert html_cut.main_text("<body>" + article.replace("<p>", f"<p {mark}>")) == text, mark
    assert html_cut.main_text("<body>" + article + "<p hidden>Not for anybody's eyes, though it is about as long as the others are.</p>") == text


def test_skipped_elements_without_an_end_tag():
    article = "<p>A part of the story, in a sentence or two that are long enough to be read as prose by anybody.</p>"
    text = html_cut.main_text("<body>" + article)
    assert text
    assert html_cut.main_text("<html><head><title>T</title><style>p{}</style>" + article) == text
    assert html_cut.main_text("<body><datalist><option>a<option>b</datalist>" + article) == text
    assert html_cut.main_text(f"<body><datalist><option value=a></datalist>{article}<select><option>x</option></select>") == text
    assert html_cut.main_text(f"<body><button>Go{article}<button>Stop</button>") == text
    assert html_cut.main_text(f"<body><svg><path d=x>{article}") == text


def test_mix_takes_part_of_repeated_rows(spark):
    rows = [(7, "a", "w " * 50)] * 40 + [(None, "a", "v " * 50)] * 40 + [(100 + i, "a", "x y " * 10) for i in range(20)]
    rows += [(1000 + i, f"s{j}", "one two # three " * 20) for j in range(3) for i in range(60)]
    docs = spark.createDataFrame([(d, s, t) for d, s, t in rows], "doc_id long, source string, text string")
    key = lambda rs: sorted(map(str, rs))
    got = mixing.mix(docs.repartition(5)).collect()
    assert len(got) == len(rows) and key(got) == key(mixing.mix(docs.coalesce(1)).collect())
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r["size"] for r in mine) / 2, s


def test_mix_orders_few_rows_of_a_spoilt_source(spark, monkeypatch):
    n = 4000  # weights at their floor: keys are spread twenty times as far
    docs = spark.range(n).selectExpr("id AS doc_id", "'a' AS source", "repeat('# ', 5) AS text").unionByName(spark.range(n).selectExpr("id AS doc_id", "'b' AS source", "'one two three' AS text"))
    seen = {}
    settle = mixing.settle
    monkeypatch.setattr(mixing, "settle", lambda df, name: seen.setdefault(name, settle(df, name)))
    mixing.mix(docs).count()
    sizes = [r["count"] for r in seen["ordered"].groupBy("source", "part").count().collect()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(sizes) < 2 * (2 * n) / parts


def test_ids_are_those_of_an_unchanged_tokenizer(spark):
    t = Tokenizer.from_file(PATH)
    ids = lambda x: t.encode(x, add_special_tokens=False).ids + [2]
    rnd = np.random.default_rng(4)
    letters = list("ab 1  \n\n\t.,é日 <|>") + ["<|endoftext|>"] * 4 + [" the", "\nThe ", "<|endof", "text|>"]
    texts = ["".join(rnd.choice(letters, rnd.integers(1, 25))) for _ in range(4000)]
    with open(PATH) as f:
        enc = TextEncoder(f.read())
    for x, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == ids(x), x
    rows = list(enumerate(["one <|endoftext|> two", "<|endoftext|>", "plain text"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    root = scratch_path(spark, "shards")
    manifest = keyed_shards.write_shards(docs, share_vocabulary(spark, PATH), root)
    got = sorted(keyed_shards.read_all(spark, root, manifest).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(ids(x)), zlib.crc32(np.array(ids(x), "<u4").tobytes())) for i, x in rows]
    assert [r.start for r in got] == list(itertools.accumulate([0] + [len(ids(x)) for _, x in rows]))[:-1]
    packed = packing.pack(packing.token_pieces(docs, share_vocabulary(spark, PATH), 64, keep_ids=True), 64).collect()
    assert {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in packed} == {i: ids(x) for i, x in rows} and 50256 in ids(rows[0][1])


def test_guess_cost_of_long_values():
    cost = secret_scan.guess_cost
    assert cost("-" * 192) < 4 and secret_scan.spans("pwd: " + "-" * 192) == [] and cost("ab" * 5000) < 8
    assert cost("qwertyuiop" + "-" * 300) < 8 < cost("Xk9#vQ2!mZ7p" * 8)
    assert 8 <= cost("Xk9#vQ2!mZ7p" * 8, enough=8.0) <= cost("Xk9#vQ2!mZ7p" * 8)

    def slow(value):  # all edges, no bounds
        low, n, log = value.lower(), len(value), np.log10
        plain, best = low.translate(secret_scan._LEET), [0.0] + [np.inf] * len(value)
        for i in range(n):
            edges = [(i + 1, secret_scan._space(value[i]) * (1 if value[i].islower() or not value[i].isalpha() else 2))]
            edges += [(j, secret_scan._RANK[plain[i:j]] * (1 if value[i:j] == plain[i:j] else 4)) for j in range(i + 1, n + 1) if plain[i:j] in secret_scan._RANK]
            if m := secret_scan._DATE.match(value, i):
                edges.append((m.end(), 200 if m.end() - i == 4 else 200 * 365 * 4))
            for w in (1, 2, 3, 4):
                unit = value[i : i + w]
                edges += [(i + k * w, np.prod([secret_scan._space(c) for c in unit]) * k) for k in range(2, n + 1) if i + k * w <= n and value[i : i + k * w] == unit * k]
            edges += [(j, 50 * (j - i)) for j in range(i + 3, n + 1) if all((low[x], low[x + 1]) in secret_scan._STEPS for x in range(i, j - 1))]
            for j, guesses in edges:
                best[j] = min(best[j], best[i] + log(float(guesses)))
        return best[n]

    rnd = np.random.default_rng(6)
    for _ in range(400):
        value = "".join(rnd.choice(["a", "b", "ab", "-", "qwe", "1", "12", "19", "2020", "0", "pass", "Key", "é", "aaaa", "X9"], rnd.integers(1, 30)))
        assert abs(cost(value) - slow(value)) < 1e-9, value
