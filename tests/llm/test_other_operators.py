"""Sharding, mixing, licences, HTML and nearest neighbours against brute force, and on odd tables."""

import math
import random
import re
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest

from pagemill.llm import ann, html_extract, licenses, mixing, queries, sharding
from pagemill.llm.html_blocks import blocks
from pagemill.llm.html_training import labelled_pages

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, n_chars long, size string, cell int, bits int, key string, target int"
REST = (10, "x", 1, 2, "k", 3)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "one two three", "b"), (3, "one two three", "b"), (None, "four five", None), (4, "w " * 3000, "a"), (5, "ä ö\x0bü x", "é")]
    return rows, spark.createDataFrame([(*r, *REST) for r in rows], SCHEMA)


def check_shards(rows, limit):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"], r["part"]].append(r)
    for (name, _), members in by.items():
        total = sum(r["n_bytes"] for r in members)
        assert {r["shard_bytes"] for r in members} == {total}
        assert total <= limit or len(members) == 1
        assert {r["depth"] for r in members} == {len(name)}
    names = {n for n, _ in by}
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    sizes = Counter()
    for r in rows:
        for i in range(len(r["shard"]) + 1):
            sizes[r["shard"][:i]] += r["n_bytes"]
    assert all(sizes[n[:-1]] > limit for n in names if n)


@pytest.mark.parametrize("limit", [3_000, 20_000, 1 << 30])
def test_shards_fit(spark, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.shard(docs, limit).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    check_shards(rows, limit)


def test_shards_of_odd_rows(spark, none):
    rows, df = odd_rows(spark)
    out = sharding.shard(df, 40).collect()
    assert len(out) == len(rows)
    check_shards(out, 40)
    same = spark.createDataFrame([(1, "x" * 10)] * 30 + [(1, "y" * 50)], "doc_id long, text string")
    out = sharding.shard(same, 40).collect()
    assert len(out) == 31
    check_shards(out, 40)
    assert sharding.shard(none).collect() == []


def brute_targets(sizes, share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = share * sum(sizes.values())
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def check_mix(rows):
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    targets = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]], abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] + r["part"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)


def test_mix(spark, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == words
    check_mix(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    odd, df = odd_rows(spark)
    out = mixing.mix(df).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in odd)
    check_mix(out)
    assert mixing.mix(none).collect() == []
    assert mixing.mixed_documents(none).collect() == []


def test_mixed_documents_hold_what_was_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert got == Counter({k: v for k, v in taken.items() if v})
    _, df = odd_rows(spark)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert sum(len((r["text"] or "").replace(" ", "x").split()) for r in out.collect()) == sum(r["taken"] for r in mixing.mix(df).collect())


def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = []
    labels = set()
    for label, phrase in licenses.PHRASES:
        need = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(need)] == need]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = [
    (1, None), (2, ""), (3, "..."), (4, "All rights reserved."), (5, "x ALL-RIGHTS\nreserved all rights reserved éall rights reserved"), (5, "x ALL-RIGHTS\nreserved all rights reserved éall rights reserved"),
    (6, "Text. Licensed under CC BY-NC 4.0. More"), (7, "This work is licensed under the GNU General Public License, version 3."), (8, "Released under the MIT License. " * 3),
    (9, "the apache tribe had a version of a licensed license"), (None, "Licensed under the Apache License, Version 2.0."), (10, " Kcc byſ cc by"), (11, "cc\x85by cc\x1fby"), (12, "word " * 50_000 + "all rights reserved"),
]


def test_licenses(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op7_licenses(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    expected = {"Apache License, Version 2.0": "apache-2.0", "MIT License": "mit", "CC BY-NC 4.0": "cc-by-nc", "General Public License, version 3": "gpl-3.0"}
    for r in rows:
        text = texts[r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_phrases(text)
        own = {label for line, label in expected.items() if line in text}
        assert set(r["labels"].split(",")) - {""} == own | (set(r["base_labels"].split(",")) - {""})
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    odd = spark.createDataFrame([(*t, "x", 1) for t in TEXTS], "doc_id long, text string, word string, label int")
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(odd).collect())
    assert got == Counter((i, *brute_phrases(t)) for i, t in TEXTS)
    labels = {r["doc_id"]: r["labels"] for r in licenses.scan(odd).collect()}
    assert labels[6] == "cc-by,cc-by-nc" and labels[7] == "gpl,gpl-3.0" and labels[8] == "mit" and labels[9] == "" and labels[None] == "apache-2.0"
    assert licenses.scan(none).collect() == []


def test_all_licenses_of_a_file(spark):
    texts = [text for _, text, _ in licenses.TEMPLATES]
    many = ["apache-2.0", "bsd", "isc", "mit", "mpl-2.0"]
    some = [text for label, text, _ in licenses.TEMPLATES if label in many]
    rows = [(0, "\n\n".join(texts)), (1, "\n\n".join(some)), *((10 + i, t) for i, t in enumerate(texts * 3)), *((100 + i, f"plain prose {i}") for i in range(200))]
    labels = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # "cc by" and "general public license" are phrases as well
    assert labels[0] == ",".join(sorted({label for label, _, _ in licenses.TEMPLATES} | {"cc-by", "gpl"}))
    assert labels[1] == ",".join(many)


def brute_licenses(texts, templates, phrases, posted, cover):
    """Labels and score of each text, by trying every template at every place."""
    listed = [(label, text, key) for label, text, key in templates] + [(label, text, text) for label, text in phrases]
    files = [re.findall(r"[0-9a-z]+", t.lower()) for t in texts]
    weight = lambda w: math.log(1 + len(files) / max(1, sum(w in f for f in files)))
    out = []
    for words in files:
        found = []
        for label, text, key in listed:
            mine, need = licenses.words_of(text), licenses.words_of(key)
            at = next(i for i in range(len(mine)) if mine[i : i + len(need)] == need)
            best = sorted(((-weight(w), w, i) for i, w in enumerate(mine) if w not in licenses.PLAIN))[:posted]
            total = sum(-x for x, _, _ in best)
            for shift in range(-len(mine), len(words)):
                stands = lambda i, w, shift=shift: 0 <= shift + i < len(words) and words[shift + i] == w
                got = sum(-x for x, w, i in best if stands(i, w))
                if got / total >= cover and all(stands(at + i, w) for i, w in enumerate(need)):
                    found.append((label, min(1, got / total)))
        out.append((",".join(sorted({x for x, _ in found})), round(max((x for _, x in found), default=0.0), 6)))
    return out


def test_licenses_equal_a_matcher_that_tries_every_place(spark):
    r = random.Random(4)
    lines = [t for _, t, _ in licenses.TEMPLATES]
    texts = ["\n\n".join(lines), "no licence at all", "by cc by rights reserved all rights reserved"]
    for i in range(60):
        parts = []
        for line in r.sample(lines, r.randint(1, 4)):
            words = line.split()
            for _ in range(r.randint(0, len(words) // 3)):  # words that are changed or lost
                j = r.randrange(len(words))
                words[j : j + 1] = r.choice([[], ["other"], ["software"], [words[j], "the"]])
            parts.append(" ".join(words) + f" w{i}")
        texts.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["labels"], x["score"]) for x in licenses.scan(df).collect()}
    expected = brute_licenses(texts, licenses.TEMPLATES, licenses.PHRASES, licenses.POSTED, licenses.COVER)
    assert [got[i] for i in range(len(texts))] == expected
    assert len({x for x, _ in expected}) > 20 and any(0 < s < 1 for _, s in expected)


def test_html_of_all_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op8_html(spark, SF).collect():
        inside = re.sub("<br>", " ", re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1])
        parts = [" ".join(unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(x for x in parts if x)
        assert r["n_chars"] == len(r["text"])


def test_html_on_unseen_layouts():
    field = html_extract.trained()
    found = [(field.decode(x), y) for x, y in map(html_extract.labelled, labelled_pages(200, seed=11))]
    assert np.mean(np.concatenate([a == b for a, b in found])) > 0.99
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>
    <header><h1>Site</h1></header><NAV><a href=x>Home</a> | <a href=y>News</a></NAV><div class="cookie-notice"><p>We use cookies.</p></div>
    <main><article><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;text<script>var a = "</p>";</script> here.<p>Second &lt;p&gt; &#x41;.
    <div class="advert"><p>Buy this now, it is a long text that says nothing at all. Really.</p></div><ul><li>One<li>Two</ul>
    <form><p>Sign up</p><input></form><section class="comments"><h3>Comments</h3><p>I liked this very much indeed. It was good.</p></section></article></main>
    <aside><p>Other stories that you may like.</p></aside><footer><p>&copy; 2020 Site</p></footer></body></html>"""
    assert html_extract.main_text(field, page) == "Title & more\nFirst bold text here.\nSecond <p> A.\nOne\nTwo"


def test_html_keeps_formulas():
    formula = '<math display="inline"><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow><annotation encoding="application/x-tex">E=mc^2</annotation></semantics></math>'
    got = blocks(f"<article><p>where {formula} holds</p><p>and <math><mtable><mtr><mtd>1</mtd><mtd>0</mtd></mtr></mtable></math> stays</p><svg><title>x</title></svg></article>")
    assert [b.text for b in got] == ["where E=mc2 holds", "and 1 0 stays"]
    assert [(b.node.tag, b.node.tags) for b in got] == [("p", {"article", "p"})] * 2


def test_html_of_odd_rows(spark):
    rows = [(1, None, "u", "x"), (2, "", None, None), (3, "plain words only", "u", "x"), (4, "<p>a < b && c <!-- never closed", "u", "x"), (5, "<div " + "<p>" * 2000 + "deep" + '<a href="x', "u", "x"), (5, "<article>" + "<p>many words</p>" * 30_000, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    out = html_extract.extract(df).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["main_text"]) for r in out)
    assert out[0]["main_text"] == "" and out[5]["main_text"].count("many words") == 30_000
    assert html_extract.extract(df.filter("false")).collect() == []
    assert [b.text for b in blocks("<p>a < b && c <!-- x")] == ["a < b && c"]


def brute_nearest(rows, ask, k):
    usable = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ask:
        if q in usable:
            near = sorted((float(np.sqrt(((v - usable[q]) ** 2).sum())), i) for i, v in usable.items() if i != q)
            out[q] = near[:k]
    return out


@pytest.mark.parametrize("block", [ann.BLOCK, 7])
def test_nearest(spark, block):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    ask = [i for i, _ in rows if i % 20 == 0]
    best = brute_nearest(rows, ask, 10)
    got = defaultdict(list)
    # so few vectors that LEAST would rerank all of a file
    for r in ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), least=8, block=block).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    true = dict(rows)
    for q, near in got.items():
        assert near == sorted(near)
        assert all(s == pytest.approx(float(np.linalg.norm(np.array(true[i], dtype=float) - np.array(true[q], dtype=float))), rel=1e-12) for s, i in near)
    recall = np.mean([len({i for _, i in got[q]} & {i for _, i in best[q]}) / 10 for q in ask])
    print("recall", recall)
    assert recall >= 0.95


def test_nearest_recall_of_all_queries(spark):
    """The query's own recall, with the production parameters, on all of sf0.1."""
    x = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    e, ids = np.array([r["embedding"] for r in x], dtype=float), np.array([r["vec_id"] for r in x])
    got = defaultdict(set)
    for r in queries.op10_nearest(spark, "/root/testdata/sf0.1").collect():
        got[r["query_id"]].add(r["vec_id"])
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0} and all(len(v) == 10 for v in got.values())
    recall = []
    for q, found in got.items():
        d = np.linalg.norm(e - e[ids == q][0], axis=1)
        d[ids == q] = np.inf
        recall.append(len(found & set(ids[np.lexsort((ids, d))[:10]].tolist())) / 10)
    print("recall", np.mean(recall))
    assert np.mean(recall) >= 0.95


def test_a_very_common_vector_takes_one_place(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8))
    x[:300] = x[0]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(vectors, vectors.filter("vec_id % 7 = 0"), block=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q, found in got.items():
        if q < 300:
            assert found == [i for i in range(12) if i != q][:10]
    brute = brute_nearest([(i, v.tolist()) for i, v in enumerate(x)], list(got), 10)
    assert np.mean([len(set(found) & {i for _, i in brute[q]}) / 10 for q, found in got.items()]) >= 0.95


def test_nearest_beside_a_crowd(spark):
    x = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()], dtype=float)
    rng = np.random.default_rng(1)
    crowd = rng.permutation(len(x))[: len(x) // 3]
    x[crowd] = x[0] + rng.normal(size=(len(crowd), x.shape[1])) * 0.001
    ask = rng.permutation(len(x))[:200]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(vectors, vectors.filter(vectors["vec_id"].isin(ask.tolist()))).collect():
        got[r["query_id"]].add(r["vec_id"])
    d = np.linalg.norm(x[ask][:, None] - x[None], axis=2)
    d[np.arange(len(ask)), ask] = np.inf
    recall = np.array([len(got[q] & set(np.argsort(d[i], kind="stable")[:10].tolist())) / 10 for i, q in enumerate(ask.tolist())])
    inside = np.isin(ask, crowd)
    print("recall outside", recall[~inside].mean(), "inside", recall[inside].mean())
    assert recall[~inside].mean() >= 0.95 and recall[inside].mean() >= 0.95


def test_nearest_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0]), (10, [1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, score int, block string")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, df, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 10), (1, 1, 0), (1, 2, 10), (9, 1, 0), (9, 2, 1), (10, 1, 0), (10, 2, 1)]
    assert ann.nearest(df.filter("false"), df).collect() == []
    assert ann.nearest(df.filter("vec_id = 0"), df.filter("vec_id = 0")).collect() == []
