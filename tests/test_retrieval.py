"""Scores, fusion, selection and sessions against plain loops and known behaviour."""

import itertools
import math
import random
import re
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from pagemill import queries
from pagemill.config import RetrievalConfig
from pagemill.operators import evaluation, fusion, index, inspection, lexical, resolver, selection, semantic, session
from pagemill.plans import search as P

WORDS = "alpha beta gamma delta contract contracts policy policies meeting zeta".split()


def units(n, seed):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(WORDS, k=r.choice([0, 1, 5, 20, 40])))) for i in range(n)]


def tokens(text):
    out = []
    for w in re.findall("[a-z0-9]+", text.lower()):
        if len(w) > 4 and w.endswith("ies"):
            w = w[:-3] + "y"
        elif w.endswith("ing") and len(w) >= 7:
            w = w[:-3]
        elif w.endswith("ed") and len(w) >= 6:
            w = w[:-2]
        elif w.endswith("s") and len(w) >= 5 and not w.endswith("ss"):
            w = w[:-1]
        out.append(w)
    return out


def okapi(rows, asked):
    """A term that is asked m times counts m times, with m times its frequency of documents."""
    terms = tokens(asked)
    docs = [tokens(t) for _, t in rows]
    average = sum(map(len, docs)) / len(docs)
    out = {}
    for (key, _), d in zip(rows, docs, strict=True):
        total = 0.0
        for t in terms:
            tf = d.count(t)
            df = terms.count(t) * sum(t in x for x in docs)
            if tf:
                total += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / average))
        if set(terms) & set(d):
            out[key] = round(total, 6)
    return out


@pytest.mark.parametrize("asked", ["alpha contract", "policies policy gamma gamma gamma", "meeting unknown"])
def test_bm25_equals_a_loop(spark, asked):
    rows = units(40, 1)
    df = spark.createDataFrame(rows, "key int, text string")
    questions = spark.createDataFrame([(1, asked)], "query_id long, text string")
    got = {r["key"]: r["score"] for r in lexical.bm25(df, ["key"], questions).collect()}
    want = okapi(rows, asked)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_prefix_bm25_equals_a_full_text_index(spark):
    rows = units(60, 2)
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE x USING fts5(text)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index here")
    db.executemany("INSERT INTO x(rowid, text) VALUES (?, ?)", rows)
    df = spark.createDataFrame(rows, "key int, text string")
    for asked in ("contract", "polic meet", "gam gam delta", "alph bet"):
        found = dict(db.execute("SELECT rowid, -bm25(x) FROM x WHERE x MATCH ?", (" OR ".join(f'"{t}"*' for t in asked.split()),)))
        questions = spark.createDataFrame([(1, asked)], "query_id long, text string")
        got = {r["key"]: r["score"] for r in lexical.prefix_bm25(df, ["key"], questions).collect()}
        assert got.keys() == found.keys() and all(got[k] == pytest.approx(found[k], abs=2e-6) for k in found)


def test_missing_terms(spark):
    df = spark.createDataFrame([(1, "raw policies here")], "key int, text string")
    questions = spark.createDataFrame([(1, "policies contract raws")], "query_id long, text string")
    named = lambda found: {r["term"] for r in found.collect()}
    assert named(lexical.missing_terms(df, ["key"], questions)) == {"contract", "raws"}
    assert named(lexical.missing_prefixes(df, questions)) == {"policy", "contract", "raws"}  # the stem of policies is no prefix of it
    assert named(lexical.missing_terms(df.filter("false"), ["key"], questions)) == {"policy", "contract", "raws"}


def test_cosines(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [-1.0, 0.0]), (4, None)], "doc_id long, vec array<float>")
    asked = [(7, [1.0, 0.0]), (8, [0.0, 1.0])]
    want = {(7, 1): 1.0, (7, 2): 0.6, (7, 3): 0.0, (8, 1): 0.0, (8, 2): 0.8, (8, 3): 0.0}
    for f in (semantic.cosines, semantic.cosines_fast):
        got = {(r["query_id"], r["doc_id"]): r["sem"] for r in f(vectors, "doc_id", asked).collect() if r["sem"] is not None and r["doc_id"] != 4}
        assert got == pytest.approx(want, abs=1e-6)


def test_encoder_provider(spark):
    import numpy as np

    provider = semantic.EncoderProvider("lengths", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    rows = provider.vectors(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")).collect()
    assert all(sum(x * x for x in r["vec"]) == pytest.approx(1, abs=1e-6) for r in rows)


def test_minmax(spark):
    value = lambda x, lo, hi: spark.range(1).select(fusion.minmax(F.lit(x), F.lit(lo), F.lit(hi))).first()[0]
    assert [value(2.0, 1.0, 3.0), value(2.0, 2.0, 2.0), value(0.0, 0.0, 0.0)] == [0.5, 1.0, 0.0]


def greedy(rows, threshold=0.6):
    kept = []
    for rank, text in rows:
        w = set(text.lower().split())
        if not any(len(w & v) / max(1, len(w | v)) > threshold for _, v in kept):
            kept.append((rank, w))
    return [r for r, _ in kept]


def test_dedup_equals_a_loop(spark):
    r = random.Random(6)
    rows = [(1, d, 1, rank, " ".join(r.choices("abcdefg", k=r.randint(0, 6)))) for d in range(8) for rank in range(1, 10)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, page int, rank long, text string")
    got = {}
    for x in selection.dedup(df).collect():
        got.setdefault(x["doc_id"], []).append(x["rank"])
    assert {d: sorted(v) for d, v in got.items()} == {d: greedy([(x[3], x[4]) for x in rows if x[1] == d]) for d in range(8)}


def trim_by_hand(scores, sents, keep=40):
    """Regions of best windows, widened, grown and merged, one step after the other."""
    n = len(sents)
    banned, found = set(), []
    best_of_all = None
    while len(found) < 3:
        options = [(sum(scores[i : j + 1]) / (j - i + 1), -i, -j) for i in range(n) for j in range(i, min(i + 3, n)) if not banned & set(range(i, j + 1))]
        if not options:
            break
        top = max(o[0] for o in options)
        first = next((-a, -b) for s, a, b in options if s == top)
        if found and (best_of_all <= 0 or top < best_of_all * 0.6):
            break
        best_of_all = top if best_of_all is None else best_of_all
        found.append(first)
        banned |= set(range(first[0], first[1] + 1))
    kept = {k for i, j in found for k in range(max(0, i - 1), min(n - 1, j + 1) + 1)}
    words = lambda: sum(len(sents[k].split()) for k in kept)
    while words() < keep:
        low = min(kept)
        if low > 0:
            kept.add(low - 1)
            continue
        high = next(k for k in itertools.count(low) if k not in kept)
        if high >= n:
            break
        kept.add(high)
    out, last = [], -1
    for k in sorted(kept):
        if k > last + 1:
            out.append("…")
        out.append(sents[k])
        last = k
    return " ".join(out + (["…"] if last < n - 1 else []))


def test_trimming_equals_the_steps(spark):
    r = random.Random(8)
    cases = []
    for i in range(150):
        n = r.randint(1, 16)
        cases.append((i, [float(r.choice([0, 0, 1, 2, 3])) for _ in range(n)], [" ".join(f"s{k}" for _ in range(r.randint(1, 9))) for k in range(n)]))
    rows = [(i, 1, k, s, len(s.split()), x) for i, scores, sents in cases for k, (s, x) in enumerate(zip(sents, scores, strict=True))]
    df = spark.createDataFrame(rows, "query_id long, rank long, idx long, sentence string, n_words long, score double")
    keys = ["query_id", "rank"]
    got = {x["query_id"]: x["trimmed"] for x in selection.joined_islands(selection.islands(selection.kept_sentences(df, keys), keys), keys).collect()}
    assert got == {i: trim_by_hand(scores, sents) for i, scores, sents in cases}


def test_budget_keeps_the_first_and_stops(spark):
    rows = [(1, 1, "x" * 9000), (1, 2, "y"), (2, 1, "a" * 5000), (2, 2, "b" * 4000), (2, 3, "c")]
    df = spark.createDataFrame(rows, "query_id long, rank long, block string")
    assert sorted((r["query_id"], r["rank"]) for r in selection.within_budget(df).collect()) == [(1, 1), (2, 1)]


PAGES = [(1, "The zebra walks. See section 4 for more."), (2, "Policies on refunds and contracts."), (3, "Nothing of note here."), (4, "The lion sleeps in a subscription."), (5, "A zebra again; see page 99 and see section 2.1."), (6, "2.1 Terms of Use\nbody")]


def pages_df(spark):
    return spark.createDataFrame([("d", p, t) for p, t in PAGES], "doc_id string, page long, text string")


def test_neighbours_and_references(spark):
    pages = pages_df(spark)
    hits = spark.createDataFrame([(1, "d", 1), (1, "d", 5)], "query_id long, doc_id string, page long")
    last = selection.last_pages(pages)
    assert sorted(r["page"] for r in selection.near_pages(hits, last).collect()) == [1, 2, 4, 5, 6]
    assert sorted(r["page"] for r in selection.neighbor_suggestions(hits, last).collect()) == [2, 4, 6]
    refs = {(r["ref"], r["target"]) for r in selection.xref_pages(pages, hits).collect()}
    assert refs == {("4", 4), ("2.1", 5), ("99", 5)}


def test_anchors_begin_with_the_outline(spark):
    outline = spark.createDataFrame([("d", 0, "Opening"), ("d", 1, "2.1 Terms of Use")], "doc_id string, pos int, title string")
    got = [r["anchor"] for r in selection.anchors(pages_df(spark), outline).orderBy("rank").collect()]
    assert got == ["Opening", "2.1 Terms of Use"]


def files_and_pages(spark):
    names = {"/r/q3-financial-report.pdf": 10, "/r/lease-agreement.pdf": 30, "/r/apple-10k-2023.pdf": 20, "/r/apple-10k-2022.pdf": 5, "/r/sub/lease-agreement.pdf": 1, "/out/secret.pdf": 99}
    texts = {"/r/lease-agreement.pdf": ["the tenant pays rent monthly", "zebra clause about deposits"], "/r/q3-financial-report.pdf": ["revenue grew strongly in the quarter"], "/r/apple-10k-2023.pdf": ["annual filing"], "/r/sub/lease-agreement.pdf": ["another lease about quokkas"], "/out/secret.pdf": ["hidden"], "/r/apple-10k-2022.pdf": ["warren wrote this shareholder letter"]}
    files = spark.createDataFrame([(p, p.rsplit("/", 1)[1], p.rsplit("/", 1)[0], 100, t * 10**9, "", "", "") for p, t in names.items()], "path string, name string, parent string, size long, mtime_ns long, title string, author string, subject string")
    pages = spark.createDataFrame([(p, i + 1, t) for p, ts in texts.items() for i, t in enumerate(ts)], "path string, page int, text string")
    return files, pages


def test_session(spark):
    files, pages = files_and_pages(spark)
    s = P.RetrievalSession(spark, files, pages, roots=["/r"])
    assert s.search("zebra").startswith("No documents loaded")
    assert s.ingest("/out/secret.pdf").startswith("ERROR") and s.ingest("/r/none.pdf").startswith("ERROR")
    assert s.ingest("/r/lease-agreement.pdf") == "ingested 'lease-agreement.pdf' (keywords only): 2 pages -> 2 chunks"
    s.ingest("/r/sub/lease-agreement.pdf")
    assert len(s.loaded) == 2 and any("#" in d for d in s.loaded)
    answer = s.search("zebra deposits")
    assert 'source="lease-agreement.pdf p2"' in answer and s.totals["searches"] == 1
    assert "No relevant chunks" in s.search("quantum teleportation") and s.totals["searches"] == 1
    twin = next(d for d in s.loaded if "#" in d)
    assert "quokkas" in s.search("another quokkas", k=99, doc_id=twin)
    assert s.search("x", doc_id="nope").startswith("No loaded document matches")
    assert s.clear("lease-agreement.pdf") == "cleared 1 document(s)" and s.totals["searches"] >= 1
    assert s.clear().startswith("cleared all") and s.totals["searches"] == 0 and s.status() == []
    assert "revenue" in s.ask("q3 report", "how did revenue grow?")
    assert s.ask("apple 10k", "x").startswith("Several")
    assert s.ask("", "").startswith("Say which")
    assert s.ask("unheard of thing", "nothing").startswith("No document")
    assert [r["name"] for r in s.list_documents().orderBy("rank").limit(1).collect()] == ["lease-agreement.pdf"]
    assert s.savings().startswith("searches: ")
    s.config = RetrievalConfig(ttl_minutes=1e-9)
    time.sleep(0.01)
    assert s.status() == []


def test_resolver(spark):
    files, pages = files_and_pages(spark)
    probes = resolver.probe_text(files, pages)
    refs = [(1, "q3 report"), (2, "the latest lease"), (3, "apple 10k"), (4, "/r/apple-10k-2022.pdf"), (5, "warren's shareholder letter"), (6, "document"), (7, "the newest")]
    got = {r["ref_id"]: (r["kind"], r["candidates"]) for r in resolver.resolve(spark.createDataFrame(refs, "ref_id long, target string"), files, probes).collect()}
    assert got[1] == ("one", ["/r/q3-financial-report.pdf"])
    assert got[3][0] == "many" and set(got[3][1]) == {"/r/apple-10k-2023.pdf", "/r/apple-10k-2022.pdf"}
    assert got[4] == ("path", ["/r/apple-10k-2022.pdf"])
    assert got[5] == ("one", ["/r/apple-10k-2022.pdf"])
    assert got[6][0] == "none" and got[7] == ("one", ["/out/secret.pdf"])
    assert got[2][1][0].endswith("lease-agreement.pdf")


def test_swapped_arguments(spark):
    asks = [("what is the rent", "lease agreement", "lease-agreement.pdf"), ("lease agreement", "what is the rent", "lease-agreement.pdf")]
    got = [r["question"] for r in resolver.question_of(spark.createDataFrame(asks, "target string, query string, name string")).collect()]
    assert got == ["what is the rent", "what is the rent"]


def test_launch_roots():
    assert resolver.launch_roots(["", " ", "${dir}", "/b", "/a"], ["/a"]) == ["/a", "/b"]


def test_index_is_built_once_and_expires(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, "one two policies"), ("b", 1, "three")], "doc_id string, page long, text string")
    files = spark.createDataFrame([("a", 10, 1), ("b", 20, 2)], "doc_id string, size long, mtime_ns long")
    made = index.Index(spark, str(tmp_path / "index"))
    assert made.table("pages") is None and made.clear(0.0) == 0
    assert made.build(files, pages, now=1000.0) == 2
    assert made.build(files, pages, now=1001.0) == 0
    changed = files.withColumn("mtime_ns", F.col("mtime_ns") + (F.col("doc_id") == "b").cast("long"))
    assert made.build(changed, pages, now=1002.0) == 1
    assert made.table("passages").count() == 2 and made.table("postings").count() == 4
    metas = index.meta_map(made.table("meta"))
    assert {r["doc_id"]: r["meta"]["built_at"] for r in metas.collect()} == {"a": "1000.0", "b": "1002.0"}
    assert made.clear(1000.0 + 14 * 86400, expired_only=True) == 0
    assert made.clear(1001.5 + 14 * 86400, expired_only=True) == 1
    assert [r["doc_id"] for r in made.table("pages").select("doc_id").collect()] == ["b"]
    assert made.build(changed, pages, now=1003.0, force=True) == 2


def test_index_builds_append_and_compact(spark, tmp_path):
    folder = tmp_path / "index"
    stamp = lambda: {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    made = index.Index(spark, str(folder))
    pages = spark.createDataFrame([(d, 1, f"text of {d}") for d in "abc"], "doc_id string, page long, text string")
    files = spark.createDataFrame([(d, 1, 1) for d in "abc"], "doc_id string, size long, mtime_ns long")
    assert made.build(files.filter("doc_id = 'a'"), pages, now=1.0) == 1
    before = stamp()
    assert made.build(files, pages, now=2.0) == 2
    assert before.items() <= stamp().items()  # nothing that was there is written again
    newer = pages.withColumn("text", F.concat(F.lit("new "), "text"))
    assert made.build(files.filter("doc_id = 'b'").withColumn("size", F.lit(2)), newer, now=3.0) == 1
    texts = lambda: {r["doc_id"]: r["text"] for r in made.table("pages").collect()}
    assert texts() == {"a": "text of a", "b": "new text of b", "c": "text of c"}
    assert [r["text"] for r in made.table("pages", files.filter("doc_id = 'b'")).collect()] == ["new text of b"]
    made.compact()
    assert texts() == {"a": "text of a", "b": "new text of b", "c": "text of c"} and made.current().select("build").distinct().count() == 1
    assert made.clear(4.0) == 3 and texts() == {} and made.clear(5.0) == 0
    assert made.build(files, pages, now=6.0) == 3


def test_hashing_counts_tokens_in_one_pass(spark, monkeypatch):
    import hashlib

    r = random.Random(5)
    long = " ".join(f"Word{r.randrange(100_000)}" for _ in range(200_000))
    texts = [long, "", None, "\u00c9t\u00e9 A-b a", "?!", *(" ".join(r.choices(WORDS, k=30)) for _ in range(40))]
    monkeypatch.setattr(semantic.HashingProvider, "ROWS", 7)
    monkeypatch.setattr(semantic.Places, "KEPT", 1000)
    for dim in (64, 4096):
        begun = time.monotonic()
        got = {x["i"]: x["vec"] for x in semantic.HashingProvider(dim).vectors(spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)).collect()}
        assert time.monotonic() - begun < 20  # a pass for each place took minutes
        for i, text in enumerate(texts):
            counts = [0] * dim
            for w in re.findall("[a-z0-9]+", (text or "").lower()):
                counts[int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % dim] += 1
            length = max(math.sqrt(sum(n * n for n in counts)), 1.0)
            assert all(abs(x - n / length) <= 1e-6 for x, n in zip(got[i], counts, strict=True))
    assert semantic.HashingProvider().vectors(spark.createDataFrame([], "text string")).collect() == []


def test_session_with_vectors_and_an_index(spark, tmp_path):
    filler = " ".join(f"The {w} of the archive is listed here with its number and its date." for w in ("map", "letter", "seal", "ledger", "survey", "deed", "drawing"))
    text = f"{filler} Zebras may be kept on the premises only with written consent. {filler}"
    files = spark.createDataFrame([("/r/a.pdf", "a.pdf", "/r", 10, 1, "", "", "")], "path string, name string, parent string, size long, mtime_ns long, title string, author string, subject string")
    pages = spark.createDataFrame([("/r/a.pdf", 1, text), ("/r/a.pdf", 2, "Deposits are returned after ninety days.")], "path string, page int, text string")
    provider = semantic.HashingProvider(256)
    made = index.Index(spark, str(tmp_path / "index"))
    one = P.RetrievalSession(spark, files, pages, provider=provider, index=made)
    assert "(encoded)" in one.ingest("/r/a.pdf")
    answer = one.search("are zebras kept with written consent")
    assert "Zebras may be kept" in answer and "keywords only" not in answer
    assert answer.count("archive") <= 4  # trimmed to the sentences nearest to the question
    two = P.RetrievalSession(spark, files, pages, provider=provider, index=made)
    assert "(reused index)" in two.ingest("/r/a.pdf")
    assert two.search("are zebras kept with written consent") == answer
    assert "(encoded)" in P.RetrievalSession(spark, files.withColumn("size", F.lit(11).cast("long")), pages, provider=provider, index=made).ingest("/r/a.pdf")

    def broken():
        raise OSError("no model")

    three = P.RetrievalSession(spark, files, pages, provider=semantic.Sticky(broken))
    assert "(keywords only)" in three.ingest("/r/a.pdf") and "keywords only" in three.search("zebras")
    assert "No relevant chunks" in one.search("qqq zzz")


def test_catalog_and_ledger(spark):
    log = [(1, 1, "ingest", "a"), (2, 1, "ingest", "a#1"), (3, 1, "search", None), (4, 1, "clear", "a"), (5, 1, "ingest", "b"), (6, 1, "search", None), (7, 2, "ingest", "c"), (8, 2, "clear", None), (9, 1, "clear", None), (10, 1, "search", None), (11, 1, "ingest", "z")]
    rows = [(i, s, op, d, 100, 30 if i != 10 else 400, 2) for i, s, op, d in log]
    df = spark.createDataFrame(rows, "seq long, session_id long, op string, doc_id string, naive_tokens long, actual_tokens long, chunks int").withColumn("ts", F.current_timestamp())
    assert [(r["session_id"], r["doc_id"]) for r in session.catalog(df).collect()] == [(1, "z")]
    assert sorted(r["doc_id"] for r in session.catalog(df.filter("seq < 9 AND session_id = 1")).collect()) == ["b"]
    got = [(r["seq"], r["epoch"], r["searches"], r["saved_tokens"], r["percent"]) for r in session.running_ledger(df).orderBy("seq").collect()]
    assert got == [(3, 0, 1, 70, 70), (6, 0, 2, 140, 70), (10, 1, 1, 0, 0)]


def test_eviction_is_strict(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00'), (2, timestamp'2024-01-01 00:00:00.000001') v(id, ts)")
    got = {r["id"]: r["evicted"] for r in session.evicted(rows, F.lit("2024-01-01 00:30:00.000001").cast("timestamp")).collect()}
    assert got == {1: True, 2: False}
    assert not any(r["evicted"] for r in session.evicted(rows, F.current_timestamp(), 0).collect())


def test_recall(spark):
    frame = lambda rows: spark.createDataFrame(rows, "query_id long, page long")
    questions = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    found, gold = frame([(1, 5), (2, 6), (4, 1)]), frame([(1, 5), (1, 7), (2, 7), (3, 1)])
    assert tuple(evaluation.recall(found, gold, questions, "page").first()) == (3, 1, 1, 0.333333, 0.333333)
    assert tuple(evaluation.false_accept(found, gold, questions).first()) == (1, 1, 1.0)


def test_false_accept_equals_its_sql_where_every_item_has_gold(spark, tmp_path):
    import duckdb

    text = "the quick zebra walks over the frozen lake at dawn"
    spark.createDataFrame([(1, f"so {text} again"), (2, "nothing of it")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = duckdb.connect()
    made.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for items, n in (([(7, text)], 0), ([(7, text), (8, "a zebra that walks elsewhere")], 1)):
        spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
        made.execute(f"CREATE OR REPLACE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
        got, want = tuple(queries.QUERIES["false_accept"](spark, str(tmp_path)).first()), made.execute(queries.SQL["false_accept"]).fetchone()
        assert repr(got) == repr(want) and got[0] == n


def test_tables(spark):
    pages = spark.createDataFrame([("d", 1, "x\n| a | b |\nc | d\n\ny|z")], "doc_id string, page long, text string")
    got = [(r["table_no"], r["row_no"], r["cells"]) for r in inspection.table_rows(pages).orderBy("table_no", "row_no").collect()]
    assert got == [(1, 1, "a\tb"), (1, 2, "c\td"), (2, 1, "y\tz")]


def test_near_duplicates_do_not_use_up_a_ranking(spark):
    text = " ".join(f"word{i}" for i in range(30)) + " zebra"
    passages = spark.createDataFrame([("d", 100_000 + i, 1, text) for i in range(120)] + [("d", 200_001, 2, "zebra " + " ".join(f"other{i}" for i in range(80)))], "doc_id string, passage_id long, page long, text string")
    questions = spark.createDataFrame([(1, "zebra", 2)], "query_id long, text string, k int")
    best = P.picked(passages, questions, P.hybrid(passages, questions))
    assert best.count() == 1  # the longer one is the minimum of both signals and scores 0
    more = passages.unionByName(spark.createDataFrame([("e", 100_001, 1, "nothing here")], passages.schema))
    best = P.picked(more, questions, P.hybrid(more, questions))
    assert sorted(r["page"] for r in best.collect()) == [1, 2]
