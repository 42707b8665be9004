"""Fingerprints, language, SimHash, line dedup and BPE against brute force, and on odd tables."""

import hashlib
import itertools
import json
import random
import struct
import time
from collections import Counter

import numpy as np
import pytest
import xxhash

from pagemill.llm import bpe, fingerprints, langid, linededup, queries, simhash
from pagemill.llm.components import connected_components
from pagemill.llm.cuckoo import CuckooFilter
from pagemill.llm.lexicon import Lexicon, compile_lexicon

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _drop_id string, fp int, key string"
LONG = "word und Straße " * 20_000
ODD = [
    (5, None, "en", "a", 0, "x", 1, "k"),
    (3, "", "en", None, 0, None, None, None),
    (9, " \n\t\n ", None, "a", 5, "x", 1, "k"),
    (4, LONG, "de", "b", len(LONG), "x", 1, "k"),
    (4, LONG, "de", "b", len(LONG), "x", 1, "k"),
    (None, "One Two three four five six seven", "en", "b", 33, "x", 1, "k"),
    (7, "one two THREE four five six seven", "en", "b", 33, "x", 1, "k"),
    (8, "one\ntwo three four\nONE TWO three four\n one two three four ", None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_edits(rows, source):
    order = sorted(source, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    errors = []
    for i, d in enumerate(order):
        follower = order[(i + 1) % len(order)]
        text, after = d["text"] or "", follower["text"] or ""
        if len(by_id[d["doc_id"]]) > 1:
            continue
        (got,) = by_id[d["doc_id"]]
        new = fingerprints.edited(text, after)
        assert got["n_chars"] == len(text)
        assert got["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        errors.append(got["near_edited"] - jaccard(shingles(text), shingles(new)))
        errors.append(got["near_next"] - jaccard(shingles(text), shingles(after)))
        assert abs(got["n_shingles"] - len(shingles(text))) <= 0.5 * len(shingles(text))
    assert np.sqrt(np.mean(np.square(errors))) < 0.06


def test_fingerprints_of_documents_and_edits(spark, docs):
    rows = queries.op1_fingerprints(spark, SF).collect()
    assert len(rows) == len(docs)
    check_edits(rows, docs)
    prints = {}
    for r, d in zip(sorted(rows, key=lambda r: r["doc_id"]), sorted(docs, key=lambda d: d["doc_id"]), strict=True):
        assert prints.setdefault(d["text"], r["fingerprint"]) == r["fingerprint"]


def test_fingerprints_of_odd_rows(odd, none, spark):
    rows = fingerprints.fingerprint_edits(odd).collect()
    assert len(rows) == len(ODD)
    check_edits(rows, [dict(zip(("doc_id", "text"), r[:2], strict=True)) for r in ODD])
    assert fingerprints.fingerprint_edits(none).collect() == []
    (one,) = fingerprints.fingerprint_edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abca").hexdigest()


def plain_sketch(text, k, width=5):
    """The k smallest distinct shingle hashes, with Python's own integers."""
    m = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
        return x ^ (x >> 31)

    byte = [mix((i * 0x9E3779B97F4A7C15) & m) for i in range(1, 257)]
    factor = [mix(i ^ 0x5BF03635D1F26A9B) | 1 for i in range(1, width + 1)]
    words = [mix((sum(byte[b] * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w)) + len(w)) & m) for w in (text or "").encode().lower().split()]
    if not words:
        return []
    if len(words) < width:
        return [mix((sum(w * f for w, f in zip(words, factor, strict=False)) + len(words)) & m)]
    return sorted({mix(sum(w * f for w, f in zip(words[i : i + width], factor, strict=True)) & m) for i in range(len(words) - width + 1)})[:k]


def test_sketches_are_the_k_smallest_hashes(docs):
    texts = [d["text"] for d in docs] + [None, "", " \n", "one", "a b c d", "x " * 400, "w" * 10_000 + " b c d e f", "É é ß\x0b\x1c " * 3, LONG]
    for k in (4, 128):
        made = fingerprints.sketches([(t or "").encode() for t in texts], k)
        assert [x.tolist() for x in made] == [plain_sketch(t, k) for t in texts]


def test_sketches_merge_and_estimate(spark):
    r = random.Random(1)
    words = [f"w{r.randrange(400)}" for _ in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    sa, sb = fingerprints.sketches([a.encode(), b.encode()])
    A, B = shingles(a), shingles(b)
    assert abs(fingerprints.resemblance(sa, sb) - jaccard(A, B)) < 0.12
    assert abs(fingerprints.containment(sa, sb) - len(A & B) / len(A)) < 0.15
    assert abs(fingerprints.distinct_count(sa) / len(A) - 1) < 0.3
    assert len(fingerprints.merge([sa, sb])) == fingerprints.K
    parts = spark.createDataFrame([("x", fingerprints.to_string(sa)), ("x", fingerprints.to_string(sb)), ("y", fingerprints.to_string(sa))], "k string, fingerprint string")
    got = {r["k"]: r["fingerprint"] for r in fingerprints.merge_fingerprints(parts, "k").collect()}
    assert got == {"x": fingerprints.to_string(fingerprints.merge([sa, sb])), "y": fingerprints.to_string(sa)}


def test_language_of_held_out_documents(spark, docs):
    rows = {r["doc_id"]: r for r in queries.op3_language(spark, "/root/testdata/sf0.01").collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [i for i, r in rows.items() if r["held_out"]]
    assert len(rows) == len(truth) and len(held) > 200
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_language_of_odd_rows(spark, odd, none):
    model = langid.train(odd.drop("fp"))
    out = langid.identify(odd, model).collect()
    assert len(out) == len(ODD)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in out)
    assert langid.identify(none, model).collect() == []
    nothing = langid.train(none)
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}
    clash = langid.identify(odd.withColumnRenamed("key", "score"), model)
    assert clash.columns[-4:] == ["lang_pred", "score_", "n_spans", "known"] and clash.count() == len(ODD)


def test_viterbi_is_the_best_path_and_scripts_narrow():
    r = np.random.default_rng(0)
    model = langid.Model(["a", "b", "c"], np.ones((langid.BINS, 3)), np.ones((len(langid.SCRIPT_NAMES), 3)), np.ones(3), switch=5.0)
    for _ in range(100):
        n = int(r.integers(1, 6))
        scores = (r.normal(size=(n, 3)) * 8).astype("f4")
        got = model.labels(np.concatenate([scores, scores[:1]]), np.array([n, 0, 1]))[:n]
        best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 5 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        assert tuple(got) == best
    texts = {"en": "the cat sat on that mat and then ran", "ru": "кошка сидела на ковре и потом ушла"}
    langs = sorted(texts)
    counts, scripts = [], []
    for lang in langs:
        words = langid.Words([texts[lang]])
        counts.append(np.bincount(words.bins, minlength=langid.BINS))
        scripts.append(np.bincount(words.scripts, weights=words.lengths, minlength=len(langid.SCRIPT_NAMES)))
    model = langid.Model(langs, np.stack(counts, 1), np.stack(scripts, 1), np.ones(2))
    assert [x[2] for x in model.spans("that mat кошка ушла the cat sat")] == ["en", "ru", "en"]
    assert model.predict(["кот", "12", "日本"])[0] == ["ru", "und", "en"]
    assert model.predict(["that mat кошка ушла", "cat 日本", "日本", ""])[3] == [1.0, 0.6, 0.0, 0.0]


def test_long_texts_are_labelled_in_parts_as_in_one(monkeypatch):
    r = np.random.default_rng(5)
    model = langid.Model(list("abcd"), np.ones((langid.BINS, 4)), np.ones((len(langid.SCRIPT_NAMES), 4)), np.ones(4), switch=6.0)
    counts = np.array([3, 0, 700, 64, 65, 1, 129, 500])
    scores = r.integers(-5, 6, (counts.sum(), 4)).astype("f4") + r.random((counts.sum(), 4)).astype("f4") / 8
    monkeypatch.setattr(langid, "PART", 1 << 40)
    whole = model.labels(scores, counts)
    for part in (1, 7, 64):
        monkeypatch.setattr(langid, "PART", part)
        assert (model.labels(scores, counts) == whole).all()


def test_languages_of_a_text_of_two_megabytes_take_seconds():
    model = langid.Model(["a", "b"], np.random.default_rng(0).random((langid.BINS, 2)), np.ones((len(langid.SCRIPT_NAMES), 2)), np.ones(2))
    begin = time.time()
    assert model.predict(["some words of a text " * 100_000])[0] in (["a"], ["b"])
    assert time.time() - begin < 10


def brute_simhash(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    found = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    """(doc_id, fingerprint) rows to component ids."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for (doc, _), g in zip(prints, group, strict=True):
        if doc is not None:
            low[g] = min(low.get(g, doc), doc)
    return [low.get(g) for g in group]


def test_simhash_components(spark, docs):
    prints = [(d["doc_id"], brute_simhash(d["text"])) for d in docs]
    expected = {d: (f"{f:016x}", c) for (d, f), c in zip(prints, brute_components(prints), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash(spark, SF).collect()}
    assert got == expected


def test_simhash_of_odd_rows(odd, none):
    prints = [(r[0], brute_simhash(r[1])) for r in ODD]
    expected = sorted((d is None, d or 0, f"{f:016x}", c) for (d, f), c in zip(prints, brute_components(prints), strict=True))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect())
    assert got == expected
    assert simhash.near_duplicates(none).collect() == []


def test_links_lose_no_pair(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    near = []
    for _ in range(300):
        x = r.choice(base)
        for bit in r.sample(range(64), r.randint(0, 5)):
            x ^= 1 << bit
        near.append(x)
    fps = sorted(set(base + near))
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    labels = {r["node"]: r["label"] for r in connected_components(found).collect()}
    expected = brute_components([(s, f) for s, f in zip(signed, fps, strict=True)])
    assert [labels.get(s, s) for s in signed] == expected


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7), (None, 3), (200, None)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def brute_lines(rows, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and text is not None and len(key(line)) >= least:
                held.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == doc]
        out.append((doc is None, doc or 0, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def lines_of(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect())


def test_line_dedup(spark, docs, odd, none):
    rows = [(d["doc_id"], d["text"]) for d in docs]
    assert lines_of(linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_lines(rows)
    out = linededup.dedup_lines(odd.drop("key"))
    assert lines_of(out) == brute_lines([r[:2] for r in ODD])
    assert set(odd.drop("key").columns) < set(out.columns)
    assert linededup.dedup_lines(none).collect() == []
    ties = [(2, "ärger über \n é123456789"), (1, "ÄRGER ÜBER\n é123456789\nÉ123456789"), (1, "ärger über"), (3, "ärger über\nshort\n\t 0123456789\r"), (4, "0123456789\nshort")]
    assert lines_of(linededup.dedup_lines(spark.createDataFrame(ties, "doc_id long, text string"))) == brute_lines(ties)


def test_a_very_common_line_is_dealt_out(spark):
    rows = [(i, f"common to every document\nline of its own number {i}\npair line {i // 2} here") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    refs = linededup.line_refs(docs)
    shared = linededup.count_refs(refs).filter("low <> high").cache()
    assert shared.count() == 201
    filters = linededup.build_filters(shared, 2).cache()
    for rows_of_a_task in (50, 1000):
        hits = linededup.probe(refs, filters, 2, rows_of_a_task)
        assert 800 <= hits.count() < 850  # the filter spares the exact table lines of one document
        drops = linededup.confirm(hits, shared, rows_of_a_task)
        assert lines_of(linededup.drop_lines(docs, drops)) == brute_lines(rows)


def test_line_store_can_be_undone(spark):
    rows = [(i, f"line number {i % 3} here\nunique line {i} there\ncommon to every document") for i in range(9)]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    store = linededup.LineStore(spark, shards=2)
    assert lines_of(store.apply(frame(rows[:2]))) == lines_of(linededup.drop_lines(frame(rows[:2]), frame([]).selectExpr("doc_id", "doc_id h", "doc_id g")))
    store.add(frame(rows[:5]))
    store.add(frame(rows[5:]))
    assert lines_of(store.apply(frame(rows))) == brute_lines(rows)
    store.remove(frame(rows[:4]))
    left = rows[4:]
    assert lines_of(store.apply(frame(left))) == brute_lines(left)
    store.remove(frame(left[1:]))
    assert lines_of(store.apply(frame(left[:1]))) == brute_lines(left[:1])
    assert {r["refs"] for r in store.counts().collect()} == {1}
    store.add(frame([(4, "replaced text that is long")]))
    assert [r["refs"] for r in store.counts().collect()] == [1]


def check_store(store, rows, spark):
    """The store equals one that is built from rows: the exact table, and filters that hold the shared keys and no others."""
    built = linededup.count_refs(linededup.line_refs(spark.createDataFrame(rows, "doc_id long, text string")))
    assert Counter(tuple(r) for r in store.counts().collect()) == Counter(tuple(r) for r in built.collect())
    shared = [r["h"] for r in built.filter("low <> high").collect()]
    filters = {r["shard"]: r for r in store.filters().collect()}
    for shard, r in filters.items():
        mine = np.array([h for h in shared if h % store.shards == shard], dtype=np.int64).view(np.uint64)
        made = CuckooFilter.from_bytes(r["filter"])
        assert made.contains(mine).all() and np.count_nonzero(made.table) == len(mine)
    assert {h % store.shards for h in shared} <= set(filters)
    assert sum(r["load"] for r in filters.values()) == sum(r["refs"] for r in built.filter("low <> high").collect())


def test_line_store_writes_what_a_change_touches(spark):
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    r = random.Random(8)
    rows = {i: f"own line of document {i}\n" + "\n".join(f"shared line {r.randrange(150)} of all" for _ in range(8)) for i in range(60)}
    store = linededup.LineStore(spark, shards=16)
    store.add(frame(list(rows.items())))
    check_store(store, list(rows.items()), spark)
    before = dict(store.where)
    store.add(frame([(100, "a line that no other has\nnor this one, which is new")]))  # shares nothing: no filter is written
    assert store.where == before
    store.add(frame([(101, "a line that no other has")]))  # one key comes to be shared
    assert sum(v == store.version for v in store.where.values()) == 1
    rows |= {100: "a line that no other has\nnor this one, which is new", 101: "a line that no other has"}
    check_store(store, list(rows.items()), spark)
    again = linededup.LineStore.open(spark, store.path, shards=16)
    assert (again.version, again.where) == (store.version, store.where)
    gone = [100, 3, 4, 5, 6, 7, 999]
    again.remove(frame([(i, None) for i in gone]))
    rows = {i: t for i, t in rows.items() if i not in gone}
    check_store(again, list(rows.items()), spark)
    many = {i: "\n".join(f"pair line {j} for a full filter" for j in range(i % 2, 600, 2)) for i in range(200, 204)}
    again.add(frame(list(many.items())))  # filters are full, and made anew
    rows |= many
    check_store(again, list(rows.items()), spark)
    assert lines_of(again.apply(frame(list(rows.items())))) == brute_lines(list(rows.items()))


def test_cuckoo_filter():
    r = np.random.default_rng(3)
    for n in (0, 1, 50, 5000):
        keys = r.integers(0, 1 << 62, n).astype(np.uint64)
        made = CuckooFilter.of(keys)
        assert made.contains(keys).all()
        again = CuckooFilter.from_bytes(made.to_bytes())
        again.remove(keys[: n // 2])
        assert again.contains(keys[n // 2 :]).all()
        assert again.contains(keys[: n // 2]).mean() < 0.02 if n > 10 else True
    with pytest.raises(ValueError):
        CuckooFilter.of(np.full(50, 7, dtype=np.uint64))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_equals_the_library(spark, docs, library):
    rows = {r["doc_id"]: r for r in queries.op9_bpe(spark, SF).collect()}
    for d in docs:
        ids = library.encode(d["text"], add_special_tokens=False).ids
        got = rows[d["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_odd_texts(library):
    own = bpe.Tokenizer(queries.tokenizer_path())
    r = random.Random(3)
    signs = [chr(c) for c in [*range(0x250), *range(0x300, 0x345), *range(0x370, 0x400), 0x600, 0x661, 0x1100, 0x1161, 0x11A8, 0x3042, 0x4E00, 0x1F600, 0x2028, 0x200D, 0xFB01, 0x2160, 0x1E9E, 0x10400]]
    texts = ["", " ", "<|endoftext|>x <|startoftext|>", "don't I'LL we'Ve", "ΣΑΣ Σ", "İstanbul", "a\x1cb \x85c", "A<|ENDOFTEXT|>", "<|endoftext|"]
    texts += ["".join(r.choice(signs) for _ in range(r.randint(1, 30))) for _ in range(2000)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    raw = [t.encode() for t in texts]
    ids, bounds = own.run(raw)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [own.encode(t) for t in texts]
    assert own.decode_many(ids, bounds).to_pylist() == [own.decode(own.encode(t)) for t in texts]


def test_bpe_of_very_long_words(library):
    own, r = bpe.Tokenizer(queries.tokenizer_path()), random.Random(6)
    letters = "".join(r.choice("etaonishrdlu") for _ in range(1_000_000))
    words = [letters, "a" * 100_000, "the" * 30_000, "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(30_000))]
    words += ["".join(r.choice("aab") for _ in range(r.randint(65, 300))) for _ in range(200)]
    begin = time.time()
    assert [own.encode(w) for w in words] == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert time.time() - begin < 60


def test_bpe_of_odd_rows(odd, none, library):
    out = bpe.encode_documents(odd, queries.tokenizer_path(), words=3).collect()
    assert sorted(r["n_tokens"] for r in out) == sorted(len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in ODD)
    assert bpe.encode_documents(none, queries.tokenizer_path()).collect() == []


def test_lexicon(tmp_path):
    r = random.Random(5)
    entries = {bytes(r.choices(b"abcx\xff", k=r.randint(0, 7))): [r.randrange(50_000) for _ in range(r.randint(1, 4))] for _ in range(800)}
    path = tmp_path / "lexicon"
    path.write_bytes(compile_lexicon(entries))
    made = Lexicon(str(path))
    assert made.n_words == len(entries) - (b"" in entries)
    assert all(made.lookup(w) == ids for w, ids in entries.items() if w)
    assert all(made.lookup(w) is None for w in (b"", b"zz", b"abcabcabc"))
    assert made.n_states < sum(map(len, entries))
    empty = tmp_path / "empty"
    empty.write_bytes(compile_lexicon({}))
    assert Lexicon(str(empty)).lookup(b"a") is None
    with open(queries.tokenizer_path()) as f:
        assert json.load(f)["model"]["type"] == "BPE"
