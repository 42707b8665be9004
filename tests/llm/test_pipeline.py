"""The pipeline against a plain version of each stage, in one process."""

import hashlib
import re
import struct
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from test_other_operators import brute_targets
from test_text_operators import brute_components, brute_lines, brute_simhash

import corpus_pipeline
from pagemill.llm import langid, queries, resemblance
from pagemill.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_mix(rows):
    """Rows (doc_id, text, source, ...) as often as the mix takes them, the last copy cut to its first words."""
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    targets = brute_targets(sizes)
    out = []
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for source, mine in by.items():
        left = int(np.floor(targets[source] + 1e-9))
        mine.sort(key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"]))
        while left > 0 and sizes[source]:
            for r in mine:
                n = len(words(r["text"]))
                if 0 < n <= left:
                    out.append(dict(r))
                elif n and left:
                    text = "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r["text"])[:left])
                    out.append(dict(r) | {"text": text, "n_chars": len(text)})
                left -= min(n, left)
    return out


def brute_pipeline(docs, model, library):
    kept = []
    for d in docs:
        (lang,), _, _, (known,) = model.predict([d["text"] or ""])
        if lang != "und" and known >= corpus_pipeline.LEAST_KNOWN:
            kept.append(dict(d) | {"lang": lang})
    dropped = {doc: (n, text) for _, doc, _, n, text in brute_lines([(d["doc_id"], d["text"]) for d in kept])}
    lines = []
    for d in kept:
        n, text = dropped[d["doc_id"]]
        if not n:
            lines.append(d)
        elif words(text):
            lines.append(d | {"text": text, "n_chars": len(text)})
    groups = brute_components([(d["doc_id"], brute_simhash(d["text"])) for d in lines])
    unique = [d for d, g in zip(lines, groups, strict=True) if d["doc_id"] == g]
    out = []
    for d in brute_mix(unique):
        ids = library.encode(d["text"], add_special_tokens=False).ids
        out.append((d["doc_id"], d["lang"], d["source"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return Counter(out)


def test_pipeline_equals_the_plain_stages(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    table = queries.documents(spark, SF)
    model = langid.train(table.filter(~langid.held_out()))
    want = brute_pipeline([r.asDict() for r in table.collect()], model, library)
    got = corpus_pipeline.run(spark, SF).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == want
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    rows = [
        (1, None, "en", "a", 0, "x"), (2, "", None, None, 0, None), (3, "12 34", "en", "a", 5, "x"), (None, "the cat sat on the mat today", "en", "a", 28, "x"),
        (4, "the cat sat on the mat today", "en", "b", 28, "x"), (5, "the cat sat on the mat today", "en", "b", 28, "x"), (6, "le chat est sur la table ici\nthe cat sat on the mat today", "fr", "b", 0, "x"),
        (6, "le chat est sur la table ici\nthe cat sat on the mat today", "fr", "b", 0, "x"),
    ]
    docs = spark.createDataFrame([r[:5] for r in rows], ", ".join(schema.split(", ")[:5]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.filter("false"), SF).count() == 0, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert {r["doc_id"] for r in docs.collect()} <= {4, 6, None}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    clashing = spark.createDataFrame(rows, schema).withColumn("kept_text", F.lit("k")).withColumn("fp", F.lit(1)).withColumn("size", F.lit("s"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clashing, SF).columns == clashing.columns, name
        stage(spark, clashing, SF).collect()


def test_near_dedup_finds_texts_of_high_resemblance(spark):
    rng = np.random.default_rng(3)
    rows, pairs = [], []
    for i in range(300):
        one = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(100, 600)))]
        other = list(one)
        for at in rng.choice(len(one), max(1, int(len(one) * rng.uniform(0.002, 0.05))), replace=False):
            other[at] = f"n{rng.integers(0, 5000)}"
        a, b = ({tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (one, other))
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(other))]
        pairs.append((2 * i + 1, len(a & b) / len(a | b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        mine = [i for i, r in pairs if low <= r < high]
        print(f"resemblance {low}-{high}: {sum(i not in kept for i in mine)} of {len(mine)} found")
    assert sum(0.8 <= r < 0.95 for _, r in pairs) > 50
    assert not [i for i, r in pairs if r >= 0.8 and i in kept]
    assert all(2 * i in kept for i in range(300))


def test_resemblance_links_equal_an_exact_comparison_and_copies_meet_once(spark, monkeypatch):
    r = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    base = [r.choice(words, 80).tolist() for _ in range(6)]
    texts = [" ".join(base[0])] * 120 + [" ".join(base[1]).upper() if i % 2 else " ".join(base[1]) for i in range(40)]
    for i in range(40):
        near = list(base[i % 6])
        near[int(r.integers(80))] = f"x{i}"
        texts.append(" ".join(near))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [set(x.tolist()) for x in resemblance.shingle_sets(texts)]
    node = list(range(len(texts)))

    def find(x):
        while node[x] != x:
            x = node[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                node[max(find(i), find(j))] = min(find(i), find(j))
    for held in (100_000, 200):
        monkeypatch.setattr(resemblance, "HELD", held)
        found = resemblance.links(docs)
        labels = {x["node"]: x["label"] for x in connected_components(found).collect()}
        assert [labels.get(i, i) for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    rows = resemblance.candidates(docs).filter("sure").count()
    assert rows < 2 * len(texts)


def test_near_dedup_finds_each_near_copy_of_a_text_that_many_resemble(spark):
    r = np.random.default_rng(21)
    base = [f"w{x}" for x in r.integers(0, 100_000, 300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 241):
        near = list(base)
        for at in range(25 + i % 13, 300, 50):  # six words apart: 0.816 of the shingles of the text, 0.66 or so of those of another copy
            near[at + int(r.integers(12))] = f"n{i}x{at}"
        rows.append((i, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {0}


def test_remaining_links_are_all_links_between_labels(spark, monkeypatch):
    r = np.random.default_rng(4)
    texts = []
    for size in (6, 9, 14, 40, 80, 200):
        base = [f"w{x}" for x in r.integers(0, 400, size)]
        for _ in range(25):
            near = list(base)
            for at in r.integers(0, size, int(r.integers(0, 2 + size // 50))):
                near[at] = f"w{r.integers(0, 400)}"
            texts.append(" ".join(near[: size - int(r.integers(0, 2 + size // 20))]))
    texts = sorted(set(texts))
    sets = [set(x.tolist()) for x in resemblance.shingle_sets(texts)]
    label = [i % 3 if i % 4 else i for i in range(len(sets))]
    want = {(j, i) for i, a in enumerate(sets) for j in range(i) if label[i] != label[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) and a != sets[j]}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, x) for i, x in enumerate(label) if i != x], "node long, label long")
    for many in (1 << 20, 50):
        monkeypatch.setattr(resemblance, "MANY", many)
        got = {(x["src"], x["dst"]) for x in resemblance.remaining(docs, labels).collect()}
        assert {(a, b) for a, b in got if sets[a] != sets[b]} == want and len(want) > 100
    none = resemblance.remaining(docs.filter("false"), labels.filter("false"))
    assert none.count() == 0
