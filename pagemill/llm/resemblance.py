"""Near-copies by the exact resemblance of word shingles: banded min-hashes, a chain in each bucket, verification.

Each distinct set of shingles gets BANDS keys of ROWS min-hashes; sets of
resemblance r share one with probability 1 - (1 - r^ROWS)^BANDS, which is
0.9997 at 0.8. Sets of the same key are chained, in an order of the band's own,
so that a key's candidates are as many as its sets. Each pair is verified once, by
the resemblance of the whole sets.

A chain compares neighbours only, and a pair may share no key. So what the chains
leave apart is joined exactly by remaining(): a prefix join. With the shingles in one
order for all sets, two sets of resemblance r have their first common shingle
within the first (1 - r) of either (and one more). The order is by how often
a shingle occurs, rarest first, so that few sets meet; any order gives the same links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, if_small, in_slices, mix64, partitions, small_batches
from .fingerprints import sketches

WIDTH, LEAST, BANDS, ROWS = 5, 0.8, 20, 5
#: A random value for each min-hash.
SALTS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
#: Texts are worked on in slices of at most this many bytes (or one text): the workers stay beside those of other stages.
SLICE = 1 << 18
#: Rows of keys that a task chains at once before it passes on what is left of them.
HELD = 100_000
#: More hashes than any text has shingles: nothing is left out.
ALL = 1 << 40
#: Shingles are counted in 2^CELLS cells, by the first bits of their hashes, in chunks of 2^CHUNK cells.
CELLS, CHUNK = 20, 14
#: Cells, or pairs, that are held before they are added up, or passed on.
MANY = 1 << 20


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    return sketches([(t or "").encode("utf-8", "replace") for t in texts], ALL, width)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set that isn't empty."""
    least = np.full(len(SALTS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 1024):
        x = (SALTS[:, None] ^ shingles[None, i : i + 1024]) * np.uint64(0x9E3779B97F4A7C15)  # the hashes are mixed already
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1))
    bands = mix64(least).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, j])
    return keys


def chained(keys: np.ndarray, docs: np.ndarray, sets: np.ndarray, whole: np.ndarray):
    """Links between neighbours of the same key, rows being sorted by key and set: (doc, doc, whether of one set); and each key's first row.

    Rows with the same set are one in a band's chain; they are linked by the key of the whole set only.
    """
    same_key = keys[1:] == keys[:-1]
    same_set = same_key & (sets[1:] == sets[:-1])
    sure = np.flatnonzero(same_set & whole[1:])
    first = np.flatnonzero(np.concatenate(([True], ~same_set)))
    near = np.flatnonzero(keys[first[1:]] == keys[first[:-1]])
    one, other = np.concatenate((sure, first[:-1][near])), np.concatenate((sure + 1, first[1:][near]))
    heads = first[np.concatenate(([True], keys[first[1:]] != keys[first[:-1]]))]
    return docs[one], docs[other], np.arange(len(one)) < len(sure), heads


def candidates(docs: DataFrame) -> DataFrame:
    """(src, dst, sure): links of the chains; sure ones are of the same set.

    Each task chains its own rows first and passes on one row of each key, and so
    many rows of one key, as of a large group of copies, aren't brought together.
    """
    names = ["key", "doc_id", "sure", "dst"]

    def expand(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            keys, ids, sets, whole = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            by = np.lexsort((ids, mix64(sets ^ keys), keys))
            keys, ids, sets, whole = keys[by], ids[by], sets[by], whole[by]
            src, dst, sure, heads = chained(keys, ids, sets, whole)
            linked = mix64(src.view(np.uint64) ^ mix64(dst.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(linked.view(np.int64)), pa.array(src), pa.array(sure), pa.array(dst)], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(keys[heads].view(np.int64)), pa.array(ids[heads]), pa.array(whole[heads]), pa.nulls(len(heads), pa.int64())], names=names)

        rows = 0
        for batch in batches:
            for b in in_slices(batch, 1, SLICE):
                for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist()), strict=True):
                    if len(s):
                        whole = np.uint64(xxhash.xxh64_intdigest(s.tobytes()))
                        # a key of the whole set besides, by which copies meet
                        held.append((np.append(band_keys(s), mix64(np.array([whole]))), np.full(BANDS + 1, i, dtype=np.int64), np.full(BANDS + 1, whole), np.arange(BANDS + 1) == BANDS))
                        rows += BANDS + 1
                if rows > HELD:
                    yield from flush()
                    rows = 0
        if held:
            yield from flush()

    def chain(batches):
        key = last = None
        for b in batches:
            link = b.column(3).is_valid()
            yield pa.RecordBatch.from_arrays([b.column(i).filter(link) for i in (1, 3, 2)], names=["src", "dst", "sure"])
            rows = b.filter(pc.invert(link))
            if not rows.num_rows:
                continue
            k, d, sure = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if key is not None:
                k, d, sure = np.concatenate(([key], k)), np.concatenate(([last], d)), np.concatenate(([False], sure))
            same = k[1:] == k[:-1]
            key, last = k[-1], d[-1]
            yield pa.RecordBatch.from_arrays([pa.array(d[:-1][same]), pa.array(d[1:][same]), pa.array(sure[1:][same])], names=["src", "dst", "sure"])

    keyed = small_batches(docs.select("doc_id", "text")).mapInArrow(expand, "key long, doc_id long, sure boolean, dst long")
    # another order in each band
    sorted_ = keyed.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key", F.xxhash64("doc_id", "key"))
    return sorted_.mapInArrow(chain, "src long, dst long, sure boolean").filter("src <> dst")


def verified(docs: DataFrame, pairs: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (src, dst) of doc_ids whose texts share `least` or more of their shingles."""

    def verify(batches):
        for batch in batches:
            for b in in_slices(batch, 2, SLICE):
                ones, others = shingle_sets(b.column(2).to_pylist()), shingle_sets(b.column(3).to_pylist())
                both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(ones, others, strict=True)]
                good = pa.array([n >= least * (len(x) + len(y) - n) for n, x, y in zip(both, ones, others, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], names=["src", "dst"])

    ends = pairs.select(F.col("src").alias("doc_id")).union(pairs.select(F.col("dst").alias("doc_id"))).distinct()
    texts = cut(docs.join(if_small(cut(ends)), "doc_id", "left_semi"))
    one = texts.select(F.col("doc_id").alias("src"), F.col("text").alias("one"))
    other = texts.select(F.col("doc_id").alias("dst"), F.col("text").alias("other"))
    return pairs.join(one, "src").join(other, "dst").select("src", "dst", "one", "other").mapInArrow(verify, "src long, dst long")


def links(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(src, dst) doc_ids of verified candidates, and of rows with the same set; docs is (doc_id, text), without null doc_ids."""
    ordered = candidates(docs).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "sure")
    found = cut(ordered.groupBy("src", "dst").agg(F.bool_or("sure").alias("sure")))
    same, pairs = found.filter("sure").select("src", "dst"), found.filter("NOT sure").select("src", "dst")
    return verified(docs, pairs, least).unionByName(same)


def cell_counts(docs: DataFrame) -> np.ndarray:
    """How many shingles, counted once a text, each cell has; 65535 stands for all from there on."""
    size = 1 << CHUNK

    def count(batches):
        total, held, rows = np.zeros(1 << CELLS, dtype=np.int64), [], 0
        for batch in batches:
            for b in in_slices(batch, 0, SLICE):
                for s in shingle_sets(b.column(0).to_pylist()):
                    held.append((s >> np.uint64(64 - CELLS)).astype(np.int32))
                    rows += len(s)
                if rows > MANY:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, rows = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        parts = np.minimum(total, 65535).astype("<u2").reshape(-1, size)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["chunk", "counts"])

    def add(batches):
        chunk, total = None, np.zeros(size, dtype=np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.minimum(total, 65535).astype("<u2").tobytes()], pa.binary())], names=["chunk", "counts"])

        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if chunk is not None and c != chunk:
                    yield out()
                    total[:] = 0
                chunk = c
                total += np.frombuffer(x, dtype="<u2")
        if chunk is not None:
            yield out()

    kind = "chunk int, counts binary"
    parts = small_batches(docs.select("text")).mapInArrow(count, kind)
    table = np.zeros((1 << (CELLS - CHUNK), size), dtype=np.uint16)
    for r in parts.repartition(partitions(docs.sparkSession), "chunk").sortWithinPartitions("chunk").mapInArrow(add, kind).collect():  # 2 MB at most
        table[r["chunk"]] = np.frombuffer(r["counts"], dtype="<u2")
    return table.reshape(-1)


def prefix(shingles: np.ndarray, counts: np.ndarray, least: float = LEAST) -> np.ndarray:
    """The first shingles of a sorted set, by the counts of their cells and then by hash: any set of resemblance `least` has one of them."""
    n = len(shingles) - int(np.ceil(least * len(shingles) - 1e-6)) + 1
    return shingles[np.argsort(counts[(shingles >> np.uint64(64 - CELLS)).astype(np.int64)], kind="stable")[:n]]


def apart(keys: np.ndarray, docs: np.ndarray, labels: np.ndarray, at: np.ndarray, least: float = LEAST):
    """Pairs of rows of the same key (sorted) and of different labels that may reach `least`, a batch at a time.

    at is the set's size << 32 | the key's place in its order. At the first common
    shingle as many are known to differ as come before it, and no more can be common than are left.
    """
    by = np.lexsort((labels, keys))
    keys, docs, labels, at = keys[by], docs[by], labels[by], at[by]
    size, place = at >> 32, at & 0xFFFFFFFF
    new_key = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    new_label = np.union1d(new_key, np.flatnonzero(labels[1:] != labels[:-1]) + 1)
    rows = np.arange(len(keys))
    last = lambda new: np.append(new, len(keys))[np.searchsorted(new, rows, side="right")]
    end, other = last(new_key), last(new_label)
    held, n = [], 0
    active = np.flatnonzero(other < end)
    while len(active):
        i, j = active, other[active]
        both = size[i] + size[j]
        may = ((place[i] + place[j]) * (1 + least) <= (1 - least) * both + 1e-6) & (np.minimum(size[i] - place[i], size[j] - place[j]) * (1 + least) >= least * both - 1e-6)
        i, j = docs[i[may]], docs[j[may]]
        held.append(np.stack((np.minimum(i, j), np.maximum(i, j))))
        n += len(i)
        if n > MANY:
            yield np.unique(np.concatenate(held, axis=1), axis=1)
            held, n = [], 0
        other[active] += 1
        active = active[other[active] < end[active]]
    if n:
        yield np.unique(np.concatenate(held, axis=1), axis=1)


def remaining(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """(src, dst) doc_ids of all pairs that share `least` or more of their shingles and have different labels (node, label).

    Nodes without a row are their own label; rows with the same set count as linked.
    """
    counts = cell_counts(docs)

    def expand(batches):
        seen = set()  # of copies one stands for all of the task
        for batch in batches:
            for b in in_slices(batch, 1, SLICE):
                out = []
                for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist()), strict=True):
                    whole = xxhash.xxh64_intdigest(s.tobytes())
                    if len(s) and whole not in seen:
                        seen.add(whole)
                        first = prefix(s, counts, least)
                        out.append((first, np.full(len(first), i, dtype=np.int64), np.arange(len(first), dtype=np.int64) | (len(s) << 32)))
                if out:
                    keys, ids, at = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids), pa.array(at)], names=["key", "node", "at"])

    def meet(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            key, node, at = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            rows = np.stack((key, node, pc.coalesce(b.column(3), b.column(1)).to_numpy(zero_copy_only=False), at))
            rows = rows if held is None else np.concatenate((held, rows), axis=1)
            ready = int(np.searchsorted(rows[0], rows[0, -1], side="left"))  # the last key may go on in the next batch
            held = rows[:, ready:]
            for x in apart(*rows[:, :ready], least) if ready else ():
                yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["src", "dst"])
        if held is not None:
            for x in apart(*held, least):
                yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["src", "dst"])

    rows = small_batches(docs.select("doc_id", "text")).mapInArrow(expand, "key long, node long, at long")
    labelled = rows.join(if_small(labels), "node", "left").select("key", "node", "at", "label")
    sorted_ = labelled.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key")
    return verified(docs, cut(sorted_.mapInArrow(meet, "src long, dst long").distinct()), least)
