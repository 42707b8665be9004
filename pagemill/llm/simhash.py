"""SimHash near-duplicates: deletion-variant signatures, equality-join and verification.

Two 64-bit fingerprints that differ in at most `distance` bits, cut into
`distance // 2 + 1` segments, agree in some segment up to one bit: were every
segment at two bits or more, they would differ in more than `distance`. So each
distinct fingerprint is indexed under every variant of each segment with one
bit masked out; equal (segment, masked bit, rest) keys bring all candidates
together, and the full Hamming distance verifies them. Within a key only a
spanning forest of the verified links is passed on, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_split, partitions, small_batches
from .components import connected_components

SHINGLE, DISTANCE, SEED = 4, 4, 42


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles (see fingerprints())."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), dtype=np.int64, count=len(words)) - 1).tolist()
    n = max(1, len(words) - width + 1)
    last = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[a:b], SEED) for a, b in zip(starts[:n], last, strict=False)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        counts += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row: fp is the text's SimHash as a signed 64-bit integer.

    A-Z are lowered, words are runs without ASCII white space, shingles are
    `width` words (fewer words: the whole sequence) and count as often as they
    occur. A null, empty or blank text has fingerprint 0. Rows that repeat stay.
    """

    def run(batches):
        for b in batches:
            out = np.array([simhash(x.as_py(), width) for x in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, fp long")


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(first bit, bits) of each of distance // 2 + 1 near-equal segments of 64 bits."""
    n = distance // 2 + 1
    at = [round(i * 64 / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def variant_keys(fps: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """64 keys for each uint64 fingerprint: masked bit number << 32 | the rest of its segment."""
    keys = []
    for first, bits in segments(distance):
        value = (fps >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        for i in range(bits):
            keys.append((value & ~np.uint64(1 << i)) | np.uint64((first + i) << 32))
    return np.stack(keys, axis=1)


def spanning_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of fingerprints within `distance` bits of each other."""
    links, left = [], fps
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                links += [(x, y) for y in found]
                stack += list(found)
                left = left[~near]
    return links


def linked(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys (sorted). Runs of two at once, longer ones by spanning_links()."""
    change = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(change, len(keys)))
    two = change[sizes == 2]
    near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance
    a, b = [fps[two][near]], [fps[two + 1][near]]
    for i, n in zip(change[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        if links := spanning_links(fps[i : i + n], distance):
            x, y = zip(*links, strict=True)
            a.append(np.array(x, dtype=np.uint64))
            b.append(np.array(y, dtype=np.uint64))
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(src, dst) links that connect whatever fingerprints (fp long, distinct) lie within `distance` bits."""

    def expand(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 4096):
                part = fps[i : i + 4096]
                keys = variant_keys(part, distance)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part, keys.shape[1]).view(np.int64))], names=["key", "fp"])

    def join(batches):
        held_k = held_f = np.zeros(0, dtype=np.uint64)

        def out(k, f):
            x, y = linked(k, f, distance)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["src", "dst"])

        for b in batches:
            if not b.num_rows:
                continue
            k = np.concatenate((held_k, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            f = np.concatenate((held_f, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            ready = np.searchsorted(k.view(np.int64), k.view(np.int64)[-1], side="left")  # the last key may go on in the next batch
            if ready:
                yield out(k[:ready], f[:ready])
            held_k, held_f = k[ready:], f[ready:]
        if len(held_k):
            yield out(held_k, held_f)

    n = partitions(distinct.sparkSession)
    # 64 keys each: dealt out again, as what is left after grouping may have been put into a few tasks
    keyed = distinct.select("fp").repartition(n, "fp").mapInArrow(expand, "key long, fp long")
    found = keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(join, "src long, dst long")
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def marked_links(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, fp) of every row; (fp, first_id, rows) of the distinct fingerprints; (src, dst), the links of these."""
    marked = cut(fingerprints(docs, width))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")))
    return marked, distinct, cut(links(distinct, distance))


def document_links(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> DataFrame:
    """(src, dst) doc_ids whose components are those of near_duplicates(); rows without doc_id give none."""
    marked, distinct, found = marked_links(docs.filter(F.col("doc_id").isNotNull()), distance, width)
    first = distinct.select("fp", "first_id")
    one, other = (first.select(F.col("fp").alias(c), F.col("first_id").alias(f"{c}_id")) for c in ("src", "dst"))
    between = found.join(one, "src").join(other, "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    within = join_split(marked, distinct, ["fp"], "rows", marked.count()).filter("doc_id <> first_id")
    return between.unionByName(within.select(F.col("first_id").alias("src"), F.col("doc_id").alias("dst")))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text).

    component_id is the smallest doc_id that can be reached over links of at
    most `distance` differing bits, the row's own included. Rows without doc_id
    stay and share their component (null if it has no doc_id at all). Repeated
    rows stay; an empty table gives an empty result; other columns play no part.
    """
    marked, distinct, found = marked_links(docs, distance, width)
    labels = connected_components(found)
    of_fp = cut(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    smallest = of_fp.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("size"))
    # a large component, and a fingerprint of many rows, are dealt over several tasks
    members = join_split(of_fp.select("fp", "rows", "label"), smallest, ["label"], "size", of_fp.count()).select("fp", "rows", "component_id")
    out = join_split(marked, members, ["fp"], "rows", marked.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
