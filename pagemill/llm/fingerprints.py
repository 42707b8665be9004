"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a text's shingles, sorted.
Sketches of parts merge into the sketch of the whole (the k smallest of their
union), and estimate resemblance, containment and the number of distinct
shingles; where a text has fewer than k of them the values are exact.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, in_slices, mix64, partitions, small_batches, span_hashes

K, SHINGLE = 128, 5
SEED = np.uint64(0x5BF0_3635_D1F2_6A9B)
#: A random value for each byte, and an odd factor for each place in a shingle.
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def place_factors(width: int) -> np.ndarray:
    return mix64(np.arange(1, width + 1, dtype=np.uint64) ^ SEED) | np.uint64(1)


def sketches(texts: list[bytes], k: int = K, width: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text: A-Z lowered, words are runs without ASCII white space.

    A text of fewer than `width` words has one shingle, all its words; a text
    without words has none.
    """
    if not texts:
        return []
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    word = ~IS_SPACE[raw]
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_end = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    upto = np.searchsorted(starts, text_end)  # words before the end of each text
    h = span_hashes(raw, BYTE[LOWER], starts, ends)
    factors = place_factors(width)
    shingle = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
    for i in range(width):
        shingle += h[i : len(h) - width + 1 + i] * factors[i]
    shingle = mix64(shingle)
    out, begin = [], 0
    for end in upto.tolist():
        n = end - begin
        if n >= width:
            mine = shingle[begin : end - width + 1]
        elif n:
            mine = mix64((h[begin:end] * factors[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            mine = shingle[:0]
        if len(mine) > 4 * k:  # far fewer are sorted; repeats may leave too few
            few = np.unique(np.partition(mine, 2 * k)[: 2 * k])
            mine = few if len(few) >= k else mine
        out.append(np.unique(mine)[:k])
        begin = end
    return out


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, dtype=np.uint64)


def _seen(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int, int]:
    """How many hashes of a, of b and of both lie in the range that both sketches show in full."""
    full = [x[-1] for x in (a, b) if len(x) >= k]
    if full:
        bound = min(full)
        a, b = a[: np.searchsorted(a, bound, side="right")], b[: np.searchsorted(b, bound, side="right")]
    both = np.concatenate((a, b))
    both.sort()
    return len(a), len(b), int((both[1:] == both[:-1]).sum())


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the union's shingles that both have; 1 for two sketches without any."""
    n, m, both = _seen(a, b, k)
    return both / (n + m - both) if n + m else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an a without any."""
    n, _, both = _seen(a, b, k)
    return both / n if n else 1.0


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def to_string(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_string(x: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(x), dtype="<u8")


def edited(text: str, other: str) -> str:
    """text with its last quarter (rounded down) of code points replaced by as many of the other's first, or all of them."""
    n = len(text) // 4
    return text[: len(text) - n] + other[:n]


def fingerprint_documents(docs: DataFrame, k: int = K, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint) of every row of docs (doc_id, text); null texts count as empty."""

    def run(batches):
        for whole in batches:
            for b in in_slices(whole, 1):
                out = [to_string(x) for x in sketches([(x.as_py() or "").encode() for x in b.column(1)], k, width)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, fingerprint string")


def merge_fingerprints(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """(key, fingerprint): the fingerprints of each key's parts merged; first within each partition, so hot keys stay small."""

    def merged(rows) -> tuple[list, list]:
        found: dict = {}
        for name, x in rows:
            a = from_string(x)
            found[name] = merge([found[name], a], k) if name in found else a
        return list(found), [to_string(x) for x in found.values()]

    def run(batches):
        for b in batches:
            names, prints = merged(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(names, b.column(0).type), pa.array(prints, pa.string())], names=[key, "fingerprint"])

    def last(table: pa.Table) -> pa.Table:
        names, prints = merged(zip(table[key].to_pylist(), table["fingerprint"].to_pylist(), strict=True))
        return pa.table({key: pa.array(names, table[key].type), "fingerprint": prints})

    kind = parts.schema[key].dataType.simpleString()
    return parts.select(key, "fingerprint").mapInArrow(run, f"`{key}` {kind}, fingerprint string").groupBy(key).applyInArrow(last, f"`{key}` {kind}, fingerprint string")


def _bounds(docs: DataFrame, ranges: int) -> np.ndarray:
    """The doc_ids at which the ranges begin; at most `ranges` numbers reach the driver."""
    found = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(ranges)], 10 * ranges).alias("x")).first()["x"]
    return np.unique(np.array(found or [], dtype=np.int64))


def fingerprint_edits(docs: DataFrame, k: int = K, width: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter comes from the next document.

    Documents follow one another by ascending doc_id, rows of the same doc_id by
    text, rows without doc_id first; the first follows the last. A null text
    counts as empty. One row for each row of docs (doc_id, text): doc_id, n_chars
    (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited
    and near_next (resemblance to the edited and to the next text), n_shingles
    (estimated number of distinct shingles). An empty table gives no rows; a
    single document follows itself. Other columns play no part.

    The texts are dealt out once, by ranges of doc_id; the first row of each
    range also goes to the range before it, as that range's last follower.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(docs.sparkSession)
    bounds = _bounds(docs, min(4 * n, 10_000))

    def number(batches):
        """The range of each doc_id: 0 for none, else the number of bounds that it has reached."""
        for b in batches:
            ids = b.column(0)
            at = np.searchsorted(bounds, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), ids], names=["part", "doc_id"])

    # the first doc_id of each range: no more rows than ranges reach the driver; a null doc_id comes before all
    firsts = {r["part"]: r["low"] for r in docs.select("doc_id").mapInArrow(number, "part int, doc_id long").groupBy("part").agg(F.min_by("doc_id", F.coalesce(F.col("doc_id"), F.lit(-(2**63)))).alias("low")).collect()}
    parts = sorted(firsts)
    before = {p: parts[i - 1] for i, p in enumerate(parts)}  # the first range follows the last

    def deal(batches):
        for b in batches:
            ids = b.column(0)
            at = np.searchsorted(bounds, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.zeros(len(at), dtype=np.int8)), *b.columns], names=["part", "halo", "doc_id", "text"])
            lead = [i for i, (p, x) in enumerate(zip(at.tolist(), ids.to_pylist(), strict=True)) if firsts[p] == x]
            if lead:
                yield pa.RecordBatch.from_arrays([pa.array([before[p] for p in at[lead].tolist()], pa.int32()), pa.array(np.ones(len(lead), dtype=np.int8)), *(c.take(pa.array(lead)) for c in b.columns)], names=["part", "halo", "doc_id", "text"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"
    names = [x.split()[0] for x in schema.split(", ")]

    def work(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows for all but the last, which is there as the follower."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        raw = [x.encode() for x in changed]
        own, new = sketches([x.encode() for x in texts], k, width), sketches(raw, k, width)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:-1], pa.int64()),
                pa.array([len(x) for x in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                pa.array([to_string(x) for x in own[:-1]], pa.string()),
                pa.array([to_string(x) for x in new], pa.string()),
                pa.array([resemblance(a, b, k) for a, b in zip(own, new, strict=False)], pa.float64()),
                pa.array([resemblance(a, b, k) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
                pa.array([distinct_count(a, k) for a in own[:-1]], pa.float64()),
            ],
            names=names,
        )

    def run(batches):
        part, halo, ids, texts = None, False, [], []
        for whole in batches:
            for b in in_slices(whole, 3):
                for p, h, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if p != part:
                        part, halo, ids, texts = p, False, [], []
                    if halo:
                        continue  # of rows of one doc_id only the first follows
                    ids.append(i)
                    texts.append(t)
                    halo = h == 1
                    if halo and len(ids) > 1:
                        yield work(ids, texts)
                        ids, texts = [], []
                if len(ids) > 1:
                    yield work(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]

    dealt = small_batches(docs).mapInArrow(deal, "part int, halo tinyint, doc_id long, text string")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "halo", "doc_id", "text").mapInArrow(run, schema)
