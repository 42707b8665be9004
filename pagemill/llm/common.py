"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of at most this many bytes (or one text).
SLICE_BYTES = 4 << 20

#: `[\x20\x09-\x0D]` as a lookup by byte, and A-Z lowered by byte.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's; where none is set, a temporary one, if all runs on one machine (tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagemill-"))
    return sc.getCheckpointDir()


#: Arrow batches of texts are no larger than this. Spark's own limit, 64 MB, would be held by the JVM and the worker of each core at once.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's limit on the bytes of an Arrow batch lowered to BATCH_BYTES, if it is higher."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(key, "64MB")).lower()
    if not now.removesuffix("b").isdigit() or int(now.removesuffix("b")) < 0 or int(now.removesuffix("b")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that a lost executor loses nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, to be broadcast if it has no more rows than that (counting stops there), else joined by a shuffled hash."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("shuffle_hash")


def join_split(left: DataFrame, right: DataFrame, on: list[str], load: str, total: int, least: int = 1_000) -> DataFrame:
    """left joined with right, which has one row for each key; a key with many rows of left is dealt over several tasks.

    right's column `load` tells how many rows of left have the key (about), total
    how many there are. A key is split if it has more than its share of a
    partition (and more than least), so no more keys are split than there are partitions:
    these are broadcast, and right's row is repeated for each part.
    """
    if total <= least:  # no key can have more
        return left.join(right.drop(load), on)
    most = max(least, total // partitions(left.sparkSession))
    parts, part = fresh([*left.columns, *right.columns], "_parts", "_part")
    heavy = F.broadcast(right.filter(F.col(load) > most).select(*on, F.ceil(F.col(load) / most).cast("int").alias(parts)))
    n = F.coalesce(parts, F.lit(1))
    one = left.join(heavy, on, "left").withColumn(part, F.pmod(F.xxhash64(*left.columns), n).cast("int")).drop(parts)
    other = right.drop(load).join(heavy, on, "left").withColumn(part, F.explode(F.sequence(F.lit(0), n - 1))).drop(parts)
    return one.join(other, [*on, part]).drop(part)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def in_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts together stay within the limit, or that hold one text beyond it."""
    texts = batch.column(column)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else []
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1)
        end = min(end, len(texts))
        yield batch.slice(begin, end - begin)
        begin = end


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until none of them is a column's."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def widened(df: DataFrame, names: list[str], *types: str) -> str:
    """The schema of df with more columns."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` {t}" for n, t in zip(names, types, strict=True)])


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n - 1, mod 2^64."""
    x = np.full(n, BASE, dtype=np.uint64)
    x[:1] = 1
    return np.multiply.accumulate(x)


#: For the words of common length; longer ones get powers of their own, which aren't kept.
POWERS = powers(1 << 12)


#: Bytes whose spans are hashed at once: a byte takes some 50 bytes meanwhile.
HASHED = 1 << 20


def span_hashes(data: np.ndarray, table: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of table[data[s:e]] for each span: a polynomial mod 2^64, then mixed. Spans hold a byte at least, ascend and don't overlap."""
    out = np.zeros(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + HASHED, side="right")))
        lo, hi = int(starts[first]), int(ends[last - 1])
        begin, lengths = starts[first:last] - lo, ends[first:last] - starts[first:last]
        inside = np.zeros(hi - lo + 1, dtype=np.int8)
        inside[begin] += 1
        inside[begin + lengths] -= 1
        terms = table[data[lo:hi][np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]]
        offsets = np.cumsum(lengths) - lengths
        most = int(lengths.max())
        terms *= (POWERS if most <= len(POWERS) else powers(most))[np.arange(len(terms)) - np.repeat(offsets, lengths)]
        out[first:last] = mix64(np.add.reduceat(terms, offsets) + lengths.astype(np.uint64))
        first = last
    return out
