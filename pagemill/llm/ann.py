"""Approximate nearest neighbours by a permutation index.

Each vector is represented by the order in which it sees a fixed set of
pivots, nearest first, and posted in the inverted files of its nearest pivots.
The files are one table keyed by pivot; a file of many entries is cut into
blocks by a hash of vec_id. A query is joined to the files of its own nearest
pivots only. There it ranks the entries by the footrule distance between
the permutations (the sum of the differences of the pivots' ranks), and the best
of them, with all whose permutation is nearly its own, are reranked by the true
distance. An entry that several of the probed files hold is met in the one of them
that is the entry's nearest pivot.

What is shuffled is every vector as often as it is posted, and every query as
often as it probes a block of a file. A task holds one block at a time, and queries are
streamed past it. Equal vectors of a block are one entry with all their ids, so
that a very common vector takes one place of a query's shortlist.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, partitions

#: The pivots, the files that a vector is posted to and that a query probes, and the entries of a block.
PIVOTS, POSTED, PROBED, BLOCK = 128, 6, 28, 65_536
#: Of each block that a query probes, this share is reranked, LEAST at least. By block, as a crowd of nearly equal
#: vectors, which are all in the same files, would else fill the shortlist.
RERANK, LEAST = 0.2, 64
#: And all entries that a query's permutation differs from by this share of the pivots' squared number at most (chance: a third):
#: the permutations of nearly equal vectors don't tell which is nearest.
CLOSE = 1 / 16
#: The pivots are drawn from this many vectors, those with the smallest hashes of vec_id.
SAMPLE = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>), one row for each vec_id, of the vectors that take part.

    Vectors that are null, empty or all zero or that hold null, NaN or infinite
    components don't, nor do rows without vec_id. Of rows with the same vec_id
    the smallest array counts. Of vectors of different lengths the most
    frequent length counts (ties: the smaller).
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(finite & F.exists(v, lambda x: x != 0))
    one = kept.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(v.cast("array<double>")).alias("embedding"))
    lengths = one.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return one.filter(F.size("embedding") == (lengths["n"] if lengths else 0))


def matrix(column, n: int) -> np.ndarray:
    """An Arrow column of n lists of equal length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Vectors of a bounded sample that lie apart: the one of the smallest hash, then always the farthest from those chosen.

    So a crowd of nearly equal vectors gets one pivot or few, however many of the rows it has.
    """
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    x = np.array(list(dict.fromkeys(tuple(r["embedding"]) for r in rows)), dtype=np.float64)
    chosen, away = [0] if len(x) else [], np.full(len(x), np.inf)
    while 0 < len(chosen) < min(pivots, len(x)):
        d = x - x[chosen[-1]]
        away = np.minimum(away, (d * d).sum(axis=1))
        away[chosen] = -1
        chosen.append(int(away.argmax()))
    return x[chosen]


def ranks_of(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector its pivots from near to far, and each pivot's rank."""
    d = ((x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T) + (pivots * pivots).sum(axis=1)[None, :]
    order = np.argsort(d, axis=1, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(len(pivots))[None, :], axis=1)
    return order, ranks.astype(np.uint16)


def cells(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = x.itemsize * x.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).data if x.size else b"")]).cast(pa.binary())


def rows_of(column: pa.Array, dtype, width: int) -> np.ndarray:
    """cells() undone."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width)


def permuted(vectors: DataFrame, pivots: np.ndarray, near: int, dtype: str) -> DataFrame:
    """(vec_id, vector, ranks, near): each vector, its permutation as ranks, and its nearest pivots, nearest first."""

    def run(batches):
        for b in batches:
            x = matrix(b.column(1), b.num_rows)
            if not len(x):
                continue
            order, ranks = ranks_of(x, pivots)
            files = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * near, pa.int32()), pa.array(order[:, :near].reshape(-1), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), cells(x.astype(dtype)), cells(ranks), files], names=["vec_id", "vector", "ranks", "near"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, vector binary, ranks binary, near array<int>")


class Block:
    """A block of one pivot's file: its distinct vectors with their permutations, and the ids of each, ascending."""

    def __init__(self, pivot: int, ids: np.ndarray, x: np.ndarray, ranks: np.ndarray, posted: int) -> None:
        _, one, which = np.unique(x, axis=0, return_index=True, return_inverse=True)
        which = which.reshape(-1)
        by = np.lexsort((ids, which))
        self.ids, self.first = ids[by], np.searchsorted(which[by], np.arange(len(one) + 1))
        self.x, self.ranks = x[one].astype(np.float64), ranks[one].astype(np.int16)
        files = np.argsort(self.ranks, axis=1, kind="stable")[:, :posted]
        # the files before this one in which a query may have met the entry; the number of pivots stands for none
        self.before = np.where(np.arange(files.shape[1])[None, :] < self.ranks[:, pivot][:, None], files, ranks.shape[1])

    def search(self, own: int, q: np.ndarray, q_ranks: np.ndarray, k: int, probed: int, rerank: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of the entries that are the query's to meet here: ids and distances."""
        mine = np.append(q_ranks < probed, False)
        rows = np.flatnonzero(~mine[self.before].any(axis=1))
        footrule = np.abs(self.ranks[rows] - q_ranks).sum(axis=1, dtype=np.int32)
        n = max(least, int(np.ceil(rerank * len(rows))))
        if n < len(rows):
            found = footrule <= CLOSE * len(q_ranks) ** 2
            found[np.argsort(footrule, kind="stable")[:n]] = True
            rows = rows[found]
        d = self.x[rows] - q
        d = np.sqrt((d * d).sum(axis=1))
        n = np.minimum(np.diff(self.first)[rows], k + 1)  # of equal vectors no more than the k first and the query itself can count
        ids = self.ids[np.repeat(self.first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        d, other = np.repeat(d, n), ids != own
        ids, d = ids[other], d[other]
        best = np.lexsort((ids, d))[:k]
        return ids[best], d[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, posted: int = POSTED, probed: int = PROBED, rerank: float = RERANK, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id, embedding) the k nearest vectors that the index finds.

    Nearness is the Euclidean distance in double precision; ties go to the
    smaller vec_id; a query's own vec_id is no candidate. Rows that usable()
    leaves out are neither queries nor candidates. An empty table, and queries
    without any candidate, give no rows. Other columns play no part.
    """
    spark = vectors.sparkSession
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    dtype = "<f4" if single else "<f8"  # as the vectors came
    base = cut(usable(vectors.select("vec_id", "embedding")))
    chosen = choose_pivots(base, pivots)
    if not len(chosen):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n, posted, probed = chosen.shape[1], len(chosen), min(posted, len(chosen)), min(probed, len(chosen))
    entries = cut(permuted(base, chosen, posted, dtype))
    sizes = {r["pivot"]: r["count"] for r in entries.select(F.explode("near").alias("pivot")).groupBy("pivot").count().collect()}  # a row for each pivot
    blocks = F.get(F.array(*(F.lit(-(-sizes.get(p, 0) // block)) for p in range(n))), "pivot")
    ask = permuted(usable(queries.select("vec_id", "embedding")).filter(F.size("embedding") == width), chosen, probed, "<f8")

    listed = entries.select("vec_id", "vector", "ranks", F.explode("near").alias("pivot"))
    listed = listed.select("pivot", F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block"), F.lit(0).alias("tag"), "vec_id", "vector", "ranks")
    asked = ask.select("vec_id", "vector", "ranks", F.explode("near").alias("pivot")).filter(blocks > 0)
    asked = asked.select("pivot", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("tag"), "vec_id", "vector", "ranks")
    stream = listed.unionByName(asked).repartition(partitions(spark), "pivot", "block").sortWithinPartitions("pivot", "block", "tag")

    def run(batches):
        at, waiting, held = None, [], None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in (0, 1, 2)], axis=1)
            edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True]))) if len(keys) else []
            for lo, hi in zip(edges, edges[1:], strict=False):
                pivot, number, tag = keys[lo].tolist()
                part = b.slice(lo, hi - lo)
                ids, ranks = part.column(3).to_numpy(), rows_of(part.column(5), "<u2", n)
                if at != (pivot, number):
                    at, waiting, held = (pivot, number), [], None
                if tag == 0:
                    waiting.append((ids, rows_of(part.column(4), dtype, width), ranks))
                    continue
                if held is None:
                    held = Block(pivot, *(np.concatenate(x) for x in zip(*waiting, strict=True)), posted)
                    waiting = []
                found = [(own, *held.search(own, q, r, k, probed, rerank, least)) for own, q, r in zip(ids.tolist(), rows_of(part.column(4), "<f8", width), ranks.astype(np.int16), strict=True)]
                own = np.concatenate([np.full(len(v), i, dtype=np.int64) for i, v, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate([v for _, v, _ in found])), pa.array(np.concatenate([x for _, _, x in found]))], names=["query_id", "vec_id", "score"])

    found = stream.mapInArrow(run, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
