"""Vectors: providers of encodings, and cosine similarity of unit vectors.

A provider turns (key columns, text) into vectors. ColumnProvider takes vectors
that a table has; EncoderProvider calls a function once per Arrow batch, its
model made once per worker; None means keyword scores only.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    name: str

    def vectors(self, df: DataFrame) -> DataFrame:
        """df with a column vec array<float>, null where there is none."""


class ColumnProvider:
    """Vectors of a table (key, vec) for rows of the same key."""

    name = "column"

    def __init__(self, table: DataFrame, key: str) -> None:
        self.table, self.key = table, key

    def vectors(self, df: DataFrame) -> DataFrame:
        return df.join(self.table.select(self.key, "vec"), self.key, "left")


class EncoderProvider:
    """Vectors from make()(list of texts) -> matrix, normalised to length 1."""

    def __init__(self, name: str, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> None:
        self.name, self.make = name, make

    def vectors(self, df: DataFrame) -> DataFrame:
        make = self.make

        @F.pandas_udf("array<float>")
        def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = make()
            for batch in texts:
                x = np.asarray(encoder(batch.fillna("").tolist()), dtype=np.float32)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pd.Series(list(x))

        return df.withColumn("vec", encode("text"))


class Places(dict):
    """The place of each token among `dim`, by its hash; those of the last tokens, a bounded number, are kept."""

    KEPT = 200_000

    def __init__(self, dim: int) -> None:
        super().__init__()
        self.dim = dim

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.KEPT:
            self.clear()
        self[token] = place = int(hashlib.md5(token, usedforsecurity=False).hexdigest()[:6], 16) % self.dim
        return place


class HashingProvider:
    """Vectors without a model: tokens counted in `dim` places by a hash, of length 1. Texts are lowered by Spark, as for keyword scores.

    Texts are near if they share words, whatever their order; for tests, and where no encoder is at hand.
    """

    #: Rows whose counts are made at once.
    ROWS = 1024

    def __init__(self, dim: int = 64) -> None:
        self.dim, self.name = dim, f"hashing-{dim}"

    def vectors(self, df: DataFrame) -> DataFrame:
        dim, rows = self.dim, self.ROWS

        @F.arrow_udf("array<float>")
        def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            place, find = Places(dim), re.compile(rb"[a-z0-9]+").findall
            for batch in texts:
                out = []
                for i in range(0, len(batch), rows):
                    part = batch.slice(i, rows).cast(pa.binary()).to_pylist()
                    every = [find(x) for x in part]
                    sizes = np.fromiter(map(len, every), dtype=np.int64, count=len(every))
                    at = np.fromiter(map(place.__getitem__, itertools.chain.from_iterable(every)), dtype=np.int64, count=int(sizes.sum()))
                    counts = np.bincount(np.repeat(np.arange(len(part)) * dim, sizes) + at, minlength=len(part) * dim).reshape(len(part), dim)
                    length = np.maximum(np.sqrt((counts * counts).sum(axis=1, dtype=np.int64).astype(np.float64)), 1.0)
                    out.append((counts / length[:, None]).astype(np.float32))
                flat = np.concatenate(out) if out else np.zeros((0, dim), dtype=np.float32)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * dim), pa.array(flat.reshape(-1)))

        return df.withColumn("vec", encode(F.lower(F.coalesce("text", F.lit("")))))


class Sticky:
    """A provider that is made once; if that fails, None from then on, and the reason is kept."""

    def __init__(self, make: Callable[[], Provider]) -> None:
        self._make, self._tried, self._provider = make, False, None
        self.reason = ""

    def get(self) -> Provider | None:
        if not self._tried:
            self._tried = True
            try:
                self._provider = self._make()
            except Exception as e:  # any failure of a model means keyword scores only
                self.reason = f"{type(e).__name__}: {e}"
        return self._provider


def dot(a: Column, b: Column) -> Column:
    """The sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def encoded(units: DataFrame, provider: Provider) -> DataFrame:
    """units with vec: as they have it, else by the provider."""
    return units if "vec" in units.columns else provider.vectors(units)


def asked_vectors(questions: DataFrame, provider: Provider) -> list[tuple[int, list[float]]]:
    """(query_id, vector) of the questions, a bounded set."""
    rows = provider.vectors(questions.select("query_id", "text")).select("query_id", "vec").collect()
    return [(r["query_id"], [float(x) for x in r["vec"]]) for r in rows if r["vec"] is not None]


def passage_cosines(passages: DataFrame, asked: list[tuple[int, list[float]]]) -> DataFrame:
    """(query_id, doc_id, passage_id, sem) of passages (doc_id, passage_id, vec) that have a vector."""
    keyed = passages.filter(F.col("vec").isNotNull()).select(F.struct("doc_id", "passage_id").alias("_k"), "vec")
    return cosines(keyed, "_k", asked).select("query_id", "_k.doc_id", "_k.passage_id", "sem")


def cosines(vectors: DataFrame, key: str, questions: list[tuple[int, list[float]]]) -> DataFrame:
    """(query_id, key, sem) for the vectors of a table (key, vec) and each question's unit vector; null for null, negative ones 0.

    The questions are part of the plan, so every vector is read once and none
    is shuffled.
    """
    asked = F.array(*(F.struct(F.lit(i).cast("long").alias("query_id"), F.array(*(F.lit(float(x)) for x in v)).alias("q")) for i, v in questions))
    pairs = vectors.select(key, "vec", F.explode(asked).alias("_a"))
    return pairs.select(F.col("_a.query_id"), key, F.round(F.greatest(dot(F.col("vec"), F.col("_a.q")), F.lit(0.0)), 6).alias("sem"))


def cosines_fast(vectors: DataFrame, key: str, questions: list[tuple[int, list[float]]]) -> DataFrame:
    """cosines() by matrix products over Arrow batches, for many questions or vectors."""
    ids = [i for i, _ in questions]
    q = np.array([v for _, v in questions], dtype=np.float64).T
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["vec"].notna()]
            if len(b):
                sem = np.round(np.maximum(np.stack(b["vec"].to_numpy()).astype(np.float64) @ q, 0.0), 6)
                for j, i in enumerate(ids):
                    yield pd.DataFrame({"query_id": i, key: b[key].to_numpy(), "sem": sem[:, j]})

    return vectors.select(key, "vec").mapInPandas(run, f"query_id long, {key} {kind}, sem double")
