"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (src, dst): label is the smallest node of its component.

    Alternates the large-star and small-star steps, in which a node's
    neighbours meet its smallest neighbour, until the links no longer change;
    the rounds grow with the logarithm of the longest path. Every round is
    checkpointed. The rows are two numbers; a node of so many neighbours that
    their rows are too large for a task is split by the runtime's skew join.
    Links with a null end, loops and repeats are without effect.
    """

    def stars(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        if large:
            both = both.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
        else:
            both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        kept = joined.filter(F.col("b") > F.col("a")) if large else joined
        out = kept.select(F.col("b").alias("x"), F.col("m").alias("y"))
        if not large:
            out = out.unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
        return out.filter("x <> y").select(F.greatest("x", "y").alias("src"), F.least("x", "y").alias("dst")).distinct()

    def mark(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()

    edges = cut(links.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    before = mark(edges)
    while before[0]:
        edges = cut(stars(stars(edges, True), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    labels = edges.groupBy("src").agg(F.min("dst").alias("label")).withColumnRenamed("src", "node")
    return labels.unionByName(edges.select(F.col("dst").alias("node"), F.col("dst").alias("label")).distinct()).groupBy("node").agg(F.min("label").alias("label"))
