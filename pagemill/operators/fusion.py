"""Normalising, blending and gating of keyword and vector scores, and ranking.

Scores are sparse: only units with a keyword score, or of a document whose
vector is near enough, can pass the gate. Minima and maxima are over all
candidates all the same: units without a row have a score of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, RetrievalConfig
from .lexical import bounded


def minmax(x: Column, lo: Column, hi: Column) -> Column:
    """0 to 1; where all are equal, 1 for positive ones."""
    return F.when(hi <= lo, F.when(x > 0, 1.0).otherwise(0.0)).otherwise((x - lo) / (hi - lo))


def score_bounds(kw: DataFrame, sem: DataFrame, units_of_doc: DataFrame, query_ids: DataFrame) -> DataFrame:
    """(query_id, kw_lo, kw_hi, sem_lo, sem_hi) over all units of all documents.

    kw: (query_id, ..., kw) sparse; sem: (query_id, doc_id, sem), or with
    passage_id for vectors of units; units_of_doc: (doc_id, n), the documents' numbers
    of units.
    """
    sizes = units_of_doc.agg(F.sum("n").alias("n"), F.count("*").alias("docs")).first()
    total = sizes["n"] or 0
    scored = total if "passage_id" in sem.columns else sizes["docs"]
    k = kw.groupBy("query_id").agg(F.count("*").alias("kn"), F.min("kw").alias("kl"), F.max("kw").alias("kh"))
    s = sem.join(units_of_doc, "doc_id", "left_semi").groupBy("query_id").agg(F.count("sem").alias("sn"), F.min("sem").alias("sl"), F.max("sem").alias("sh"))
    zero = F.lit(0.0)
    full = lambda n, all_, x, pick: F.when(F.coalesce(n, F.lit(0)) < all_, pick(F.coalesce(x, zero), zero)).otherwise(x)
    return query_ids.join(bounded(k, query_ids), "query_id", "left").join(bounded(s, query_ids), "query_id", "left").select(
        "query_id", full(F.col("kn"), total, F.col("kl"), F.least).alias("kw_lo"), full(F.col("kn"), total, F.col("kh"), F.greatest).alias("kw_hi"),
        full(F.col("sn"), scored, F.col("sl"), F.least).alias("sem_lo"), full(F.col("sn"), scored, F.col("sh"), F.greatest).alias("sem_hi"),
    )


def candidates(units: DataFrame, kw: DataFrame, sem: DataFrame, floor: float) -> DataFrame:
    """(query_id, doc_id, passage_id, page, kw, sem): units with a keyword score row or a near vector, their document's or their own."""
    keys = [c for c in ("doc_id", "passage_id") if c in sem.columns]
    near = sem.filter(F.col("sem") >= floor).select("query_id", *keys)
    by_doc = units.select("doc_id", "passage_id", "page").join(near, keys).select("query_id", "doc_id", "passage_id", "page")
    by_word = kw.select("query_id", "doc_id", "passage_id", "page", "kw")
    both = by_doc.withColumn("kw", F.lit(0.0)).unionByName(by_word).groupBy("query_id", "doc_id", "passage_id", "page").agg(F.max("kw").alias("hi"), F.min("kw").alias("lo"))
    scored = both.withColumn("kw", F.when(F.col("hi") > 0, F.col("hi")).otherwise(F.col("lo"))).drop("hi", "lo")
    return scored.join(sem, ["query_id", *keys], "left").withColumn("sem", F.coalesce("sem", F.lit(0.0)))


def blended(found: DataFrame, bounds: DataFrame, config: RetrievalConfig = DEFAULT, matched: str | None = None, few: bool = False) -> DataFrame:
    """found with kw_norm, sem_norm, eligible and score; units that aren't eligible score 0.

    few tells that bounds, a row for each question, may be broadcast. matched, if given, is a column with the number of distinct terms: with
    min_keyword_terms above 1, keyword hits below it don't make eligible.
    """
    word = F.col("kw") > 0
    if matched and config.min_keyword_terms > 1:
        word &= F.col(matched) >= config.min_keyword_terms
    met = found.join(F.broadcast(bounds) if few else bounds, "query_id")
    met = met.withColumn("kw_norm", minmax(F.col("kw"), F.col("kw_lo"), F.col("kw_hi"))).withColumn("sem_norm", minmax(F.col("sem"), F.col("sem_lo"), F.col("sem_hi")))
    met = met.withColumn("eligible", (F.col("sem") >= config.semantic_floor) | word)
    score = config.keyword_weight * F.col("kw_norm") + config.semantic_weight * F.col("sem_norm")
    return met.withColumn("score", F.when(F.col("eligible"), F.round(score, 6)).otherwise(0.0)).drop("kw_lo", "kw_hi", "sem_lo", "sem_hi")


def page_scores(scored: DataFrame) -> DataFrame:
    """(query_id, doc_id, page, score): the best of a page's units; pages without a row score 0."""
    return scored.groupBy("query_id", "doc_id", "page").agg(F.max("score").alias("score"))


def top_pages(scored: DataFrame, k: int | Column = DEFAULT.k) -> DataFrame:
    """(query_id, doc_id, page, score, rank): the k best of each question, ties by doc_id and page."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "page")
    return scored.filter("score > 0").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def top_passages(scored: DataFrame, k: int | Column = DEFAULT.passage_k) -> DataFrame:
    """scored with rank: the k best units of each question, ties to the later one."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"), F.desc("passage_id"))
    return scored.filter("score > 0").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
