"""Retrieval quality and token economy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lexical import small


def recall(found: DataFrame, gold: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """One row (n, hits, abstained, recall, false_abstain): found (query_id, key) against gold (query_id, key).

    Questions without gold are left out.
    """
    asked = questions.join(gold.select("query_id").distinct(), "query_id", "left_semi").select("query_id")
    hit = found.join(gold, ["query_id", key], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    any_ = found.select("query_id").distinct().withColumn("any", F.lit(1))
    met = asked.join(hit, "query_id", "left").join(any_, "query_id", "left")
    out = met.agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("hits"), F.coalesce(F.sum(F.when(F.col("any").isNull(), 1)), F.lit(0)).cast("long").alias("abstained"))
    share = lambda c: F.round(F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0), 6)
    return out.select("n", "hits", "abstained", share("hits").alias("recall"), share("abstained").alias("false_abstain"))


def false_accept(found: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """One row (n, accepted, false_accept): questions without gold that got an answer; the share of no questions is NaN."""
    asked = questions.join(gold.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
    met = asked.join(found.select("query_id").distinct().withColumn("any", F.lit(1)), "query_id", "left")
    out = met.agg(F.count("*").alias("n"), F.coalesce(F.sum("any"), F.lit(0)).cast("long").alias("accepted"))
    return out.withColumn("false_accept", F.round(F.when(F.col("n") > 0, F.col("accepted") / F.col("n")).otherwise(float("nan")), 6))


def ab_tokens(whole: DataFrame, slices: DataFrame) -> DataFrame:
    """One row (questions, naive, sliced, saved, percent): whole and slices are (query_id, tokens)."""
    met = whole.withColumnRenamed("tokens", "a").join(slices.withColumnRenamed("tokens", "b"), "query_id", "left").fillna(0)
    out = met.agg(F.count("*").alias("questions"), F.sum("a").alias("naive"), F.sum("b").cast("long").alias("sliced"))
    return out.withColumn("saved", F.col("naive") - F.col("sliced")).withColumn("percent", F.floor(F.col("saved") * 100 / F.greatest("naive", F.lit(1))).cast("long"))


def holders(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id): the documents (doc_id, text) that hold an item's passage (query_id, passage) whole.

    A passage's words but the first and last stand as words in such a document. The
    longest of them (ties: the first by letters) joins, and only then texts are compared. Passages
    of less than three words are looked for in every text.
    """
    inner = T.words(F.col("passage"))
    inner = F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0)))
    key = F.array_min(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))["w"]
    keyed = items.select("query_id", "passage", key.alias("_key"))
    asked = keyed.filter(F.col("_key").isNotNull())
    words = docs.select("doc_id", "text", F.explode(F.array_distinct(T.words(F.coalesce("text", F.lit(""))))).alias("_key"))
    met = words.select("doc_id", "_key").join(small(asked.select("_key").distinct()), "_key", "left_semi").join(small(asked), "_key")
    found = met.join(docs.select("doc_id", "text"), "doc_id").filter(F.contains("text", F.col("passage"))).select("query_id", "doc_id")
    short = keyed.filter(F.col("_key").isNull()).select("query_id", "passage")
    rest = docs.select("doc_id", "text").join(small(short), F.contains("text", F.col("passage"))).select("query_id", "doc_id")
    return found.unionByName(rest)
