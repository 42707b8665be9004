"""Loose references to files: names, recency, content, allowlists, document scope."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import DEFAULT, RetrievalConfig
from ..functions import text as T
from . import lexical
from .lexical import bounded, small


def recency_intent(target: Column) -> Column:
    return target.rlike(T.RECENCY)


def reference_tokens(target: Column) -> Column:
    """The tokens of a reference that name a file: no recency words if it asks for the latest, no stop words unless only these are left."""
    raw = T.name_tokens(target)
    recent, stop = F.array(*map(F.lit, T.RECENCY_WORDS)), F.array(*map(F.lit, T.STOP_WORDS))
    kept = F.when(recency_intent(target), F.filter(raw, lambda t: ~F.array_contains(recent, t))).otherwise(raw)
    meaningful = F.filter(kept, lambda t: ~F.array_contains(stop, t))
    return F.when(F.size(meaningful) > 0, meaningful).otherwise(kept)


def name_fraction(tokens: Column, name: Column) -> Column:
    """The share of tokens that occur anywhere in the file's name."""
    low = F.lower(name)
    found = F.size(F.filter(tokens, lambda t: F.contains(low, t)))
    return F.when(F.size(tokens) == 0, 0.0).otherwise(found / F.size(tokens))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of matching blocks (Ratcliff and Obershelp), for which there is no built-in."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def name_score(tokens: Column, name: Column) -> Column:
    ratio = sequence_ratio(F.array_join(tokens, " "), F.array_join(T.name_tokens(name), " "))
    return F.when(F.size(tokens) == 0, 0.0).otherwise(0.6 * name_fraction(tokens, name) + 0.4 * ratio)


def most_score(tokens: Column, name: Column) -> Column:
    """What name_score() can be at most, without comparing sequences: each sign of the shorter text may match but once."""
    a, b = F.array_join(tokens, " "), F.array_join(T.name_tokens(name), " ")
    total = F.length(a) + F.length(b)
    return 0.6 * name_fraction(tokens, name) + 0.4 * F.when(total == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / F.greatest(total, F.lit(1)))


def least_that_matters(config: RetrievalConfig = DEFAULT) -> float:
    """Scores below this change no answer of by_name(): they are no near miss, nor do they come close enough to one."""
    return config.near_threshold / max(1.0, config.dominance)


def scored_names(references: DataFrame, files: DataFrame, least: float = 0.0) -> DataFrame:
    """(ref_id, target, path, name, mtime_ns, tokens, score): every file by every reference.

    The references are questions of users, a bounded set that becomes part of
    the plan; the files are read once. With `least`, files that can't reach that score
    are left out before any sequences are compared.
    """
    rows = references.select("ref_id", "target").collect()
    asked = F.array(*(F.struct(F.lit(r["ref_id"]).cast("long").alias("ref_id"), F.lit(r["target"]).alias("target")) for r in rows))
    every = files.withColumn("_r", F.explode(asked)).select("_r.ref_id", "_r.target", "path", "name", "mtime_ns")
    every = every.withColumn("tokens", reference_tokens(F.col("target")))
    if least > 0:
        every = every.filter(recency_intent(F.col("target")) | (most_score(F.col("tokens"), F.col("name")) >= least - 1e-6))  # the newest is among all
    return every.withColumn("score", F.round(name_score(F.col("tokens"), F.col("name")), 6))


def by_name(scored: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(ref_id, kind, candidates): one, many or near, of the references that names resolve.

    All names at the threshold count, five at most; with none there, the best
    counts if it is near and far enough ahead of the next.
    """
    order = W.partitionBy("ref_id").orderBy(F.desc("score"), "path")
    ranked = scored.filter(~recency_intent(F.col("target"))).withColumn("rank", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("score").over(order), F.lit(0.0)))
    close = ranked.filter((F.col("score") >= config.name_threshold) & (F.col("rank") <= 5))
    found = close.groupBy("ref_id").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("c"))
    found = found.select("ref_id", F.when(F.size("c") == 1, "one").otherwise("many").alias("kind"), F.transform("c", lambda x: x["path"]).alias("candidates"))
    near = ranked.filter((F.col("rank") == 1) & (F.col("score") < config.name_threshold) & (F.col("score") >= config.near_threshold) & (F.col("score") >= F.col("next") * config.dominance))
    return found.unionByName(near.select("ref_id", F.lit("near").alias("kind"), F.array("path").alias("candidates")))


def by_recency(scored: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(ref_id, path): the newest file among those of the name, or of all, for references that ask for the latest."""
    asked = scored.filter(recency_intent(F.col("target"))).withColumn("named", (F.size("tokens") == 0) | (F.col("score") >= config.name_threshold))
    return asked.groupBy("ref_id").agg(F.max_by("path", F.struct(F.col("named"), "mtime_ns", "path")).alias("path"))


def probe_text(files: DataFrame, pages: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(path, text): title, author, subject and the first pages' text, joined by spaces, cut to probe_chars."""
    first = pages.filter(F.col("page") <= config.probe_pages)
    body = first.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]).alias("body"))
    parts = F.concat(F.array("title", "author", "subject"), F.coalesce("body", F.array().cast("array<string>")))
    kept = F.filter(F.array_compact(parts), lambda x: x != "")
    return files.join(body, "path", "left").select("path", F.left(T.stripped(F.array_join(kept, " ")), F.lit(config.probe_chars)).alias("text"))


def by_content(references: DataFrame, probes: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(ref_id, path, rank, score): files whose first pages fit a reference.

    A reference needs probe_terms terms, repeats counted, and the best file as many
    distinct ones; then all files count that score probe_ratio of the best, probe_keep at most.
    """
    probes = probes.filter(F.col("text") != "")
    asked = references.select(F.col("ref_id").alias("query_id"), F.col("target").alias("text"))
    enough = lexical.question_terms(asked, config).groupBy("query_id").agg(F.sum("m").alias("n")).filter(F.col("n") >= config.probe_terms)
    asked = asked.join(enough, "query_id", "left_semi")
    scores = lexical.bm25(probes, ["path"], asked, config)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "path")
    ranked = scored = scores.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("best", F.max("score").over(W.partitionBy("query_id")))
    terms = lexical.question_terms(asked, config).select("query_id", "term")
    top = scored.filter("rank = 1").select("query_id", "path")
    of_top = top.join(probes, "path").select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    sure = of_top.join(small(terms), ["query_id", "term"]).groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= config.probe_terms)
    kept = ranked.filter((F.col("best") > 0) & (F.col("score") >= F.col("best") * config.probe_ratio) & (F.col("rank") <= config.probe_keep))
    return kept.join(bounded(sure.select("query_id"), references), "query_id", "left_semi").select(F.col("query_id").alias("ref_id"), "path", "rank", "score")


def resolve(references: DataFrame, files: DataFrame, probes: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(ref_id, kind, candidates) of every reference: path, one, many or none.

    In order: an exact path, the newest file, names, a near miss, contents.
    """
    exact = references.join(files.select(F.col("path").alias("target")), "target", "left_semi").select("ref_id", F.lit("path").alias("kind"), F.array("target").alias("candidates"), F.lit(0).alias("step"))
    scored = scored_names(references, files, least_that_matters(config))
    recent = by_recency(scored, config).select("ref_id", F.lit("one").alias("kind"), F.array("path").alias("candidates"), F.lit(1).alias("step"))
    named = by_name(scored, config).select("ref_id", F.when(F.col("kind") == "near", "one").otherwise(F.col("kind")).alias("kind"), "candidates", F.lit(2).alias("step"))
    inside = by_content(references, probes, config).groupBy("ref_id").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("c"))
    inside = inside.select("ref_id", F.when(F.size("c") == 1, "one").otherwise("many").alias("kind"), F.transform("c", lambda x: x["path"]).alias("candidates"), F.lit(3).alias("step"))
    every = exact.unionByName(recent).unionByName(named).unionByName(inside)
    first = every.groupBy("ref_id").agg(F.min_by(F.struct("kind", "candidates"), "step").alias("f"))
    none = F.struct(F.lit("none").alias("kind"), F.array().cast("array<string>").alias("candidates"))
    return references.join(first, "ref_id", "left").withColumn("f", F.coalesce("f", none)).select("ref_id", "f.kind", "f.candidates")


def repaired(asks: DataFrame) -> DataFrame:
    """asks (target, query) with blanks filled from the other field; rows with neither have a null target."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    target, query = blank("target"), blank("query")
    return asks.withColumn("_t", F.coalesce(target, query)).withColumn("_q", F.coalesce(query, target)).drop("target", "query").withColumnsRenamed({"_t": "target", "_q": "query"})


def question_of(asks: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """asks (target, query, name) with question: the target where the query reads like the resolved file's own name."""
    raw = T.name_tokens(F.col("query"))
    stop = F.array(*map(F.lit, T.STOP_WORDS))
    kept = F.filter(raw, lambda t: ~F.array_contains(stop, t))
    tokens = F.when(F.size(kept) > 0, kept).otherwise(raw)
    swapped = (F.col("target") != F.col("query")) & (F.size(tokens) > 0) & (name_score(tokens, F.col("name")) >= config.name_threshold)
    return asks.withColumn("question", F.when(swapped, F.col("target")).otherwise(F.col("query")))


def in_scope(docs: DataFrame, wanted: str) -> DataFrame:
    """docs (doc_id) with that id, else those whose id before # is it; all for ''."""
    if not wanted:
        return docs
    exact = docs.filter(F.col("doc_id") == wanted)
    return exact if exact.limit(1).count() else docs.filter(F.split_part("doc_id", F.lit("#"), F.lit(1)) == wanted)


def scopes(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(name, doc_id, path) of in_scope() for each of names (name), as joins."""
    exact = names.join(docs.select("doc_id", "path"), F.col("name") == F.col("doc_id")).select("name", "doc_id", "path")
    others = names.join(docs.select(F.col("doc_id").alias("name")), "name", "left_anti")
    wide = others.join(docs.select("doc_id", "path"), F.col("name") == F.split_part("doc_id", F.lit("#"), F.lit(1))).select("name", "doc_id", "path")
    return exact.unionByName(wide)


def allowed(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or below one; without roots all are."""
    if not roots:
        return F.lit(True)
    return F.exists(F.array(*map(F.lit, dict.fromkeys(roots))), lambda r: (path == r) | F.startswith(path, F.concat(r, F.lit("/"))))


def launch_roots(arguments: list[str], before: list[str]) -> list[str]:
    """Roots from start arguments, blanks and unexpanded placeholders dropped, after those that are set, each once."""
    return list(dict.fromkeys([*before, *(a for a in arguments if a.strip() and not a.strip().startswith("${"))]))


def doc_ids(files: DataFrame) -> DataFrame:
    """files (path, name, seq) with doc_id: the name, for later paths of the same name with a hash of the path."""
    nth = F.dense_rank().over(W.partitionBy("name").orderBy("first", "path"))
    first = F.min("seq").over(W.partitionBy("name", "path"))
    return files.withColumn("first", first).withColumn("doc_id", F.when(nth == 1, F.col("name")).otherwise(F.concat("name", F.lit("#"), F.left(F.sha2("path", 256), F.lit(6))))).drop("first")
