"""Inverted index and keyword scores.

Units are any rows with key columns and a text. Tokens are exploded within
their task; what is shuffled is (unit, term, count), combined before, and for
a set of questions only the tokens that some question asks for.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from ..config import DEFAULT, RetrievalConfig
from ..functions import text as T

#: A side is broadcast only if it has no more rows than this.
SMALL_ROWS = 100_000


def local(spark: SparkSession, rows: list, schema) -> DataFrame:
    """Rows as a relation of the plan itself: no Python, no job, and its size is known to the optimizer."""
    fields = (_parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.table(columns, names=[f.name for f in fields]), StructType(fields))


_KEPT: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """df, kept once it is computed, as several steps of a search read it; until release()."""
    _KEPT.append(df.persist())
    return df


def release() -> None:
    """Let go of what searches have kept."""
    while _KEPT:
        _KEPT.pop().unpersist()


class Asked:
    """A batch's question terms (query_id, term, m), computed once; `few` tells whether they, and what has no more rows, may be broadcast."""

    def __init__(self, questions: DataFrame, config: RetrievalConfig = DEFAULT) -> None:
        terms = question_terms(questions, config)
        rows = terms.limit(SMALL_ROWS + 1).collect()
        self.few = len(rows) <= SMALL_ROWS
        self.terms = local(questions.sparkSession, rows, "query_id long, term string, m long") if self.few else terms
        self.least = config.least_term

    def side(self, df: DataFrame) -> DataFrame:
        """df, which has no more rows than the terms, as a side of a join."""
        return F.broadcast(df) if self.few else df

    @property
    def distinct(self) -> DataFrame:
        return self.terms.select("term").distinct()


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """df, to be broadcast if it is no larger than the limit; counting stops there."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def bounded(df: DataFrame, by: DataFrame) -> DataFrame:
    """df, which has no more rows than `by`, to be broadcast if that is small: df itself isn't computed to find out."""
    return F.broadcast(df) if by.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def question_terms(questions: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(query_id, term, m): each question's distinct terms and how often it has them."""
    terms = questions.select("query_id", F.explode(T.query_terms(F.col("text"), config.least_term)).alias("term"))
    out = terms.groupBy("query_id", "term").agg(F.count("*").alias("m"))
    return out.withColumn("m", F.lit(1).cast("long")) if config.dedup_terms else out


def exploded(units: DataFrame, keys: list[str], stemmed: bool = True) -> DataFrame:
    token = F.col("_t")
    return units.select(*keys, F.explode(T.raw_tokens(F.coalesce("text", F.lit("")))).alias("_t")).select(*keys, (T.stem(token) if stemmed else token).alias("term"))


def postings(units: DataFrame, keys: list[str], stemmed: bool = True) -> DataFrame:
    """(*keys, term, tf)."""
    return exploded(units, keys, stemmed).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def lengths(units: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, dl): the units' numbers of tokens, 0 included; no shuffle."""
    return units.select(*keys, F.size(T.raw_tokens(F.coalesce("text", F.lit("")))).cast("long").alias("dl"))


def corpus_stats(units: DataFrame) -> DataFrame:
    """One row (n_units, total_tokens, avgdl); an empty corpus counts as one unit."""
    n = F.greatest(F.count("*"), F.lit(1))
    total = F.coalesce(F.sum("dl"), F.lit(0))
    return lengths(units, []).agg(F.count("*").alias("n_units"), total.cast("long").alias("total_tokens"), (total / n).alias("avgdl"))


def term_stats(index: DataFrame) -> DataFrame:
    """(term, df, hits) of postings."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("hits"))


def _size(units: DataFrame) -> tuple[Column, Column]:
    """The number of units, one at least, and their mean length, read once as two numbers."""
    row = corpus_stats(units).first()
    return F.lit(float(max(1, row["n_units"]))), F.lit(row["avgdl"] or 1.0)


def _asked(units: DataFrame, keys: list[str], asked: Asked) -> DataFrame:
    """Postings of the terms that are asked for, each with its unit's length, which travels with the tokens."""
    token = units.select(*keys, T.raw_tokens(F.coalesce("text", F.lit(""))).alias("_all")).select(*keys, F.size("_all").cast("long").alias("dl"), F.explode("_all").alias("_t"))
    found = token.select(*keys, "dl", T.stem(F.col("_t")).alias("term")).join(asked.side(asked.distinct), "term", "left_semi")
    return kept(found.groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf")))


def bm25(units: DataFrame, keys: list[str], questions: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(query_id, *keys, score) of the units that have any of a question's terms.

    A term that a question has m times counts m times, with m times its
    document frequency (which can turn its weight negative).
    """
    asked = Asked(questions, config)
    found = _asked(units, keys, asked)
    n, average = _size(units)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weighted = asked.terms.join(df, "term")
    d = F.col("m") * F.col("df")
    idf = F.log(1 + (n - d + 0.5) / (d + 0.5))
    saturation = F.col("tf") * (config.k1 + 1) / (F.col("tf") + config.k1 * (1 - config.b + config.b * F.greatest("dl", F.lit(1)) / average))
    scored = found.join(asked.side(weighted.withColumn("_w", F.col("m") * idf)), "term")
    return scored.groupBy("query_id", *keys).agg(F.round(F.sum(F.col("_w") * saturation), 6).alias("score"))


def hits(units: DataFrame, keys: list[str], questions: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(query_id, term, hits): how often each asked term occurs; 0 if never."""
    asked = Asked(questions, config)
    terms = asked.terms
    found = _asked(units, keys, asked).groupBy("term").agg(F.sum("tf").alias("tf"))
    return terms.join(found, "term", "left").select("query_id", "term", F.coalesce("tf", F.lit(0)).cast("long").alias("hits"))


def missing_terms(units: DataFrame, keys: list[str], questions: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(query_id, term): asked terms that no unit has."""
    return hits(units, keys, questions, config).filter("hits = 0").select("query_id", "term")


def prefixed(units: DataFrame, keys: list[str], asked: Asked) -> DataFrame:
    """(*keys, dl, term, tf): tokens, unstemmed, that begin with an asked term.

    A join on the first `least` letters, which every term has, with the rest of
    the prefix tested after; a plain prefix condition would compare all pairs.
    """
    token = units.select(*keys, T.raw_tokens(F.coalesce("text", F.lit(""))).alias("_all")).select(*keys, F.size("_all").cast("long").alias("dl"), F.explode("_all").alias("_t"))
    heads = asked.side(asked.distinct.withColumn("_head", F.left("term", F.lit(asked.least))))
    met = token.withColumn("_head", F.left("_t", F.lit(asked.least))).join(heads, "_head").filter(F.col("_t").startswith(F.col("term")))
    return kept(met.groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf")))


def prefix_bm25(units: DataFrame, keys: list[str], questions: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(query_id, *keys, score): the full-text index's BM25 with prefix terms, positive.

    Terms match raw tokens as prefixes; a weight that isn't positive becomes
    1e-6; a term that is asked m times counts m times with its plain frequency.
    """
    asked = Asked(questions, config)
    found = prefixed(units, keys, asked)
    n, average = _size(units)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weighted = asked.terms.join(df, "term")
    raw = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, 1e-6).otherwise(raw)
    k1, b = config.index_k1, config.index_b
    saturation = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average))
    scored = found.join(asked.side(weighted.withColumn("_w", F.col("m") * idf)), "term")
    return scored.groupBy("query_id", *keys).agg(F.round(F.sum(F.col("_w") * saturation), 6).alias("score"))


def missing_prefixes(units: DataFrame, questions: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(query_id, term): asked terms with which no token begins."""
    asked = Asked(questions, config)
    found = prefixed(units, [], asked).select("term").distinct()
    return asked.terms.join(found, "term", "left_anti").select("query_id", "term")
