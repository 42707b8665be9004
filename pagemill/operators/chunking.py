"""Pages to overlapping passages. No row leaves its task: windows are array slices of a page's words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, RetrievalConfig
from ..functions import text as T

#: passage_id = page * PER_PAGE + passage_no, unique and ascending within a document.
PER_PAGE = 100_000


def passages(pages: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(doc_id, passage_id, page, passage_no, start_word, text) of pages (doc_id, page, text).

    Windows of passage_words, each passage_overlap words into the one before; a
    last window of no more than the overlap is left out, unless it is the only one.
    """
    step = config.passage_words - config.passage_overlap
    every = pages.select("doc_id", "page", T.words(F.coalesce("text", F.lit(""))).alias("words"))
    n = F.size("words")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: ((s == 0) & (n > 0)) | (n - s > config.passage_overlap))
    cut = every.select("doc_id", "page", "words", F.posexplode(starts).alias("i", "start"))
    return cut.select(
        "doc_id", (F.col("page").cast("long") * PER_PAGE + F.col("i") + 1).alias("passage_id"), F.col("page").cast("long").alias("page"), (F.col("i") + 1).cast("long").alias("passage_no"),
        F.col("start").cast("long").alias("start_word"), F.array_join(F.slice("words", F.col("start") + 1, F.lit(config.passage_words)), " ").alias("text"),
    )
