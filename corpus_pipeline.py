"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents. Each works on all that its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, langid, linededup, mixing, resemblance, simhash
from pagemill.llm.common import checkpoint_dir, cut, fresh, if_small
from pagemill.llm.components import connected_components
from pagemill.llm.queries import documents, tokenizer_path

#: Documents of which less than this share of the letters is in any learned language are rejected.
LEAST_KNOWN = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; goes: null texts, texts without letters, texts mostly in no learned language. Sets lang to the prediction."""
    model = langid.train(docs.filter(~langid.held_out()))
    lang, known = fresh(docs.columns, "lang_pred", "known")
    told = langid.identify(docs, model)
    kept = told.filter((F.col(lang) != langid.UNKNOWN) & (F.col(known) >= LEAST_KNOWN))
    return kept.withColumn("lang", F.col(lang)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document has; a document left without any line goes, as does one left with blank lines only."""
    text, dropped = fresh(docs.columns, "kept_text", "n_dropped")
    out = linededup.dedup_lines(docs)
    kept = out.filter((F.col(dropped) == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col(text), "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}
    return kept.select(*(F.when(F.col(dropped) == 0, F.col(f"`{c}`")).otherwise(new[c]).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays (all its rows, where rows repeat it); rows without doc_id stay.

    Near-duplicates are those of op4's SimHash and texts that share 0.8 or more of their five-word shingles, all
    of them: what chains of min-hashes leave apart is joined exactly.
    """
    numbered = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = cut(connected_components(cut(simhash.document_links(numbered).unionByName(resemblance.links(numbered)))))
    more = cut(resemblance.remaining(numbered, labels))
    if more.limit(1).count():
        labels = connected_components(cut(more.unionByName(labels.select(F.col("node").alias("src"), F.col("label").alias("dst")))))
    (gone,) = fresh(docs.columns, "_gone")
    losers = cut(labels.filter(F.col("node") != F.col("label")).select(F.col("node").alias(gone)))
    return docs.join(if_small(losers), F.col("doc_id") == F.col(gone), "left_anti")


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight: a document's row as often as the mix takes it, one copy in each source cut at the budget."""
    return mixing.mixed_documents(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256) of every row; ids are little-endian unsigned 32-bit integers."""
    out = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing_weights),
    ("bpe", bpe_tokens),
]

#: SQL can express neither the classifier's Viterbi nor the tokenizer's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
