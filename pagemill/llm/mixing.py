"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key; within its source the documents stand in
the order of their keys. Prefix sums of their sizes are distributed: keys fall
into equal ranges, the ranges' sums are added up per source, and each range adds
up its own documents. A source whose target is n times its size and a rest
takes every document n times, and in one more epoch those whose prefix lies
below the rest; the one that crosses it gives the words that are still missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh, partitions

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Number of words, runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def random_key(salt: int = 0) -> Column:
    """32 hex digits from doc_id, or the text where it is null (and a salt, for another order)."""
    suffix = f"#{salt}" if salt else ""
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    return F.md5(F.concat(named, F.lit(suffix)).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources by code point, null last, weigh `weights` in turn. Targets share
    `share` times all sizes by weight; none is above `most` times its source's
    size, and what it would exceed is shared by the others, by weight, until
    none is above. So target = min(most * size, level * weight), and the level
    follows from the sources that are capped: those whose cap over weight is
    smallest. Only rows of sources, not of documents, meet in one place.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cases = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.select("source", "source_size", cases.alias("weight")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(share)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = weighed.withColumn("level", level).withColumn("place", F.row_number().over(by_ratio))
    # the first source whose cap is above the level, and all after it, share that level
    first_open = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("place", "level"))).over(everything)
    return leveled.withColumn("open", first_open.getField("level")).select(
        "source", "source_size", F.coalesce(F.least("cap", F.col("open") * F.col("weight")), F.col("cap")).alias("target")
    )


def sized(docs: DataFrame, salt: int = 0) -> DataFrame:
    """(doc_id, source, size, text_key, key) of every row; the texts go no further."""
    return docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("text_key"), random_key(salt).alias("key"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, salt: int = 0) -> DataFrame:
    """(doc_id, source, size, text_key, source_size, target, taken, copies, part) for every row of docs (doc_id, text, source).

    taken = copies * size + part: whole copies, and words of one more, cut one.
    A source's taken words add up to the whole number below its target. The
    order is by md5 of doc_id (of the text, where it is null), ties by size and a
    hash of the text; rows that are equal in all of it are interchangeable. Null
    texts have size 0 and are taken 0 times; an empty table gives no rows.
    Other columns play no part.
    """
    ranges = 4 * partitions(docs.sparkSession)
    rows = cut(sized(docs, salt).withColumn("range", F.floor(F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * ranges / (1 << 24)).cast("int")))
    by_range = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    by_source = targets(by_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    begins = by_range.withColumn("begin", F.coalesce(F.sum("range_size").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    b, s = begins.alias("b"), by_source.alias("s")
    bounds = b.join(s, F.col("b.source").eqNullSafe(F.col("s.source"))).select(F.col("b.source").alias("of_source"), F.col("b.range").alias("of_range"), "begin", "source_size", "target")
    inner = W.partitionBy("source", "range").orderBy("key", "doc_id", "size", "text_key").rowsBetween(W.unboundedPreceding, -1)
    prefixed = rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    joined = prefixed.join(bounds, prefixed["source"].eqNullSafe(bounds["of_source"]) & (prefixed["range"] == bounds["of_range"]))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("begin") - F.col("within")))
    out = joined.withColumn("last", last).withColumn("epochs", epochs)
    whole = (F.col("last") == F.col("size")) & (F.col("size") > 0)
    return out.select(
        "doc_id", "source", "size", "text_key", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("last")).alias("taken"),
        (F.col("epochs") + whole.cast("long")).alias("copies"), F.when(whole, 0).otherwise(F.col("last")).cast("long").alias("part"),
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, salt: int = 0) -> DataFrame:
    """The mix itself: docs' rows as often as taken, the cut copy with its first words only, every column kept.

    n_chars, if docs has it, is set to the text's length in code points where a
    copy is cut. Documents of size 0 add no words and are left out. Rows with
    the same doc_id, source and text share what is taken for them in turn.
    """
    taken = F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("copies").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    name = lambda text_key: F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("doc"), F.col("source"), F.col("source").isNull().cast("string"), text_key.cast("string")).cast("binary"))
    plan = mix(docs, weights, share, most, salt).filter("taken > 0")
    row, takes, nth, take, cut_text = fresh(docs.columns, "_row", "_takes", "_nth", "_take", "_cut")
    by_row = plan.groupBy(name(F.col("text_key")).alias(row)).agg(F.collect_list(taken).alias(takes))
    met = docs.withColumn(row, name(F.xxhash64("text"))).join(by_row.hint("shuffle_hash"), row)
    number = F.row_number().over(W.partitionBy(row).orderBy(row))
    every = met.withColumn(nth, number - 1).withColumn(take, F.explode(F.get(takes, F.col(nth))))
    words = F.regexp_extract_all("text", F.lit(f"([\\x20\\x09-\\x0D]*{WORD})"), F.lit(1))
    every = every.withColumn(cut_text, F.when(F.col(take) == 0, F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col(take).cast("int")), "")))
    new = {"text": F.col(cut_text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(take) == 0, F.col("n_chars")).otherwise(F.length(cut_text)).cast(docs.schema["n_chars"].dataType)
    return every.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
