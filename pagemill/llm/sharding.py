"""Sharding by extendible hashing, with DataFrame functions only.

A directory is indexed by the first bits of a document's hash. A bucket whose
documents hold more bytes than the limit is split on the next bit, and only
such a bucket; the others keep their local depth. Sizes are added up by a
prefix a few bits longer than the total calls for, so that all splits down to
there follow from one aggregation of bounded width; only cells that are still
too large are looked at again with more bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, partitions

#: Hash bits that there are, bits that are looked at beyond what the total calls for, and a shard's bytes.
BITS, AHEAD, LIMIT = 60, 4, 1 << 20


def hash_bits() -> Column:
    """60 bits of md5 of doc_id as a number; of the text, for rows without doc_id."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(depth: Column | int, bits: str = "bits") -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", F.col(bits), (F.lit(BITS) - depth).cast("int"))


def binary(value: Column, depth: Column) -> Column:
    """The prefix as a string of `depth` binary digits, empty at depth 0."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(value), depth.cast("int"), F.lit("0")))


def directory(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(depth, cell, shard_bytes) of the buckets, from (bits, bytes): cell is the prefix of `depth` bits.

    Buckets are disjoint and cover all rows. A bucket is within the limit or
    holds one hash value only, which no further bit would part.
    """
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    top, done, cells = 0, None, sizes
    deep = min(BITS, max(0, -(-total // limit) - 1).bit_length() + AHEAD)
    splits = (F.col("shard_bytes") > limit) & (F.col("low") < F.col("high"))
    while True:
        base = cells.groupBy(prefix(deep).alias("leaf")).agg(F.sum("bytes").alias("leaf_bytes"), F.min("bits").alias("leaf_low"), F.max("bits").alias("leaf_high"))
        steps = base.withColumn("depth", F.explode(F.sequence(F.lit(top), F.lit(deep)))).withColumn("cell", F.call_function("shiftright", F.col("leaf"), (F.lit(deep) - F.col("depth")).cast("int")))
        sums = steps.groupBy("depth", "cell").agg(F.sum("leaf_bytes").alias("shard_bytes"), F.min("leaf_low").alias("low"), F.max("leaf_high").alias("high"))
        # cells whose parents split; those that split themselves go on, the others are buckets
        parents = sums.filter(splits).select((F.col("depth") + 1).alias("depth"), F.col("cell").alias("_parent"))
        below = sums.withColumn("_parent", F.call_function("shiftright", F.col("cell"), F.lit(1))).join(parents, ["depth", "_parent"], "left_semi").drop("_parent")
        made = below if top else below.unionByName(sums.filter("depth = 0"))
        made = cut(made.filter(~splits | (F.col("depth") == deep)))
        buckets = made.filter(~splits)
        done = buckets if done is None else done.unionByName(buckets)
        large = made.filter(splits).select(F.col("cell").alias("_cell"))
        if not large.limit(1).count():
            return done.select("depth", "cell", "shard_bytes")
        cells = cut(cells.join(large, prefix(deep) == F.col("_cell"), "left_semi"))
        top, deep = deep, min(BITS, deep + AHEAD)


def located(rows: DataFrame, buckets: DataFrame) -> DataFrame | None:
    """rows with the depth, cell and shard_bytes of their buckets; None without buckets.

    The directory has an entry for each prefix of as many bits as most buckets
    need, so that it has few times as many entries as there are buckets, and a row
    looks up one. Only rows of deeper buckets are looked for at each greater depth.
    """
    counts = {r["depth"]: r["count"] for r in buckets.groupBy("depth").count().collect()}  # 61 at most
    if not counts:
        return None
    total = sum(counts.values())
    bits = max(g for g in counts if g == min(counts) or sum(n << (g - d) for d, n in counts.items() if d <= g) <= 4 * total)
    rest = F.lit(bits) - F.col("depth")
    entries = buckets.filter(F.col("depth") <= bits).withColumn("_low", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), rest.cast("int")) - 1)))
    entries = entries.select((F.call_function("shiftleft", F.col("cell"), rest.cast("int")) + F.col("_low")).alias("_entry"), "depth", "cell", "shard_bytes")
    met = rows.withColumn("_entry", prefix(bits)).join(entries, "_entry", "left").drop("_entry")
    deeper = [d for d in sorted(counts) if d > bits]
    if not deeper:
        return met
    met = cut(met)
    tried = met.filter(F.col("depth").isNull()).drop("depth", "cell", "shard_bytes").withColumn("depth", F.explode(F.array(*map(F.lit, deeper)))).withColumn("cell", prefix(F.col("depth")))
    return met.filter(F.col("depth").isNotNull()).unionByName(tried.join(buckets, ["depth", "cell"]))


def chained(rows: DataFrame, limit: int) -> DataFrame:
    """rows of buckets that no bit can part, with part and its shard_bytes.

    Rows up to half the limit are in parts by running size, which is a distributed
    prefix sum over ranges, larger ones are parts of their own.
    """
    half, ranges = max(1, limit // 2), 4 * partitions(rows.sparkSession)
    small = F.col("n_bytes") <= half
    at = rows.withColumn("_range", F.pmod(F.xxhash64("text_key", "_pid"), F.lit(ranges)).cast("int")).withColumn("_size", F.when(small, F.col("n_bytes")).otherwise(0)).withColumn("_big", (~small).cast("long"))
    by_range = at.groupBy("bits", "_range").agg(F.sum("_size").alias("_s"), F.sum("_big").alias("_b"))
    before = W.partitionBy("bits").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    begins = by_range.select("bits", "_range", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"))
    inner = W.partitionBy("bits", "_range").orderBy("n_bytes", "text_key").rowsBetween(W.unboundedPreceding, -1)
    run = at.withColumn("_s1", F.coalesce(F.sum("_size").over(inner), F.lit(0))).withColumn("_b1", F.coalesce(F.sum("_big").over(inner), F.lit(0))).join(begins, ["bits", "_range"])
    part = F.when(small, F.floor((F.col("_s0") + F.col("_s1")) / half)).otherwise(F.lit(1 << 30) + F.col("_b0") + F.col("_b1"))
    out = run.withColumn("part", part.cast("int")).drop("_range", "_size", "_big", "_s0", "_s1", "_b0", "_b1", "shard_bytes")
    return out.withColumn("shard_bytes", F.sum("n_bytes").over(W.partitionBy("bits", "part")))


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, part, shard_bytes) for every row of docs (doc_id, text).

    n_bytes is the text's length in UTF-8 (null: 0). shard is the bucket's
    prefix in binary digits, '' where all fits into one. Rows of one doc_id have one
    hash, which no bit can part (rows without doc_id have their text's): where they
    alone exceed the limit, they are chained in parts by running size, each within the
    limit or of one row; part is 0 elsewhere. A single document above the limit is a
    shard of its own. shard_bytes is the size of the shard's part. Empty tables give
    no rows; other columns play no part. Row order plays none either, but for which of
    the rows of one such doc_id share a part.
    """
    rows = cut(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), hash_bits().alias("bits"), F.xxhash64("text").alias("text_key"), F.spark_partition_id().alias("_pid")))
    buckets = directory(rows.select("bits", F.col("n_bytes").alias("bytes")), limit)
    met = located(rows, buckets)
    if met is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, n_bytes long, shard string, depth int, part int, shard_bytes long")
    fits = met.filter(F.col("shard_bytes") <= limit).withColumn("part", F.lit(0))
    large = buckets.filter(F.col("shard_bytes") > limit)
    every = fits.unionByName(chained(met.filter(F.col("shard_bytes") > limit), limit).select(*fits.columns)) if large.limit(1).count() else fits
    return every.select("doc_id", "n_bytes", binary(F.col("cell"), F.col("depth")).alias("shard"), F.col("depth").cast("int").alias("depth"), F.col("part").cast("int").alias("part"), "shard_bytes")
