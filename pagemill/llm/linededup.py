"""Line dedup that can be undone: sharded cuckoo filters over exact reference-count tables.

A line's key is 128 bits of its hash, as two longs (h, g). The state of a corpus:

- the exact table (h, g, refs, low, high): refs counts the references of the
  line, low and high are the smallest and largest document that holds it;
- filters (shard, filter): a cuckoo filter for each shard of h over the keys that
  more than one document holds.

Every line is first looked up in its shard's filter. Only what the filter may
hold is joined with the exact table, and is dropped where the table confirms
it and the document isn't the owner, which is low. Filters are streamed past the lines,
one at a time, and shards with very common lines are dealt over several tasks.

LineStore keeps the state on disk. Documents can be added and taken out again, in
any order: a change is appended to the exact table's log, keys that come to be
shared, or cease to be, are inserted into or deleted from the filters of their
shards, and no other filter is written. The store is then the same as one built
from the documents that are left.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut, fresh, in_slices, join_split, partitions, small_batches, widened
from .cuckoo import CuckooFilter

#: The shortest key in code points; the references that a task takes of a very common line or shard (so many, or twice the mean); the keys of a filter.
MIN_CHARS, TASK_ROWS, SHARD_KEYS = 10, 1_000, 1_000_000
WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """16 bytes for the line without white space at its ends and with A-Z lowered; None if it is too short."""
    key = line.strip(WHITE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def line_refs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, g, doc_id), each row's distinct line keys; rows without doc_id give none."""

    def run(batches):
        for b in batches:
            ids, keys = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if doc is None or not text.is_valid:
                    continue
                found = {k for line in text.as_buffer().to_pybytes().split(b"\n") if (k := line_key(line, min_chars))}
                keys += found
                ids += [doc] * len(found)
            raw = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(raw[:, 0]), pa.array(raw[:, 1]), pa.array(ids, pa.int64())], names=["h", "g", "doc_id"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "h long, g long, doc_id long")


def shard_of(shards: int):
    return F.pmod("h", F.lit(shards)).cast("int")


def count_refs(refs: DataFrame) -> DataFrame:
    """(h, g, refs, low, high): combined before the shuffle, so that a line that all documents hold is no hot group."""
    return refs.groupBy("h", "g").agg(F.count("*").alias("refs"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))


def build_filters(shared: DataFrame, shards: int) -> DataFrame:
    """(shard, load, filter) from the shared keys; load: their references."""

    def run(table: pa.Table) -> pa.Table:
        made = CuckooFilter.of(table["h"].to_numpy().view(np.uint64))
        return pa.table({"shard": table["shard"][:1], "load": pa.array([int(table["refs"].to_numpy().sum())], pa.int64()), "filter": pa.array([made.to_bytes()], pa.binary())})

    return shared.select(shard_of(shards).alias("shard"), "h", "refs").groupBy("shard").applyInArrow(run, "shard int, load long, filter binary")


def probe(refs: DataFrame, filters: DataFrame, shards: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """(h, g, doc_id) of the lines that the filters (shard, load, filter) may hold.

    Each task gets a shard's filter and then, in the same sorted stream, the
    lines to be looked up in it, so it holds one filter and one batch of lines.
    Shards of a heavy load are dealt over several tasks, which all get the
    filter. The loads, a row for each shard, are broadcast.
    """
    mean = filters.agg(F.avg("load").alias("mean")).first()["mean"] or 0
    salts = F.greatest(F.lit(1), F.ceil(F.col("load") / max(task_rows, int(2 * mean)))).cast("int")
    sizes = filters.select("shard", salts.alias("salts"))
    columns = "shard int, salt int, tag int, h long, g long, doc_id long, filter binary"

    def run(batches):
        held, shard = None, None
        for b in batches:
            at, tags = b.column(0).to_numpy(), b.column(2).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (tags[1:] != tags[:-1]), [True]))) if len(at) else []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if tags[lo] == 0:
                    held, shard = CuckooFilter.from_bytes(b.column(6)[int(lo)].as_py()), at[lo]
                elif shard == at[lo]:
                    part = b.slice(lo, hi - lo)
                    maybe = np.flatnonzero(held.contains(part.column(3).to_numpy().view(np.uint64)))
                    if len(maybe):
                        yield pa.RecordBatch.from_arrays([part.column(i).take(pa.array(maybe)) for i in (3, 4, 5)], names=["h", "g", "doc_id"])

    # a shard without a filter shares nothing
    lines = refs.withColumn("shard", shard_of(shards)).join(F.broadcast(sizes), "shard")
    lines = lines.select("shard", F.pmod(F.xxhash64("doc_id"), "salts").cast("int").alias("salt"), F.lit(1).alias("tag"), "h", "g", "doc_id", F.lit(None).cast("binary").alias("filter"))
    null = F.lit(None).cast("long")
    every = filters.join(F.broadcast(sizes), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("tag"), null.alias("h"), null.alias("g"), null.alias("doc_id"), "filter")
    stream = lines.unionByName(every).repartition(partitions(refs.sparkSession), "shard", "salt").sortWithinPartitions("shard", "salt", "tag")
    return stream.select(*(x.split()[0] for x in columns.split(", "))).mapInArrow(run, "h long, g long, doc_id long")


def confirm(hits: DataFrame, shared: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(doc_id, h, g) of the hits that the exact table confirms and that aren't the owner's.

    Keys with a large part of all references are dealt over several tasks.
    """
    total = shared.agg(F.sum("refs").alias("refs")).first()["refs"] or 0
    met = join_split(hits, shared.select("h", "g", "low", "refs"), ["h", "g"], "refs", total, task_rows)
    return met.filter(F.col("doc_id") != F.col("low")).select("doc_id", "h", "g")


def drop_lines(docs: DataFrame, drops: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the columns kept_text, n_lines, n_dropped, by (doc_id, h, g) in drops. All columns of docs stay."""
    added = fresh(docs.columns, "kept_text", "n_lines", "n_dropped")
    drop_id, gone_keys = fresh(docs.columns, "_drop_id", "_dropped_keys")
    of_doc = drops.groupBy(F.col("doc_id").alias(drop_id)).agg(F.collect_list(F.struct("h", "g")).alias(gone_keys))
    joined = docs.join(of_doc.hint("shuffle_hash"), docs["doc_id"] == of_doc[drop_id], "left").drop(drop_id)
    at = joined.columns.index("text"), joined.columns.index(gone_keys)
    names, schema = [*docs.columns, *added], widened(docs, added, "string", "long", "long")

    def run(batches):
        for whole in batches:
            for b in in_slices(whole, at[0]):
                kept, lines, dropped = [], [], []
                gone_at = np.concatenate(([0], np.cumsum(pc.coalesce(pc.list_value_length(b.column(at[1])), 0).to_numpy()))).tolist()
                pairs = b.column(at[1]).flatten()
                gone_keys = np.stack([pairs.field(i).to_numpy() for i in (0, 1)], axis=1).astype("<i8").tobytes()
                for i, text in enumerate(b.column(at[0])):
                    gone = {gone_keys[16 * j : 16 * j + 16] for j in range(gone_at[i], gone_at[i + 1])}
                    parts = text.as_buffer().to_pybytes().split(b"\n") if text.is_valid else [b""]
                    lines.append(len(parts))
                    if gone:
                        parts = [x for x in parts if line_key(x, min_chars) not in gone]
                    dropped.append(lines[-1] - len(parts))
                    kept.append(b"\n".join(parts))
                arrays = [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return small_batches(joined).mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with kept_text, n_lines (before) and n_dropped, one row for each row of docs.

    Lines are parted by \\n (null or empty text: one empty line). A line's key
    is the line without `[\\x20\\x09-\\x0D]` at its ends and with A-Z lowered;
    keys of at least min_chars code points that two or more doc_ids hold lose
    all lines but those in the smallest doc_id. Rows that repeat a doc_id are
    one document; rows without doc_id neither hold nor lose lines. All other
    columns pass through; where docs has a column of a new one's name, the new
    one's is lengthened by underscores (common.fresh).
    """
    refs = line_refs(docs, min_chars)
    shared = cut(count_refs(refs).filter(F.col("low") != F.col("high")))
    shards = max(2 * partitions(docs.sparkSession), -(-shared.count() // SHARD_KEYS))
    filters = cut(build_filters(shared, shards))
    return drop_lines(docs, confirm(probe(refs, filters, shards), shared), min_chars)


class LineStore:
    """The state on disk, in a folder that all executors share (by default the checkpoint folder).

    - log (version, shard, h, g, doc_id, sign): the exact table, as the changes
      that made it; a document's references add up to one or nothing;
    - held (version, bucket, doc_id, keys): the keys of a document by its last
      version, so that it can be taken out by its doc_id;
    - filters (version, shard, filter): a shard's filter is that of its last version.

    add() and remove() append the next version: the changed documents' lines and the
    filters of the shards in which a key came to be shared or ceased to be.
    A version counts once its manifest is written, so a job that fails leaves the
    store as it was. A filter that is full is built anew from the exact table.
    Documents are (doc_id, text); rows without doc_id are left out, rows that
    repeat a doc_id are one document with the lines of all.
    """

    LOG = "h long, g long, doc_id long, sign int, version int, shard int"
    HELD = "doc_id long, keys array<struct<h: long, g: long>>, version int, bucket int"
    FILTERS = "load long, filter binary, version int, shard int"

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int = 64, min_chars: int = MIN_CHARS) -> None:
        self.spark, self.shards, self.min_chars, self.version = spark, shards, min_chars, 0
        self.path = path or f"{checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
        self.where: dict[int, int] = {}  # the version of each shard's filter

    @classmethod
    def open(cls, spark: SparkSession, path: str, shards: int = 64, min_chars: int = MIN_CHARS) -> LineStore:
        """The store in a folder, as its last complete version left it."""
        store = cls(spark, path, shards, min_chars)
        store.version = spark.read.parquet(f"{path}/manifest").agg(F.max("version")).first()[0]
        rows = spark.read.parquet(f"{path}/manifest").filter(F.col("version") == store.version).filter("shard >= 0").collect()
        store.where = {r["shard"]: r["written"] for r in rows}
        return store

    def _table(self, name: str, schema: str, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").filter(F.col("version") <= version)

    def _write(self, table: DataFrame, name: str, version: int, by: str) -> None:
        table.write.mode("overwrite").partitionBy(by).parquet(f"{self.path}/{name}/version={version}")

    def log(self, version: int | None = None) -> DataFrame:
        return self._table("log", self.LOG, self.version if version is None else version)

    def filters(self) -> DataFrame:
        """(shard, load, filter) of all shards that have one."""
        paths = [f"{self.path}/filters/version={v}/shard={s}" for s, v in sorted(self.where.items())]
        if not paths:
            return self.spark.createDataFrame([], "shard int, load long, filter binary")
        found = self.spark.read.schema(self.FILTERS).option("basePath", f"{self.path}/filters").parquet(*paths)
        return found.select("shard", "load", "filter")

    def counts(self, log: DataFrame | None = None) -> DataFrame:
        """(h, g, refs, low, high), the exact table; of part of the log, if given."""
        log = self.log() if log is None else log
        return count_refs(log.groupBy("h", "g", "doc_id").agg(F.sum("sign").alias("n")).filter("n > 0"))

    def add(self, docs: DataFrame) -> None:
        """Insert documents; one whose doc_id is there already is replaced."""
        new = line_refs(docs, self.min_chars).distinct()
        self._change(docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct(), new)

    def remove(self, doc_ids: DataFrame) -> None:
        """Take documents (doc_id) out; ones that aren't there are without effect."""
        self._change(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct(), self.spark.createDataFrame([], "h long, g long, doc_id long"))

    def _change(self, ids: DataFrame, new: DataFrame) -> None:
        version = self.version + 1
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.shards)).cast("int")
        ids, new = cut(ids.withColumn("bucket", bucket)), cut(new)
        buckets = [r["bucket"] for r in ids.select("bucket").distinct().collect()]  # no more than shards
        before = self._table("held", self.HELD, self.version).filter(F.col("bucket").isin(buckets)).join(ids.select("doc_id"), "doc_id", "left_semi")
        last = before.groupBy("doc_id").agg(F.max_by("keys", "version").alias("keys")).select("doc_id", F.explode("keys").alias("k")).select("k.h", "k.g", "doc_id")
        signed = new.withColumn("sign", F.lit(1)).unionByName(last.withColumn("sign", F.lit(-1)))
        delta = cut(signed.groupBy("h", "g", "doc_id").agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0").withColumn("shard", shard_of(self.shards)))
        self._write(delta, "log", version, "shard")
        keys = new.groupBy("doc_id").agg(F.collect_list(F.struct("h", "g")).alias("keys"))
        self._write(ids.join(keys, "doc_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<struct<h: long, g: long>>"))), "held", version, "bucket")
        touched = [r["shard"] for r in delta.select("shard").distinct().collect()]
        changes = cut(self._crossings(delta, touched, version)) if touched else None
        written = [r["shard"] for r in changes.select("shard").distinct().collect()] if touched else []
        if written:
            self._write(self._updated(changes, written, version), "filters", version, "shard")
        where = self.where | dict.fromkeys(written, version)
        rows = [(-1, version), *sorted(where.items())]
        self.spark.createDataFrame(rows, "shard int, written int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        self.version, self.where = version, where

    def _crossings(self, delta: DataFrame, touched: list[int], version: int) -> DataFrame:
        """(shard, h, sign, load): the keys that come to be shared (1) or cease to be (-1) with this version; load: their references after it."""
        keys = delta.select("h", "g").distinct()
        log = self.log(version).filter(F.col("shard").isin(touched)).join(keys, ["h", "g"], "left_semi")
        old = F.sum(F.when(F.col("version") < version, F.col("sign")).otherwise(0))
        of_doc = log.groupBy("shard", "h", "g", "doc_id").agg(old.alias("old"), F.sum("sign").alias("now"))
        of_key = of_doc.groupBy("shard", "h", "g").agg(F.count_if(F.col("old") > 0).alias("old"), F.count_if(F.col("now") > 0).alias("now"))
        was, is_now = (F.col("old") > 1).cast("int"), (F.col("now") > 1).cast("int")
        return of_key.select("shard", "h", (is_now - was).alias("sign"), (F.col("now") * is_now - F.col("old") * was).alias("load")).filter("sign <> 0 OR load <> 0")

    def _updated(self, changes: DataFrame, written: list[int], version: int) -> DataFrame:
        """(shard, load, filter) of the written shards: keys are deleted from and inserted into their filters."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.table({"shard": pa.array([], pa.int32()), "load": pa.array([], pa.int64()), "filter": pa.array([], pa.binary())})
            h, sign = left["h"].to_numpy().view(np.uint64), left["sign"].to_numpy()
            had = CuckooFilter.from_bytes(right["filter"][0].as_py()) if right.num_rows else CuckooFilter()
            had.remove(h[sign < 0])
            load = int(left["load"].to_numpy().sum()) + (right["load"][0].as_py() if right.num_rows else 0)
            made = pa.array([had.to_bytes() if had.insert(h[sign > 0]) else None], pa.binary())
            return pa.table({"shard": left["shard"][:1], "load": pa.array([load], pa.int64()), "filter": made})

        old = self.filters().filter(F.col("shard").isin(written))
        made = cut(changes.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(run, "shard int, load long, filter binary"))
        full = [r["shard"] for r in made.filter("filter IS NULL").select("shard").collect()]
        if not full:
            return made
        shared = self.counts(self.log(version).filter(F.col("shard").isin(full))).filter(F.col("low") != F.col("high"))
        return made.filter("filter IS NOT NULL").unionByName(build_filters(shared, self.shards))

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs as dedup_lines() gives them, by the store's state."""
        hits = cut(probe(line_refs(docs, self.min_chars), self.filters(), self.shards))
        log = self.log().join(hits.select("h", "g").distinct(), ["h", "g"], "left_semi")
        shared = cut(self.counts(log).filter(F.col("low") != F.col("high")))
        return drop_lines(docs, confirm(hits, shared), self.min_chars)
