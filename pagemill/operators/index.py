"""The index on disk: tables, identity, freshness, expiry and publishing.

A build appends a folder of its own to each table and only then tells the log, so
readers see a document as it was or as it is. Documents that are fresh aren't
built again, and no build copies what others have written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, RetrievalConfig
from ..schema import SCHEMA_VERSION
from . import chunking, lexical

KEYS = ["doc_id", "passage_id"]


def meta_rows(files: DataFrame, passages: DataFrame, pages: DataFrame, model: str, extractor: str, dim: int, built_at: float, outline: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, value): the ten properties of each document's index, as text."""
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages")).join(passages.groupBy("doc_id").agg(F.count("*").alias("n_passages")), "doc_id", "left")
    row = files.join(n, "doc_id", "left").fillna(0, ["n_pages", "n_passages"])
    row = row.join(outline, "doc_id", "left") if outline is not None else row.withColumn("outline", F.array().cast("array<string>"))
    titles = F.to_json(F.coalesce("outline", F.array().cast("array<string>")))
    values = {"schema_version": F.lit(SCHEMA_VERSION), "model": F.lit(model), "extractor": F.lit(extractor), "dim": F.lit(dim), "pdf_size": F.col("size"), "pdf_mtime_ns": F.col("mtime_ns"), "n_pages": F.col("n_pages"), "n_passages": F.col("n_passages"), "outline": titles, "built_at": F.lit(built_at)}
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()))
    return row.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.key", "p.value")


def meta_map(rows: DataFrame) -> DataFrame:
    """(doc_id, meta map<string,string>)."""
    return rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("meta"))


def expired(meta: Column, now: float, config: RetrievalConfig = DEFAULT) -> Column:
    """Older than the index's time to live; not if the time is missing or no number, nor if the limit is 0 or less."""
    if config.index_ttl_days <= 0:
        return F.lit(False)
    built = F.element_at(meta, "built_at").try_cast("double")
    return F.coalesce(F.lit(now) - built > config.index_ttl_days * 86400, F.lit(False))


def fresh(meta: Column, size: Column, mtime_ns: Column, now: float, model: str, extractor: str, config: RetrievalConfig = DEFAULT) -> Column:
    """Whether an index is of this schema, model and extractor, not expired, and of a file with this size and time."""
    at = lambda k: F.element_at(meta, k)
    same = (at("schema_version").try_cast("int") == SCHEMA_VERSION) & (at("model") == model) & (at("extractor") == extractor)
    file = (at("pdf_size").try_cast("long") == size) & (at("pdf_mtime_ns").try_cast("long") == mtime_ns)
    return F.coalesce(same & file & ~expired(meta, now, config), F.lit(False))


def to_build(files: DataFrame, metas: DataFrame, now: float, model: str, extractor: str, force: bool = False, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """Files (doc_id, size, mtime_ns, ...) whose index is missing or not fresh; all if forced."""
    if force:
        return files
    good = files.join(metas, "doc_id").filter(fresh(F.col("meta"), F.col("size"), F.col("mtime_ns"), now, model, extractor, config))
    return files.join(good.select("doc_id"), "doc_id", "left_anti")


class Index:
    """An index folder: pages, passages (with vectors, if there is a provider), postings and meta.

    A build appends its documents to every table, in a folder of its own, and then
    tells in the log which build each of them is of; a cleared document is of none.
    So a build costs what its documents cost, and readers, who take a document's
    last entry, see it as it was or as it is. compact() drops what is replaced.
    """

    TABLES = ("pages", "passages", "postings", "meta")
    #: Builds are pruned by name up to this many; beyond, the join with the log alone tells.
    PRUNED = 1000

    def __init__(self, spark: SparkSession, path: str, config: RetrievalConfig = DEFAULT) -> None:
        self.spark, self.path, self.config = spark, path.rstrip("/"), config

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/log")
        except Exception as e:  # no index yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def current(self) -> DataFrame | None:
        """(doc_id, build) of the documents that the index holds."""
        log = self._log()
        if log is None:
            return None
        return log.groupBy("doc_id").agg(F.max_by("build", "seq").alias("build")).filter(F.col("build").isNotNull())

    def table(self, name: str, docs: DataFrame | None = None) -> DataFrame | None:
        """A table of the documents that the index holds; of docs (doc_id) only, if given."""
        live = self.current()
        if live is None:
            return None
        live = live.join(docs.select("doc_id").distinct(), "doc_id", "left_semi") if docs is not None else live
        builds = [r["build"] for r in live.select("build").distinct().limit(self.PRUNED + 1).collect()]
        every = self.spark.read.parquet(f"{self.path}/{name}")
        if len(builds) <= self.PRUNED:
            every = every.filter(F.col("build").isin(builds))
        return every.join(lexical.small(live), ["doc_id", "build"], "left_semi").drop("build")

    def _append_log(self, rows: DataFrame) -> None:
        log = self._log()
        seq = (log.agg(F.max("seq").alias("s")).first()["s"] or 0) + 1 if log is not None else 1
        rows.select("doc_id", "build").withColumn("seq", F.lit(seq).cast("long")).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def build(self, files: DataFrame, pages: DataFrame, now: float, provider=None, extractor: str = "table", dim: int = 0, force: bool = False) -> int:
        """Build what isn't fresh of files (doc_id, size, mtime_ns), keep the rest, publish. Returns the number of documents built."""
        model = provider.name if provider else "none"
        old = self.table("meta", files)
        wanted = to_build(files, meta_map(old), now, model, extractor, force, self.config) if old is not None else files
        wanted = wanted.select("doc_id", "size", "mtime_ns").persist()
        try:
            n = wanted.count()
            if not n:
                return 0
            build = uuid.uuid4().hex
            new_pages = pages.join(lexical.small(wanted.select("doc_id")), "doc_id", "left_semi")
            passages = chunking.passages(new_pages, self.config)
            vectors = provider.vectors(passages) if provider else passages.withColumn("vec", F.lit(None).cast("array<float>"))
            self._write(new_pages, "pages", build)
            self._write(vectors, "passages", build)
            stored = self.spark.read.parquet(f"{self.path}/passages/build={build}")
            self._write(lexical.postings(stored, KEYS, stemmed=False), "postings", build)
            self._write(meta_rows(wanted, stored, new_pages, model, extractor, dim, now), "meta", build)
            self._append_log(wanted.withColumn("build", F.lit(build)))
            return n
        finally:
            wanted.unpersist()

    def _write(self, rows: DataFrame, name: str, build: str) -> None:
        rows.write.parquet(f"{self.path}/{name}/build={build}")

    def clear(self, now: float, expired_only: bool = False) -> int:
        """Drop all documents, or those whose index has expired. Returns how many went."""
        meta = self.table("meta")
        if meta is None:
            return 0
        gone = meta_map(meta).filter(expired(F.col("meta"), now, self.config) if expired_only else F.lit(True)).select("doc_id").persist()
        try:
            n = gone.count()
            if n:
                self._append_log(gone.withColumn("build", F.lit(None).cast("string")))
            return n
        finally:
            gone.unpersist()

    def compact(self) -> None:
        """Write what the index holds as one build. Folders of earlier builds are no longer read, and may be deleted once no reader is left."""
        live = self.current()
        if live is None:
            return
        build = uuid.uuid4().hex
        live = live.select("doc_id").persist()
        try:
            for name in self.TABLES:
                self._write(self.table(name), name, build)
            self._append_log(live.withColumn("build", F.lit(build)))
        finally:
            live.unpersist()
