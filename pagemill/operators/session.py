"""Catalog, lifetimes and the ledger of saved tokens, from logs of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, RetrievalConfig
from ..functions import text as T


def catalog(requests: DataFrame) -> DataFrame:
    """(session_id, doc_id, seq, ts, chunks) that a session has loaded after its log (seq, session_id, ts, op, doc_id, chunks).

    ingest replaces a document, clear with a doc_id drops it and those named so
    before a #, clear without one drops all. The last word on a document counts;
    a clear of all is compared as a time, so no log is collected.
    """
    full = requests.filter((F.col("op") == "clear") & F.col("doc_id").isNull()).groupBy("session_id").agg(F.max("seq").alias("_all"))
    plain = F.split_part("doc_id", F.lit("#"), F.lit(1))
    part = requests.filter((F.col("op") == "clear") & F.col("doc_id").isNotNull()).groupBy("session_id", F.col("doc_id").alias("_d")).agg(F.max("seq").alias("_part"))
    last = requests.filter(F.col("op") == "ingest").groupBy("session_id", "doc_id").agg(F.max_by(F.struct("seq", "ts", "chunks"), "seq").alias("r")).select("session_id", "doc_id", "r.*")
    met = last.withColumn("_p", plain).join(full, "session_id", "left")
    met = met.join(part.withColumnsRenamed({"_part": "_exact", "_d": "doc_id"}), ["session_id", "doc_id"], "left")
    met = met.join(part.withColumnsRenamed({"_part": "_base", "_d": "_p"}), ["session_id", "_p"], "left")
    gone = F.greatest(F.coalesce("_all", F.lit(-1)), F.coalesce("_exact", F.lit(-1)), F.coalesce("_base", F.lit(-1)))
    return met.filter(F.col("seq") > gone).select("session_id", "doc_id", "seq", "ts", "chunks")


def evicted(touched: DataFrame, now: Column, ttl_minutes: float = DEFAULT.ttl_minutes) -> DataFrame:
    """touched (..., ts) with evicted: idle for longer than the time to live (0 or less: never)."""
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return touched.withColumn("evicted", idle > int(ttl_minutes * 60_000_000) if ttl_minutes > 0 else F.lit(False))


def ttl_sessions(events: DataFrame, key: str, ttl_minutes: float = DEFAULT.ttl_minutes) -> DataFrame:
    """(key, begin, end, n): spans in which a key was never idle for longer than the time to live."""
    gap = F.session_window("ts", f"{int(ttl_minutes * 60)} seconds")
    return events.groupBy(gap.alias("w"), key).agg(F.min("ts").alias("begin"), F.max("ts").alias("end"), F.count("*").alias("n")).drop("w")


def saved(naive: Column, actual: Column) -> Column:
    return F.greatest(naive - actual, F.lit(0))


def percent(saved_: Column, naive: Column) -> Column:
    return F.when(naive > 0, F.floor(saved_ / naive * 100)).otherwise(0).cast("long")


def cost(saved_: Column, price: float = DEFAULT.price_per_million) -> Column:
    return saved_ / 1e6 * price


def ledger(searches: DataFrame, keys: list[str], config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(*keys, searches, chunks, actual_tokens, naive_tokens, saved_tokens, percent, cost) of answered searches (naive_tokens, actual_tokens, chunks)."""
    total = searches.groupBy(*keys).agg(
        F.count("*").alias("searches"), F.sum("chunks").cast("long").alias("chunks"), F.sum("actual_tokens").alias("actual_tokens"), F.sum("naive_tokens").alias("naive_tokens"),
        F.sum(saved(F.col("naive_tokens"), F.col("actual_tokens"))).alias("saved_tokens"),
    )
    return total.withColumn("percent", percent(F.col("saved_tokens"), F.col("naive_tokens"))).withColumn("cost", F.round(cost(F.col("saved_tokens"), config.price_per_million), 6))


def running_ledger(requests: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """Each search of a log (seq, session_id, op, doc_id, naive_tokens, actual_tokens, chunks) with the session's totals so far.

    A clear of everything starts a new epoch at zero; a clear of one document doesn't.
    """
    order = W.partitionBy("session_id").orderBy("seq")
    reset = ((F.col("op") == "clear") & F.col("doc_id").isNull()).cast("long")
    epochs = requests.withColumn("epoch", F.sum(reset).over(order))
    run = W.partitionBy("session_id", "epoch").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = epochs.filter(F.col("op") == "search")
    out = found.select(
        "session_id", "seq", "epoch", F.count("*").over(run).alias("searches"), F.sum("chunks").over(run).cast("long").alias("chunks"), F.sum("actual_tokens").over(run).alias("actual_tokens"),
        F.sum("naive_tokens").over(run).alias("naive_tokens"), F.sum(saved(F.col("naive_tokens"), F.col("actual_tokens"))).over(run).alias("saved_tokens"),
    )
    return out.withColumn("percent", percent(F.col("saved_tokens"), F.col("naive_tokens")))


def savings_text(totals: DataFrame, config: RetrievalConfig = DEFAULT) -> Column:
    """The totals in words."""
    number = lambda c: F.format_number(F.col(c), 0)
    return F.concat(
        F.lit("searches: "), number("searches"), F.lit(", chunks: "), number("chunks"), F.lit("; tokens sent ~"), number("actual_tokens"), F.lit(" of ~"), number("naive_tokens"),
        F.lit("; saved ~"), number("saved_tokens"), F.lit(" ("), F.col("percent").cast("string"), F.lit("%), ~$"), F.format_number(F.round(cost(F.col("saved_tokens"), config.price_per_million), 2), 2),
    )


def naive_tokens(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, naive_tokens): what all of a document's units cost."""
    return units.groupBy(key).agg(F.sum(T.count_tokens(F.coalesce("text", F.lit("")))).cast("long").alias("naive_tokens"))


def naive_tokens_of_passages(passages: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """naive_tokens() from overlapping passages, the overlap taken out."""
    factor = config.passage_words / max(1, config.passage_words - config.passage_overlap)
    return naive_tokens(passages).withColumn("naive_tokens", F.floor(F.col("naive_tokens") / factor).cast("long"))


def listed(files: DataFrame, loaded: DataFrame, now_ns: int, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(rank, name, parent, age, loaded): the newest files (path, name, parent, mtime_ns), with whether their path is loaded."""
    newest = files.orderBy(F.desc("mtime_ns"), "path").limit(config.list_files)
    marks = loaded.select("path").distinct().withColumn("loaded", F.lit(True))
    met = newest.join(marks, "path", "left").withColumn("loaded", F.coalesce("loaded", F.lit(False)))
    # no more rows than the list has
    met = met.withColumn("rank", F.row_number().over(W.orderBy(F.desc("mtime_ns"), "path")).cast("long"))
    return met.select("rank", "name", "parent", T.age_bucket((F.lit(now_ns) - F.col("mtime_ns")) / 1e9).alias("age"), "loaded")
