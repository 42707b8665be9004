"""Pages (doc_id, page, text) from tables, text, HTML and PDF; gold questions; file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, RetrievalConfig
from ..schema import GOLD


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than twice the cores, dealt out evenly: a small table is one row group, which keeps one core busy. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def pages_of_lines(docs: DataFrame, lines: int = 5) -> DataFrame:
    """Pages of so many lines each from docs (doc_id, text); a null text is one empty page. No shuffle."""
    every = F.split(F.coalesce("text", F.lit("")), "\n")
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / lines).cast("int")), lambda i: F.array_join(F.slice("_l", i * lines + 1, F.lit(lines)), "\n"))
    cut = docs.select("doc_id", every.alias("_l")).select("doc_id", F.posexplode(pages).alias("page", "text"))
    return cut.select("doc_id", (F.col("page") + 1).cast("long").alias("page"), "text")


def pages_of_turns(conversations: DataFrame) -> DataFrame:
    """Pages from conversations (conv_id, turn, text): one page for a turn, the first is 1."""
    return conversations.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("long").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def files_of_html(pages: DataFrame) -> DataFrame:
    """(path, name, parent, size, mtime_ns, title, author, subject) from web pages (page_id, url, html): a name from the title, the host as author."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    out = pages.select("page_id", F.concat(F.lit("/files/"), (F.col("page_id") % 7).cast("string")).alias("parent"), F.concat(slug, F.lit(".pdf")).alias("name"), F.length("html").cast("long").alias("size"),
                       title.alias("title"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("author"), F.lit("").alias("subject"))
    mtime = (F.lit(1_700_000_000).cast("long") + F.col("page_id") * 3600) * 1_000_000_000
    return out.select(F.concat("parent", F.lit("/"), F.col("page_id").cast("string"), F.lit("/"), "name").alias("path"), "name", "parent", "size", mtime.alias("mtime_ns"), "title", "author", "subject", "page_id")


def pages_of_html(pages: DataFrame) -> DataFrame:
    """(page_id, page, text): one page for each paragraph end of the markup, its tags gone."""
    parts = pages.select("page_id", F.posexplode(F.split("html", "</p>")).alias("i", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>", " "), r"\s+", " "))
    return parts.select("page_id", (F.col("i") + 1).cast("long").alias("page"), text.alias("text"))


def gold_questions(spark: SparkSession, path: str) -> DataFrame:
    """(q, pages) from lines of JSON; blank lines and // comments are skipped."""
    lines = spark.read.text(path).filter(~F.trim("value").rlike("^(//|$)"))
    return lines.select(F.from_json("value", GOLD).alias("g")).select("g.q", "g.pages")


def question_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text) of a file with a question in each line."""
    return spark.read.text(path).select(F.trim("value").alias("text")).filter("text <> ''")


def scan_files(spark: SparkSession, roots: list[str], glob: str = "*.[pP][dD][fF]", config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(path, name, parent, size, mtime_ns) of files below the roots: no hidden folders, a bounded depth and number, contents not read."""
    found = None
    for root in dict.fromkeys(r.rstrip("/") for r in roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).drop("content")
        path = F.regexp_replace("path", "^file:/*(?=/)", "")
        inside = F.substring(path, F.lit(len(root) + 2), F.length(path))
        files = files.withColumn("inside", inside).withColumn("path", path).filter((F.size(F.split("inside", "/")) <= config.scan_depth + 1) & ~F.col("inside").rlike(r"(^|/)\.[^/]*/"))
        found = files if found is None else found.unionByName(files)
    out = found.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.regexp_replace("path", "/[^/]*$", "").alias("parent"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    return out.orderBy("path").limit(config.scan_files)


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, to be held against known sums."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
