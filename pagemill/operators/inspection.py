"""Looking at documents: inventories, phrase search, page ranges, blocks, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, RetrievalConfig
from ..functions import text as T


def page_info(pages: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(doc_id, page, length, low, n_pages) of the pages to show: all of documents of up to 60 pages, else those of little text."""
    from pyspark.sql import Window as W

    every = pages.select("doc_id", "page", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("length"))
    every = every.withColumn("low", F.col("length") < config.low_text).withColumn("n_pages", F.count("*").over(W.partitionBy("doc_id")))
    return every.filter((F.col("n_pages") <= 60) | F.col("low"))


def low_text_pages(pages: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(doc_id, n, pages): pages that may be scans."""
    low = pages.filter(F.length(F.coalesce("text", F.lit(""))) < config.low_text)
    return low.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("page")), lambda p: p.cast("string")), ",").alias("pages"))


def phrase_search(pages: DataFrame, phrase: str, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(doc_id, page, context): pages with the phrase, case ignored, and the text around its first place."""
    at = F.locate(phrase.lower(), F.lower("text"))
    begin = F.greatest(at - config.context_chars, F.lit(1))
    around = F.substring("text", begin, at + len(phrase) + config.context_chars - begin)
    return pages.withColumn("_at", at).filter(F.col("_at") > 0).select("doc_id", "page", T.collapsed(around).alias("context"))


def page_block(page: Column, text: Column, tag: str = "") -> Column:
    return F.concat(F.lit("----- [page "), page.cast("string"), F.lit(f"]{tag} -----\n"), T.stripped(text))


def joined(rows: DataFrame, keys: list[str], order: str, block: Column, separator: str, name: str) -> DataFrame:
    """(*keys, name): each group's blocks in order; a group is one document's pages or fewer."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))), lambda x: x["b"]), separator)
    return rows.groupBy(*keys).agg(text.alias(name))


def range_text(pages: DataFrame, spec: str) -> DataFrame:
    """(doc_id, text): each document's pages of a range like '12-14,17', in the range's order, repeats kept."""
    last = pages.groupBy("doc_id").agg(F.max("page").alias("n"))
    wanted = last.select("doc_id", F.posexplode(T.parsed_pages(F.lit(spec), F.col("n").cast("int"))).alias("pos", "page"))
    met = wanted.join(pages, ["doc_id", "page"])
    return joined(met, ["doc_id"], "pos", page_block(F.col("page"), F.col("text")), "\n\n", "text")


def map_blocks(pages: DataFrame, n: int = DEFAULT.map_block) -> DataFrame:
    """(doc_id, block, name, text): n pages each, for separate work on every block."""
    block = (F.floor((F.col("page") - 1) / n) + 1).cast("long")
    rows = pages.withColumn("block", block)
    out = joined(rows, ["doc_id", "block"], "page", page_block(F.col("page"), F.col("text")), "\n\n", "text")
    bounds = rows.groupBy("doc_id", "block").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    name = F.concat(F.lit("chunk"), F.lpad(F.col("block").cast("string"), 3, "0"), F.lit("_p"), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"), F.lit(".txt"))
    return out.join(bounds, ["doc_id", "block"]).select("doc_id", "block", name.alias("name"), "text")


def full_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the pages joined by line ends."""
    return joined(pages, ["doc_id"], "page", F.col("text"), "\n", "text")


def table_rows(pages: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, row_no, cells): runs of lines with cells between bars.

    A table is a run of neighbouring lines that have a bar; all within the page's row.
    """
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("i", "line"), F.split("text", "\n").alias("lines"))
    has = lambda x: F.contains(x, F.lit("|"))
    starts = F.filter(F.transform("lines", lambda x, i: F.when(has(x) & ((i == 0) | ~has(F.coalesce(F.get("lines", i - 1), F.lit("")))), i)), lambda i: i.isNotNull())
    rows = lines.filter(has(F.col("line"))).withColumn("_s", F.filter(starts, lambda i: i <= F.col("i")))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return rows.select("doc_id", "page", F.size("_s").cast("long").alias("table_no"), (F.col("i") - F.array_max("_s") + 1).cast("long").alias("row_no"), F.array_join(cells, "\t").alias("cells"))
