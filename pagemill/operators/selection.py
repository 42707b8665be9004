"""What is returned: dedup, neighbours, cross-references, anchors, trimming, budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, RetrievalConfig
from ..functions import text as T
from .lexical import SMALL_ROWS, local, small
from .semantic import dot


def dedup(ranked: DataFrame, threshold: float = DEFAULT.near_duplicate) -> DataFrame:
    """Rows of ranked (query_id, doc_id, page, rank, text, ...) that aren't near-duplicates of a better one kept before.

    Only rows of the same page are compared, so the fold runs within (query_id,
    doc_id, page), over what ranking left of it.
    """
    keys = ["query_id", "doc_id", "page"]
    rows = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", T.word_set(F.col("text")).alias("w")))).alias("rows"))
    like = lambda x: lambda y: T.jaccard(x["w"], y["w"]) > threshold
    none = F.filter("rows", lambda x: F.lit(False))
    kept = F.aggregate("rows", none, lambda acc, x: F.when(F.exists(acc, like(x)), acc).otherwise(F.concat(acc, F.array(x))))
    ranks = rows.select(*keys, F.explode(F.transform(kept, lambda x: x["rank"])).alias("rank"))
    return ranked.join(ranks, [*keys, "rank"], "left_semi")


def near_pages(hits: DataFrame, last_pages: DataFrame, n: int = DEFAULT.neighbors) -> DataFrame:
    """(query_id, doc_id, page): pages up to n away from a hit, the hits included, within 1..last_page."""
    around = hits.select("query_id", "doc_id", F.explode(F.sequence(F.col("page") - n, F.col("page") + n)).alias("page"))
    return around.join(last_pages, "doc_id").filter(F.col("page").between(1, F.col("last_page"))).select("query_id", "doc_id", "page").distinct()


def neighbor_suggestions(hits: DataFrame, last_pages: DataFrame, n: int = DEFAULT.neighbors) -> DataFrame:
    return near_pages(hits, last_pages, n).join(hits, ["query_id", "doc_id", "page"], "left_anti")


def last_pages(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.max("page").alias("last_page"))


def xref_pages(pages: DataFrame, hits: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(query_id, doc_id, ref, target): the pages that references on hit pages lead to.

    A whole number within the document is a page; any other reference leads
    to the first page that has it as a word near its beginning.
    """
    refs = pages.join(hits.select("query_id", "doc_id", "page").distinct(), ["doc_id", "page"]).select("query_id", "doc_id", F.explode(T.references(F.col("text"))).alias("ref")).distinct()
    with_last = refs.join(last_pages(pages), "doc_id")
    number = F.when(F.col("ref").rlike(r"^\d{1,9}$"), F.col("ref").cast("long"))
    is_page = F.coalesce(number.between(1, F.col("last_page")), F.lit(False))
    direct = with_last.filter(is_page).select("query_id", "doc_id", "ref", number.alias("target"))
    heads = pages.select("doc_id", "page", F.left("text", F.lit(config.xref_chars)).alias("head"))
    found = with_last.filter(~is_page).join(heads, "doc_id")
    found = found.filter(F.regexp_like("head", F.concat(F.lit(r"\b"), F.regexp_replace("ref", r"\.", r"\\."), F.lit(r"\b"))))
    return direct.unionByName(found.groupBy("query_id", "doc_id", "ref").agg(F.min("page").alias("target")))


def anchors(pages: DataFrame, outline: DataFrame | None = None, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(doc_id, rank, anchor): outline titles (doc_id, pos, title), then headings, each once, the first `anchors` of them."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line", T.stripped(F.col("line")))
    heads = lines.filter(F.col("line").rlike(T.HEADING) & (F.size(T.words(F.col("line"))) <= config.heading_words))
    found = heads.select("doc_id", F.struct(F.lit(1).alias("o"), F.col("page").cast("long").alias("p"), F.col("i").cast("long").alias("i")).alias("at"), F.col("line").alias("anchor"))
    if outline is not None:
        found = found.unionByName(outline.select("doc_id", F.struct(F.lit(0).alias("o"), F.lit(0).cast("long").alias("p"), F.col("pos").cast("long").alias("i")).alias("at"), F.col("title").alias("anchor")))
    first = found.groupBy("doc_id", "anchor").agg(F.min("at").alias("at"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy("at")).cast("long")).filter(F.col("rank") <= config.anchors).select("doc_id", "rank", "anchor")


def sentence_rows(chunks: DataFrame, keys: list[str], terms: DataFrame, config: RetrievalConfig = DEFAULT, provider=None, asked: list | None = None) -> DataFrame:
    """(*keys, idx, sentence, n_words, score) of chunks of more than trim_from_words words; keys include query_id.

    score: distinct terms (query_id, term) in the sentence. With a provider and the
    questions' vectors, the product of the sentence's vector and its question's instead.
    """
    long = chunks.filter(F.size(T.words(F.col("text"))) > config.trim_from_words)
    idx, n_words = F.col("idx").cast("long").alias("idx"), F.size(T.words(F.col("sentence"))).cast("long").alias("n_words")
    if provider is not None and asked is not None:
        every = long.select(*keys, F.posexplode(T.sentences(F.col("text"))).alias("idx", "text"))
        asked_ = local(chunks.sparkSession, asked, "query_id long, _q array<double>")
        met = provider.vectors(every).join(F.broadcast(asked_) if len(asked) <= SMALL_ROWS else asked_, "query_id", "left").withColumnRenamed("text", "sentence")
        return met.select(*keys, idx, "sentence", n_words, F.coalesce(F.round(dot(F.col("vec"), F.col("_q")), 6), F.lit(0.0)).alias("score"))
    words = terms.groupBy("query_id").agg(F.collect_set("term").alias("_terms"))
    every = long.join(small(words), "query_id", "left").select(*keys, "_terms", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))
    none = F.array().cast("array<string>")
    score = F.size(F.array_intersect(F.coalesce("_terms", none), F.array_distinct(T.tokens(F.col("sentence"))))).cast("double")
    return every.select(*keys, idx, "sentence", n_words, score.alias("score"))


def kept_sentences(rows: DataFrame, keys: list[str], config: RetrievalConfig = DEFAULT) -> DataFrame:
    """rows with `last` (the last sentence's idx) and `kept`.

    The best sentence counts always, the next ones if they score enough of it;
    each brings its neighbours. While these have too few words, sentences are
    added to the first run, to the left, then to the right. Windows over one
    chunk's sentences say all of it: a region's mean never beats its best
    sentence, so regions are single sentences.
    """
    chunk = W.partitionBy(*keys)
    by_idx = chunk.orderBy("idx")
    ranked = rows.withColumn("_r", F.row_number().over(chunk.orderBy(F.desc("score"), "idx"))).withColumn("_best", F.max("score").over(chunk)).withColumn("last", F.max("idx").over(chunk))
    core = (F.col("_r") == 1) | ((F.col("_r") <= config.trim_regions) & (F.col("_best") > 0) & (F.col("score") >= config.trim_second * F.col("_best")))
    ranked = ranked.withColumn("_core", core.cast("int"))
    base = F.greatest("_core", F.coalesce(F.lag("_core").over(by_idx), F.lit(0)), F.coalesce(F.lead("_core").over(by_idx), F.lit(0)))
    ranked = ranked.withColumn("_base", base).withColumn("_have", F.sum(F.col("n_words") * base).over(chunk)).withColumn("_first", F.min(F.when(base == 1, F.col("idx"))).over(chunk))
    left = F.col("idx") < F.col("_first")
    # order of growth: from the first run to the left end, then rightwards over what isn't in
    turn = F.when(left, F.col("_first") - F.col("idx")).otherwise(F.col("last") + F.col("idx") + 1)
    added = F.when(F.col("_base") == 1, 0).otherwise(F.col("n_words"))
    before = F.coalesce(F.sum(added).over(chunk.orderBy(F.col("_turn")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    grown = ranked.withColumn("_turn", turn).withColumn("_before", before)
    kept = (F.col("_base") == 1) | (F.col("_have") + F.col("_before") < config.trim_keep_words)
    return grown.withColumn("kept", kept).select(*keys, "idx", "sentence", "n_words", "score", "last", "kept")


def islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, lo, hi, last, text): runs of kept sentences."""
    order = W.partitionBy(*keys).orderBy("idx")
    runs = rows.filter("kept").withColumn("_g", F.col("idx") - F.row_number().over(order))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "sentence"))), lambda x: x["sentence"]), " ")
    return runs.groupBy(*keys, "last", "_g").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), text.alias("text")).drop("_g")


def joined_islands(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, trimmed): the runs joined, with … where something was cut."""
    per = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "text"))).alias("r"), F.max("last").alias("last"))
    body = F.array_join(F.transform("r", lambda x: x["text"]), " … ")
    head = F.when(F.get("r", F.lit(0))["lo"] > 0, "… ").otherwise("")
    tail = F.when(F.element_at("r", -1)["hi"] < F.col("last"), " …").otherwise("")
    return per.select(*keys, F.concat(head, body, tail).alias("trimmed"))


def trimmed(chunks: DataFrame, keys: list[str], terms: DataFrame, config: RetrievalConfig = DEFAULT, provider=None, asked: list | None = None) -> DataFrame:
    """chunks with out_text: the answering sentences of long chunks, short ones whole."""
    if not config.trim:
        return chunks.withColumn("out_text", F.col("text"))
    cut = joined_islands(islands(kept_sentences(sentence_rows(chunks, keys, terms, config, provider, asked), keys, config), keys), keys)
    return chunks.join(cut, keys, "left").withColumn("out_text", F.coalesce("trimmed", "text")).drop("trimmed")


def within_budget(blocks: DataFrame, chars: int = DEFAULT.response_chars) -> DataFrame:
    """Rows of blocks (query_id, rank, block) up to the budget; the first always."""
    order = W.partitionBy("query_id").orderBy("rank")
    run = F.sum(F.length("block")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return blocks.withColumn("used", run.cast("long")).withColumn("_n", F.row_number().over(order)).filter((F.col("_n") == 1) | (F.col("used") <= chars)).drop("_n")


def clamped(k: Column, config: RetrievalConfig = DEFAULT) -> Column:
    return F.greatest(F.lit(1), F.least(k, F.lit(config.most_k)))
