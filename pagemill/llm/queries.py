"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.pages import spread
from . import ann, bpe, fingerprints, html_extract, langid, licenses, linededup, mixing, sharding, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents for operators that work long on each text; a small table is dealt out over all cores."""
    return spread(documents(spark, sf_dir).select("doc_id", "text", "lang"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of every document and of its edited text."""
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, by extendible hashing to 1 MiB of text."""
    return sharding.shard(documents(spark, sf_dir))


SQL["op2_sharding"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS bits FROM documents
), b(depth, cell, shard_bytes, low, high) AS (
  SELECT 0, 0::BIGINT, sum(n_bytes)::BIGINT, min(bits), max(bits) FROM d HAVING count(*) > 0
  UNION ALL
  SELECT * FROM (
    SELECT b.depth + 1 AS depth, (d.bits >> (59 - b.depth)) AS cell, sum(d.n_bytes)::BIGINT AS shard_bytes, min(d.bits) AS low, max(d.bits) AS high
    FROM b JOIN d ON (d.bits >> (60 - b.depth)) = b.cell WHERE b.shard_bytes > 1048576 AND b.low < b.high GROUP BY 1, 2) x
)
SELECT d.doc_id, d.n_bytes,
       CASE WHEN b.depth = 0 THEN '' ELSE lpad(ltrim(bin(b.cell), '0'), b.depth, '0') END AS shard,
       b.depth::INTEGER AS depth, 0::INTEGER AS part, b.shard_bytes
FROM d JOIN b ON (d.bits >> (60 - b.depth)) = b.cell WHERE b.shard_bytes <= 1048576 OR b.low = b.high
"""


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = spread_documents(spark, sf_dir)
    model = langid.train(docs.filter(~langid.held_out()))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "n_spans", "known")


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate components of all documents."""
    return simhash.near_duplicates(spread_documents(spark, sf_dir).select("doc_id", "text"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup keeps of every document."""
    out = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op5_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), owners AS (
  SELECT k, min(doc_id) AS low FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) <> max(doc_id)
), marked AS (
  SELECT doc_id, i, line, low IS NOT NULL AND low <> doc_id AS gone FROM keyed LEFT JOIN owners USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the public word-level BPE vocabulary."""
    out = bpe.encode_documents(spread_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mix by target weights takes of every document."""
    out = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


SQL["op6_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER) AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), o AS (
  SELECT level AS open FROM l WHERE cap >= level * weight ORDER BY place LIMIT 1
), t AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT open FROM o) * weight), cap) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM e
"""


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every document."""
    return licenses.scan(spread_documents(spark, sf_dir).select("doc_id", "text"))


_POSTINGS = ", ".join(f"({t}, '{label}', {base}, '{word}', {place}, {rare}, {key})" for t, label, base, word, place, rare, key in licenses.posting_rows())


def _phrase_sql(label: str, phrase: str) -> str:
    words = phrase.split()
    joins = " ".join(f"JOIN w w{i} ON w{i}.doc_id = w0.doc_id AND w{i}.pos = w0.pos + {i} AND w{i}.word = '{x}'" for i, x in enumerate(words) if i)
    return f"SELECT w0.doc_id, w0.pos, '{label}' AS label FROM w w0 {joins} WHERE w0.word = '{words[0]}'"


SQL["op7_licenses"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents
), p(template, label, base, word, place, rare, is_key) AS (VALUES {_POSTINGS}
), w AS (
  SELECT doc_id, word, pos FROM (SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS pos FROM d) WHERE word IN (SELECT word FROM p)
), phrases AS (
  {" UNION ALL ".join(_phrase_sql(label, phrase) for label, phrase in licenses.PHRASES)}
), n AS (SELECT count(*)::DOUBLE AS n FROM d
), idf AS (
  SELECT word, ln(1 + n / greatest(df, 1)) AS weight FROM (SELECT p.word, count(DISTINCT w.doc_id) AS df FROM p LEFT JOIN w USING (word) WHERE rare GROUP BY 1), n
), posted AS (
  SELECT template, label, word, place, weight FROM p JOIN idf USING (word) WHERE rare AND NOT base
  QUALIFY row_number() OVER (PARTITION BY template ORDER BY weight DESC, word, place) <= {licenses.POSTED}
), whole AS (
  SELECT template, sum(weight) AS total FROM posted GROUP BY 1
), placed AS (
  SELECT w.doc_id, template, any_value(label) AS label, pos - place AS shift, sum(weight) AS got FROM w JOIN posted USING (word) GROUP BY w.doc_id, template, pos - place
), likely AS (
  SELECT *, least(got / total, 1.0) AS support FROM placed JOIN whole USING (template) WHERE got / total >= {licenses.COVER}
), need AS (SELECT template, count(*) AS need FROM p WHERE is_key GROUP BY 1
), sure AS (
  SELECT doc_id, label, support FROM (
    SELECT l.doc_id, l.template, l.label, l.shift, l.support, count(*) AS have FROM likely l JOIN p k ON k.template = l.template AND k.is_key
    JOIN w ON w.doc_id = l.doc_id AND w.word = k.word AND w.pos = l.shift + k.place GROUP BY 1, 2, 3, 4, 5) JOIN need USING (template) WHERE have = need
), found AS (
  SELECT doc_id, label, 1.0 AS support, pos FROM phrases UNION ALL SELECT doc_id, label, support, NULL FROM sure
), by_doc AS (
  SELECT doc_id, count(pos) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT CASE WHEN pos IS NOT NULL THEN label END, ',' ORDER BY CASE WHEN pos IS NOT NULL THEN label END) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(support) AS support FROM found GROUP BY 1
)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(support, 0), 6)::DOUBLE AS score
FROM d LEFT JOIN by_doc USING (doc_id)
"""


@query
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), "n_chars")


@query
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose vec_id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)
