"""SQL for DuckDB: named parts that the registered queries' twins are put together from."""

from __future__ import annotations

import re

from .functions.text import HEADING, INSTRUCTION, RECENCY, RECENCY_WORDS, REFERENCE, REMOVED, STOP_WORDS

#: (query_id, text, vec_id, k): the questions of the registered queries; vec_id is the vector that stands for the question.
QUESTIONS = [
    (1, "worthless disgusting orantion", 0, 5),
    (2, "What does the pathetic idiot say about moron worthless worthless?", 1, 3),
    (3, "zzqxv unfindable", 2, 50),
]


def quoted(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::BIGINT"


def values(rows, names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) v({names})"


def stem(w: str) -> str:
    less = lambda n: f"left({w}, length({w}) - {n})"
    return (
        f"CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN {less(3)} || 'y' WHEN length({w}) >= 7 AND {w} LIKE '%ing' THEN {less(3)} "
        f"WHEN length({w}) >= 6 AND {w} LIKE '%ed' THEN {less(2)} WHEN length({w}) >= 5 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN {less(1)} ELSE {w} END"
    )


def raw(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def tokens(text: str) -> str:
    return f"list_transform({raw(text)}, lambda w: {stem('w')})"


STOP = "[" + ", ".join(map(quoted, STOP_WORDS)) + "]"
RECENT = "[" + ", ".join(map(quoted, RECENCY_WORDS)) + "]"


def terms(text: str) -> str:
    return f"list_filter({tokens(text)}, lambda t: length(t) > 2 AND NOT list_contains({STOP}, t))"


def sentences(text: str) -> str:
    parts = rf"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"
    all_words = rf"regexp_extract_all({text}, '\S+')"
    windows = f"list_transform(range(0, len({all_words}), 25), lambda i: array_to_string(list_slice({all_words}, i + 1, i + 25), ' '))"
    return f"CASE WHEN len({parts}) >= 2 THEN {parts} WHEN len({windows}) > 0 THEN {windows} ELSE [{text}] END"


def count_tokens(text: str) -> str:
    return f"greatest(1, length({text}) // 4)::BIGINT"


def stripped(text: str) -> str:
    return f"trim({text}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def jaccard(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) * 1.0::DOUBLE / greatest(1, len(list_distinct(list_concat({a}, {b})))))"


def word_set(text: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({text}), '\S+'))"


def age(seconds: str) -> str:
    return f"CASE WHEN {seconds} < 86400 THEN 'today' WHEN {seconds} < 172800 THEN 'yesterday' WHEN {seconds} < 604800 THEN floor({seconds} / 86400)::BIGINT || ' days ago' ELSE floor({seconds} / 604800)::BIGINT || ' wk ago' END"


def envelope(source: str, page: str, text: str) -> str:
    return f"'<document-chunk source=\"' || {source} || ' p' || {page} || '\">' || chr(10) || {stripped(text)} || chr(10) || '</document-chunk>'"


def name_stem(name: str) -> str:
    return rf"regexp_replace(regexp_replace({name}, '^.*/', ''), '(.)\.[^.]*$', '\1')"


def bm25(keys: str, tf: str, sizes: str, stats: str) -> str:
    return f"""SELECT query_id, {keys}, round(sum(m * ln(1 + (n - m * df + 0.5) / (m * df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / av))), 6) AS score
      FROM {tf} JOIN (SELECT term, count(*) AS df FROM {tf} GROUP BY term) USING (term) JOIN qt USING (term) JOIN {sizes} USING ({keys}), {stats} GROUP BY ALL"""


PARTS = {
    "q": values(QUESTIONS, "query_id, text, vec_id, k"),
    "qt": f"SELECT query_id, term, count(*) AS m FROM (SELECT query_id, unnest({terms('text')}) AS term FROM q) GROUP BY ALL",
    "pages_": "SELECT doc_id, (i // 5 + 1)::BIGINT AS page, string_agg(line, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) GROUP BY 1, 2",
    "page_words": r"SELECT doc_id, page, regexp_extract_all(text, '\S+') AS w FROM pages_",
    "passages_": "SELECT doc_id, page * 100000 + s // 140 + 1 AS passage_id, page, (s // 140 + 1)::BIGINT AS passage_no, s::BIGINT AS start_word, array_to_string(list_slice(w, s + 1, s + 180), ' ') AS text FROM (SELECT *, unnest(range(0, len(w), 140)) AS s FROM page_words) WHERE s = 0 OR len(w) - s > 40",
    "ptok": f"SELECT doc_id, page, passage_id, unnest({tokens('text')}) AS term FROM passages_",
    "praw": f"SELECT doc_id, page, passage_id, unnest({raw('text')}) AS token FROM passages_",
    "plen": f"SELECT doc_id, page, passage_id, len({raw('text')}) AS dl FROM passages_",
    "pstat": "SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS av FROM plen",
    "ptf": "SELECT doc_id, page, passage_id, term, count(*) AS tf FROM ptok WHERE term IN (SELECT term FROM qt) GROUP BY ALL",
    "kw": "SELECT query_id, doc_id, page, passage_id, score AS kw FROM (" + bm25("doc_id, page, passage_id", "ptf", "plen", "pstat") + ")",
    "gtok": f"SELECT doc_id, page, unnest({tokens('text')}) AS term FROM pages_",
    "glen": f"SELECT doc_id, page, len({raw('text')}) AS dl FROM pages_",
    "gstat": "SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS av FROM glen",
    "gtf": "SELECT doc_id, page, term, count(*) AS tf FROM gtok WHERE term IN (SELECT term FROM qt) GROUP BY ALL",
    "page_kw": bm25("doc_id, page", "gtf", "glen", "gstat"),
    "xtf": "SELECT doc_id, page, passage_id, term, count(*) AS tf FROM praw JOIN (SELECT DISTINCT term FROM qt) t ON starts_with(token, term) GROUP BY ALL",
    "xkw": """SELECT query_id, doc_id, page, passage_id, round(sum(m * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS kw
      FROM xtf JOIN (SELECT term, count(*) AS df FROM xtf GROUP BY term) USING (term) JOIN qt USING (term) JOIN plen USING (doc_id, page, passage_id), pstat GROUP BY ALL""",
    "sem": "SELECT q.query_id, e.vec_id AS doc_id, round(greatest(list_inner_product(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 0), 6) AS sem FROM embeddings e, q JOIN embeddings v ON v.vec_id = q.vec_id",
    "dense": "SELECT q.query_id, p.doc_id, p.page, p.passage_id, coalesce(kw.kw, 0)::DOUBLE AS kw, coalesce(sem.sem, 0)::DOUBLE AS sem FROM passages_ p CROSS JOIN q LEFT JOIN kw ON kw.query_id = q.query_id AND kw.doc_id = p.doc_id AND kw.passage_id = p.passage_id LEFT JOIN sem ON sem.query_id = q.query_id AND sem.doc_id = p.doc_id",
    "xdense": "SELECT q.query_id, p.doc_id, p.page, p.passage_id, coalesce(xkw.kw, 0)::DOUBLE AS kw, coalesce(sem.sem, 0)::DOUBLE AS sem FROM passages_ p CROSS JOIN q LEFT JOIN xkw ON xkw.query_id = q.query_id AND xkw.doc_id = p.doc_id AND xkw.passage_id = p.passage_id LEFT JOIN sem ON sem.query_id = q.query_id AND sem.doc_id = p.doc_id",
}
NORM = """SELECT *, CASE WHEN max(kw) OVER w <= min(kw) OVER w THEN CASE WHEN kw > 0 THEN 1.0 ELSE 0.0 END ELSE (kw - min(kw) OVER w) / (max(kw) OVER w - min(kw) OVER w) END::DOUBLE AS kw_norm,
      CASE WHEN max(sem) OVER w <= min(sem) OVER w THEN CASE WHEN sem > 0 THEN 1.0 ELSE 0.0 END ELSE (sem - min(sem) OVER w) / (max(sem) OVER w - min(sem) OVER w) END::DOUBLE AS sem_norm FROM {} WINDOW w AS (PARTITION BY query_id)"""
SCORE = "SELECT *, (sem >= 0.25 OR kw > 0) AS eligible, CASE WHEN sem >= 0.25 OR kw > 0 THEN round(0.4 * kw_norm + 0.6 * sem_norm, 6) ELSE 0 END::DOUBLE AS score FROM {}"
PARTS |= {
    "norm": NORM.format("dense"),
    "scored": SCORE.format("norm"),
    "xnorm": NORM.format("xdense"),
    "xscored": SCORE.format("xnorm"),
    "ranked": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC, passage_id DESC) AS rank FROM scored WHERE score > 0",
    "xpage_scores": "SELECT query_id, doc_id, page, max(score) AS score FROM xscored GROUP BY ALL HAVING max(score) > 0",
    "xtop": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page) AS rank FROM xpage_scores) WHERE rank <= 5",
    "page_top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page) AS rank FROM page_kw WHERE score > 0) WHERE rank <= 5",
    "last_page": "SELECT doc_id, max(page) AS last_page FROM pages_ GROUP BY doc_id",
    "near": "SELECT DISTINCT t.query_id, t.doc_id, t.page + d.d AS page FROM page_top t CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d) d JOIN last_page USING (doc_id) WHERE t.page + d.d BETWEEN 1 AND last_page",
    "files_": r"SELECT '/files/' || (page_id % 7) || '/' || page_id || '/' || slug || '.pdf' AS path, slug || '.pdf' AS name, '/files/' || (page_id % 7) AS parent, length(html)::BIGINT AS size, (1700000000 + page_id * 3600) * 1000000000 AS mtime_ns, title, author, '' AS subject, page_id FROM (SELECT *, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM (SELECT page_id, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS author FROM pages))",
    "file_pages": r"SELECT page_id, i + 1 AS page, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM (SELECT page_id, unnest(l) AS raw, unnest(range(len(l))) AS i FROM (SELECT page_id, string_split(html, '</p>') AS l FROM pages))",
    "probes": r"SELECT path, left(trim(array_to_string(list_filter(list_concat([title, author, subject], coalesce(body, [])), lambda x: x <> ''), ' ')), 3000) AS text FROM files_ LEFT JOIN (SELECT page_id, list(text ORDER BY page) AS body FROM file_pages WHERE page <= 3 GROUP BY page_id) USING (page_id)",
    "log": """SELECT event_id AS seq, user_id AS session_id, ts, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'ingest' WHEN 'signup' THEN 'clear' ELSE 'other' END AS op,
      CASE event_type WHEN 'purchase' THEN 'doc' || (event_id % 5) || CASE WHEN event_id % 3 = 0 THEN '#a1' ELSE '' END WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'doc' || (event_id % 5) END END AS doc_id,
      (floor(abs(value)) * 10)::BIGINT AS naive_tokens, (event_id % 700)::BIGINT AS actual_tokens, (event_id % 6)::INTEGER AS chunks FROM events""",
}


def sql(body: str) -> str:
    """The query with the parts that it names, and theirs, put before it."""
    used: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in seen and re.search(rf"\b{name}\b", text) and re.search(rf"(FROM|JOIN|,)\s*\(?\s*{name}\b", text):
                seen.add(name)
                visit(PARTS[name])
                used.append(name)

    visit(body)
    return (("WITH RECURSIVE " + ", ".join(f"{n} AS ({PARTS[n]})" for n in used) + " ") if used else "") + body


__all__ = ["HEADING", "INSTRUCTION", "RECENCY", "REFERENCE", "REMOVED", "QUESTIONS", "sql"]
