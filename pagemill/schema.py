"""Schemas of the engine's tables and the identity of an index."""

from __future__ import annotations

SCHEMA_VERSION = 1
PAGES = "doc_id string, page int, text string"
PASSAGES = "doc_id string, passage_id long, page int, passage_no int, start_word int, text string, vec array<float>"
POSTINGS = "doc_id string, passage_id long, term string, tf long"
FILES = "path string, name string, parent string, size long, mtime_ns long, title string, author string, subject string"
QUESTIONS = "query_id long, text string, k int, doc_filter string"
GOLD = "q string, pages array<int>"
REQUESTS = "seq long, session_id long, ts timestamp, op string, doc_id string, naive_tokens long, actual_tokens long, chunks int"
TABLE_CELLS = "page int, table_no int, row_no int, cells array<string>"
#: An index is fresh only if all of these agree with the file and the engine.
IDENTITY = ("schema_version", "model", "extractor", "dim", "size", "mtime_ns")
