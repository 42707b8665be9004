"""Constants and knobs of retrieval, overridable from the session's configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

PREFIX = "spark.pagemill."


@dataclass(frozen=True)
class RetrievalConfig:
    # passages
    passage_words: int = 180
    passage_overlap: int = 40
    # keyword scores over units in memory, and over the prefix index
    k1: float = 1.5
    b: float = 0.75
    index_k1: float = 1.2
    index_b: float = 0.75
    least_term: int = 3
    dedup_terms: bool = False
    # fusion
    keyword_weight: float = 0.4
    semantic_weight: float = 0.6
    direct_semantic_weight: float = 5.0
    semantic_floor: float = 0.25
    min_keyword_terms: int = 1
    passage_k: int = 40
    # selection
    k: int = 5
    most_k: int = 20
    near_duplicate: float = 0.6
    neighbors: int = 1
    # trimming
    trim: bool = True
    trim_from_words: int = 60
    trim_keep_words: int = 40
    trim_regions: int = 3
    trim_second: float = 0.6
    sentence_window: int = 25
    # responses and savings
    response_chars: int = 8000
    result_overhead: int = 8
    price_per_million: float = 3.0
    sanitize: bool = False
    # lifetimes
    ttl_minutes: float = 30.0
    index_ttl_days: float = 14.0
    # resolver
    name_threshold: float = 0.5
    near_threshold: float = 0.35
    dominance: float = 1.5
    probe_files: int = 40
    probe_pages: int = 3
    probe_chars: int = 3000
    probe_terms: int = 2
    probe_ratio: float = 0.6
    probe_keep: int = 5
    scan_files: int = 2000
    scan_depth: int = 3
    # inspection
    low_text: int = 40
    context_chars: int = 60
    map_block: int = 5
    anchors: int = 40
    heading_words: int = 10
    xref_chars: int = 400
    list_files: int = 100

    @classmethod
    def of(cls, spark: SparkSession, **changes) -> RetrievalConfig:
        """The defaults, then spark.pagemill.<name> where set, then `changes`."""
        own = cls()
        for f in fields(cls):
            value = spark.conf.get(PREFIX + f.name, None)
            if value is not None:
                kind = type(getattr(own, f.name))
                changes.setdefault(f.name, value.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(value))
        return replace(own, **changes)


DEFAULT = RetrievalConfig()
