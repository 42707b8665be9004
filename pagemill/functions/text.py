"""Column functions over text; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT

# Words that are no query terms; patterns for references, headings, recency and instructions in documents.
STOP_WORDS = """
the a an and or of to in for on at by is are was were be been being as it this that with from
what which who whom whose when where why how
do does did doing done have has had can could shall should will would may might must
not nor but if then than so such
i me my we us our you your he him his she her they them their there here these those
about into onto over under between across during within without
any all both each few more most other some only own same too very just also
please tell tells told say says said give gives gave show shows showed
explain explains describe describes summarize summarise summary list lists
make makes made get gets got use uses used need needs want wants know knows
mean means thing things
""".split()
REFERENCE = r"(?i)(?:see|cf\.?|refer to)\s+(?:section|sec\.?|§|clause|chapter|page|p\.?)\s*([\d]+(?:\.[\d]+)*)"
HEADING = r"^\s*(?:\d+(?:\.\d+)*\s+)?[A-Z][A-Za-z0-9 ,'&/()-]{2,80}$"
RECENCY = r"(?i)\b(latest|most recent|newest|recent|last)\b"
RECENCY_WORDS = ["latest", "most", "recent", "newest", "last"]
INSTRUCTION = r"(?i)ignore (all )?(previous|prior) instructions"
REMOVED = "[line removed: possible prompt-injection]"
#: Runs of what Python's str.split() takes as no white space.
WORD = r"(?U)[^\s\x1c-\x1f]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def stem(token: Column) -> Column:
    """One suffix goes, the first that fits: ies becomes y, ing, ed, s (not ss), as long as enough stays."""
    n = F.length(token)
    less = lambda k: F.substring(token, F.lit(1), n - k)
    return (
        F.when(token.endswith("ies") & (n > 4), F.concat(less(3), F.lit("y")))
        .when(token.endswith("ing") & (n >= 7), less(3))
        .when(token.endswith("ed") & (n >= 6), less(2))
        .when(token.endswith("s") & ~token.endswith("ss") & (n >= 5), less(1))
        .otherwise(token)
    )


def tokens(text: Column) -> Column:
    return F.transform(raw_tokens(text), stem)


def query_terms(text: Column, least: int = DEFAULT.least_term) -> Column:
    """The stems of a question that count, in order, repeats kept: long enough, and no stop words once stemmed."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(tokens(text), lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t))


def sentences(text: Column, window: int = DEFAULT.sentence_window) -> Column:
    """Parts after . ! or ?; with fewer than two, windows of words; never empty."""
    space = "(?U)[\\s\\x1c-\\x1f]"
    trimmed = lambda s: F.regexp_replace(s, f"^{space}+|{space}+$", "")
    parts = F.filter(F.transform(F.split(text, f"(?<=[.!?]){space}+"), trimmed), lambda s: s != "")
    every = words(text)
    starts = F.when(F.size(every) > 0, F.sequence(F.lit(0), F.greatest(F.size(every) - 1, F.lit(0)), F.lit(window))).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.array_join(F.slice(every, i + 1, F.lit(window)), " "))
    few = F.when(F.size(windows) > 0, windows).otherwise(F.array(text))
    return F.when(F.size(parts) < 2, few).otherwise(parts)


def count_tokens(text: Column) -> Column:
    """About four code points a token, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 4))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def sanitized(text: Column) -> Column:
    """Lines that try to instruct the reader are replaced by a marker."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(INSTRUCTION), F.lit(REMOVED)).otherwise(x)), "\n")


def stripped(text: Column) -> Column:
    space = "(?U)[\\s\\x1c-\\x1f]"
    return F.regexp_replace(text, f"^{space}+|{space}+$", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)[\\s\\x1c-\\x1f]+", " "))


def envelope(source: Column, page: Column, text: Column, sanitize: bool = False) -> Column:
    body = stripped(sanitized(text) if sanitize else text)
    return F.concat(F.lit('<document-chunk source="'), source.cast("string"), F.lit(" p"), page.cast("string"), F.lit('">\n'), body, F.lit("\n</document-chunk>"))


def name_tokens(name: Column) -> Column:
    """Alphanumeric runs of a path's last part without its suffix, in lower case."""
    last = F.regexp_replace(name, "^.*/", "")
    stem_ = F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")
    return F.regexp_extract_all(F.lower(stem_), F.lit("[a-z0-9]+"), F.lit(0))


def references(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))


def age_bucket(seconds: Column) -> Column:
    days = seconds / 86400
    return (
        F.when(days < 1, "today").when(days < 2, "yesterday")
        .when(days < 7, F.concat(F.floor(days).cast("string"), F.lit(" days ago")))
        .otherwise(F.concat(F.floor(days / 7).cast("string"), F.lit(" wk ago")))
    )


def index_key(path: Column) -> Column:
    """The file's stem and the first 16 digits of its path's hash."""
    stem_ = F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.concat(stem_, F.lit("."), F.left(F.sha2(path, 256), F.lit(16)))


def parsed_pages(spec: Column, n: Column) -> Column:
    """'12-14,17' to page numbers, in order, repeats kept, those beyond 1..n dropped; parts that are no numbers raise."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != "")
    number = lambda x, i: F.trim(F.element_at(F.split(x, "-"), i)).cast("int")
    spans = F.transform(parts, lambda x: F.struct(number(x, 1).alias("a"), number(x, -1).alias("b")))
    every = F.flatten(F.transform(spans, lambda s: F.when(s["a"] <= s["b"], F.sequence(s["a"], F.greatest(s["a"], s["b"]))).otherwise(F.array().cast("array<int>"))))
    return F.filter(every, lambda p: (p >= 1) & (p <= n))
