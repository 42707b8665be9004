"""Language identification: scripts narrow the candidates, Viterbi labels spans.

Words are runs of letters. A word's score in a language is its naive Bayes log
likelihood from letter trigrams (hashed to a fixed number of bins), learned
from labelled documents. A word's script, by code point ranges, leaves only the
languages that use that script as candidates. Viterbi over the words, with a
penalty for each switch, labels spans of mixed-language text; the language
with most letters is the document's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_slices, small_batches, widened

UNKNOWN = "und"
BINS = 1 << 16
SMOOTH, SWITCH, RULED_OUT = 0.1, 12.0, -50.0
#: The classifier is fitted on about this many labelled documents, spread evenly by a hash of doc_id (all, if there are fewer).
TRAIN_DOCS = 20_000
#: Texts are worked on in slices of at most this many bytes (or one text); a letter takes about 30 bytes meanwhile.
SLICE = 2 << 20
#: Words of a text that are labelled one after the other; the parts of a longer text advance side by side.
PART = 1024
#: A language is a candidate for the scripts that hold at least this share of its training letters.
SCRIPT_SHARE = 0.01
# First code points of script ranges and the scripts' names, after Unicode's blocks.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Latin"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
SCRIPT_STARTS = np.array([at for at, _ in SCRIPTS], dtype=np.uint32)
SCRIPT_IDS = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], dtype=np.int64)
_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter; made once in a process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


class Words:
    """The words of some texts as arrays: letters, trigram bins, and each word's first letter, end, text and script."""

    def __init__(self, texts: list[str]) -> None:
        lowered = [x.lower() for x in texts]
        self.points = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = letter_table()[self.points]
        edge = np.diff(letter.view(np.int8), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ends = np.cumsum(np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered)) + 1)
        self.counts = np.diff(np.searchsorted(self.starts, ends + 1), prepend=0)  # words of each text
        kept = np.where(letter, self.points, np.uint32(0))  # 0: no letter
        h = kept[:-2] * np.uint32(0x9E3779B1)
        h ^= kept[1:-1] * np.uint32(0x85EBCA77)
        h ^= kept[2:] * np.uint32(0xC2B2AE3D)
        h *= np.uint32(0x27D4EB2F)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x165667B1)
        self.bins = (h >> np.uint32(16)).astype(np.uint16)[letter[1:-1]]  # the first and last sign are line ends
        self.lengths = self.ends - self.starts
        self.letter_starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.scripts = SCRIPT_IDS[np.searchsorted(SCRIPT_STARTS, self.points[self.starts], side="right") - 1]


class Model:
    """Languages in order of their names, log likelihoods (bins x languages) and their scripts."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, docs: np.ndarray, switch: float = SWITCH) -> None:
        self.langs, self.switch = langs, switch
        total = counts.sum(axis=0, keepdims=True)
        self.log = np.log((counts + SMOOTH) / (total + SMOOTH * BINS)).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(axis=0, keepdims=True))
        self.uses = share >= SCRIPT_SHARE  # scripts x languages
        self.common = int(np.argmax(docs)) if len(langs) else -1

    def scores(self, words: Words) -> np.ndarray:
        """words x languages. Where no language uses the script, the score is 0 for all."""
        out = np.zeros((len(words.starts), len(self.langs)), dtype=np.float32)
        step = SLICE // max(2, len(self.langs))
        first = 0
        while first < len(out):
            last = max(first + 1, int(np.searchsorted(words.letter_starts, words.letter_starts[first] + step, side="right")) - 1)
            last = min(last, len(out))
            lo, hi = words.letter_starts[first], words.letter_starts[last]
            out[first:last] = np.add.reduceat(self.log[words.bins[lo:hi]], words.letter_starts[first:last] - lo, axis=0)
            first = last
        uses = self.uses[words.scripts]
        out += np.where(uses, 0, RULED_OUT).astype(np.float32)
        out[~uses.any(axis=1)] = 0
        return out

    def labels(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The best path's language for each word.

        Texts advance together, in parts of PART words at most. What a part does
        to each language it may begin with is found first; this tells the scores that
        each part of a long text begins with and the language that it ends in.
        """
        begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
        pieces = -(-counts // PART)
        text = np.repeat(np.arange(len(counts)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = begin[text] + nth * PART
        sizes = np.minimum(PART, counts[text] - nth * PART)
        starts, ends = np.zeros((len(text), len(self.langs)), dtype=np.float32), np.full(len(text), -1)
        many = np.flatnonzero(pieces[text] > 1)
        if len(many):
            through = self.effects(scores, at[many], sizes[many])
            bounds = np.flatnonzero(np.diff(text[many], prepend=-1))
            for lo, hi in zip(bounds.tolist(), [*bounds[1:].tolist(), len(many)], strict=True):
                best, back = np.zeros(len(self.langs)), []
                for i in range(lo, hi):
                    starts[many[i]] = best - best.max()
                    paths = best[:, None] + through[i]
                    back.append(paths.argmax(axis=0))
                    best = paths.max(axis=0)
                state = int(best.argmax())
                for i in range(hi - 1, lo - 1, -1):
                    ends[many[i]] = state
                    state = int(back[i - lo][state])
        return self.decode(scores, at, sizes, starts, ends)

    def effects(self, scores: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """parts x languages x languages: the best score of a part's words from each language before it to each at its end."""
        order = np.argsort(-sizes, kind="stable")
        at, sizes = at[order], sizes[order]
        best = np.full((len(at), len(self.langs), len(self.langs)), -np.inf)
        best[:, np.arange(len(self.langs)), np.arange(len(self.langs))] = 0
        for t, n in enumerate(np.searchsorted(-sizes, -np.arange(sizes[0]), side="left").tolist()):
            part = best[:n]
            np.maximum(part, part.max(axis=2, keepdims=True) - self.switch, out=part)
            part += scores[at[:n] + t][:, None, :]
        out = np.empty_like(best)
        out[order] = best
        return out

    def decode(self, scores: np.ndarray, at: np.ndarray, sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Viterbi over parts of the words, all at once: from the scores before each part, to the language it ends in (-1: the best)."""
        out = np.zeros(len(scores), dtype=np.int16)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        if not len(order):
            return out
        at, sizes, best, ends = at[order], sizes[order], starts[order].copy(), ends[order]
        live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left").tolist()  # parts with more than t words
        came = np.zeros(len(scores), dtype=np.int16)  # the best language before a switch to this word
        stays = np.zeros(scores.shape, dtype=bool)
        for t, n in enumerate(live):
            rows = at[:n] + t
            top = best[:n].argmax(axis=1)
            change = best[np.arange(n), top] - self.switch
            came[rows] = top
            stays[rows] = best[:n] >= change[:, None]
            best[:n] = np.maximum(best[:n], change[:, None])
            best[:n] -= best[:n].max(axis=1, keepdims=True)  # keeps float32 exact enough
            best[:n] += scores[rows]
        state = np.where(ends < 0, best.argmax(axis=1), ends)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            rows = at[:n] + t
            out[rows] = state[:n]
            state[:n] = np.where(stays[rows, state[:n]], state[:n], came[rows])
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[int], list[float]]:
        """Language, score, number of spans and known share of each text.

        The score is the share of its letters that the language labels, the known share that of the letters that any language labels.
        """
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts), [0.0] * len(texts)
        words = Words(texts)
        scores = self.scores(words)
        labels = self.labels(scores, words.counts)
        known = self.uses[words.scripts].any(axis=1)
        text = np.repeat(np.arange(len(texts)), words.counts)
        by = np.zeros((len(texts), len(self.langs)))
        np.add.at(by, (text[known], labels[known]), words.lengths[known])
        letters = np.bincount(text, weights=words.lengths, minlength=len(texts))
        best = np.where(by.any(axis=1), by.argmax(axis=1), self.common)
        share = by[np.arange(len(texts)), best] / np.maximum(1, letters)
        every = by.sum(axis=1) / np.maximum(1, letters)
        switched = np.flatnonzero((labels[1:] != labels[:-1]) & (text[1:] == text[:-1])) + 1
        spans = np.bincount(text[switched], minlength=len(texts)) + (words.counts > 0)
        return [self.langs[i] if n else UNKNOWN for i, n in zip(best.tolist(), letters.tolist(), strict=True)], share.tolist(), spans.tolist(), every.tolist()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(begin, end, language) of each run of words of one language, by the lowered text's code points."""
        words = Words([text])
        labels = self.labels(self.scores(words), words.counts) if self.langs else []
        out: list[tuple[int, int, str]] = []
        for a, b, lang in zip((words.starts - 1).tolist(), (words.ends - 1).tolist(), labels, strict=False):
            if out and out[-1][2] == self.langs[lang]:
                out[-1] = (out[-1][0], b, out[-1][2])
            else:
                out.append((a, b, self.langs[lang]))
        return out


def train(labelled: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    """A model from labelled (doc_id, text, lang). Rows with a null are left out.

    Of more than `limit` rows, a share is taken by a hash of doc_id that makes
    about `limit`. One row of counts for each language reaches the driver.
    """
    labelled = labelled.select("doc_id", "text", "lang").dropna()
    n = labelled.count()
    if n > limit:
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(limit / n * (1 << 30)))
    schema = "lang string, bins binary, scripts binary, docs long"

    def count(batches):
        for whole in batches:
            for b in in_slices(whole, 0, SLICE):
                langs = b.column(1).to_pylist()
                words = Words(b.column(0).to_pylist())
                text_of_word = np.repeat(np.arange(len(langs)), words.counts)
                lang_of_word = np.array([langs[i] for i in text_of_word.tolist()], dtype=object)
                for lang in sorted(set(langs)):
                    mine = lang_of_word == lang
                    letters = np.repeat(mine, words.lengths)
                    bins = np.bincount(words.bins[letters], minlength=BINS)
                    scripts = np.bincount(words.scripts[mine], weights=words.lengths[mine], minlength=len(SCRIPT_NAMES))
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([bins.astype(np.int64).tobytes()], pa.binary()), pa.array([scripts.astype(np.int64).tobytes()], pa.binary()), pa.array([langs.count(lang)], pa.int64())], names=["lang", "bins", "scripts", "docs"])

    def total(table: pa.Table) -> pa.Table:
        add = lambda c: sum((np.frombuffer(x.as_py(), dtype=np.int64) for x in table[c]), np.int64(0)).tobytes()
        return pa.table({"lang": table["lang"][:1], "bins": pa.array([add("bins")], pa.binary()), "scripts": pa.array([add("scripts")], pa.binary()), "docs": pa.array([sum(table["docs"].to_pylist())], pa.int64())})

    counted = small_batches(labelled.select("text", "lang")).mapInArrow(count, schema).groupBy("lang").applyInArrow(total, schema)
    rows = sorted(counted.collect(), key=lambda r: r["lang"])
    langs = [r["lang"] for r in rows]
    column = lambda c, n: np.stack([np.frombuffer(r[c], dtype=np.int64) for r in rows], axis=1).astype(float) if rows else np.zeros((n, 0))
    return Model(langs, column("bins", BINS), column("scripts", len(SCRIPT_NAMES)), np.array([r["docs"] for r in rows]))


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the doc_id's digits leaves 1 when divided by 3; false without doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score, n_spans and known, one row for each row of docs; every column of docs stays.

    A text that is null or has no letter is `und` with score 0, as is every text
    if nothing was learned. A text whose letters are all of scripts that no
    learned language uses gets the most frequent language with score 0. Ties go
    to the first language by name. known is the share of the letters that spans of
    any learned language hold. Where docs has a column of a new one's name,
    the new one's is lengthened by underscores (common.fresh).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = fresh(docs.columns, "lang_pred", "score", "n_spans", "known")
    at, names, schema = docs.columns.index("text"), [*docs.columns, *added], widened(docs, added, "string", "double", "long", "double")

    def run(batches):
        for whole in batches:
            for b in in_slices(whole, at, SLICE):
                lang, score, spans, known = shared.value.predict([x.as_py() or "" for x in b.column(at)])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.int64()), pa.array(known, pa.float64())], names=names)

    return small_batches(docs).mapInArrow(run, schema)
