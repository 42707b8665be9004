"""BPE encoding and decoding with the vocabulary of a public tokenizer file.

Frequent words of the corpus, counted over all documents, are merged once and
compiled into a transducer (lexicon.py) that every Python worker maps into
memory; words that it lacks are merged exactly. Text is normalised and cut as
the file's rules say: NFC, white space to one space, lower case, then runs of
letters, single numbers, and runs of other signs, with English contractions;
special tokens are recognised in the raw text.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import unicodedata
from collections import Counter
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, cut, fresh, in_slices, small_batches, widened
from .lexicon import Lexicon, compile_lexicon

#: Words of the lexicon at most, their longest length, distinct words that a task counts before it passes them on, and bytes worked on at once.
LEXICON_WORDS, LONGEST, COUNTER, SLICE = 200_000, 64, 150_000, 2 << 20
END = "</w>"
# Unicode's White_Space, and the pre-tokenizer's pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+")
MARKS = frozenset(",.;:!?")


def byte_signs() -> list[str]:
    """The sign that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Tokenizer:
    """Encoder and decoder of one vocabulary file. `lexicon` is the path of a compiled lexicon, or None."""

    def __init__(self, path: str, lexicon: str | None = None) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        pairs = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        self.ranks = {a << 32 | b: rank for rank, (a, b, _) in enumerate(pairs)}
        self.made = [c for _, _, c in pairs]
        signs = byte_signs()
        self.inner = [self.vocab.get(s) for s in signs]
        self.last = [self.vocab.get(s + END) for s in signs]
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lexicon = Lexicon(lexicon) if lexicon else None
        # the same as arrays, for many words at once
        self.pair_keys = np.array(sorted(self.ranks), dtype=np.int64)
        self.pair_ranks = np.array([self.ranks[k] for k in self.pair_keys.tolist()], dtype=np.int32)
        self.made_ids = np.array([*self.made, 0], dtype=np.int64)
        self.whole = None not in self.inner and None not in self.last
        self.symbols = np.array([[-1 if i is None else i for i in row] for row in (self.inner, self.last)], dtype=np.int64)
        shown = [self.token.get(i, "") + " " for i in range(max(self.token) + 1)]
        self.shown = pa.array(shown, pa.string())

    def merge(self, word: bytes) -> list[int]:
        """The exact merges of one pre-token: the pair of least rank first, the leftmost of equals.

        Pairs wait in a heap, by rank and place; symbols are linked to their
        neighbours, so a word of n bytes takes n log n steps. A pair that a merge has
        changed is known by its rank when its turn comes.
        """
        ids = [self.inner[b] for b in word[:-1]] + [self.last[b] for b in word[-1:]]
        ids = [i for i in ids if i is not None]
        n, get, made = len(ids), self.ranks.get, self.made
        ranks = [get(a << 32 | b, -1) for a, b in zip(ids, ids[1:], strict=False)]  # of the pair that begins here; -1: none
        waiting = [r << 32 | i for i, r in enumerate(ranks) if r >= 0]
        if not waiting:
            return ids
        heapify(waiting)
        ranks.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while waiting:
            first = heappop(waiting)
            rank, i = first >> 32, first & 0xFFFFFFFF
            if ranks[i] != rank:
                continue
            gone = after[i]
            new = ids[i] = made[rank]
            ids[gone], ranks[gone] = -1, -1
            after[i] = right = after[gone]
            if right < n:
                before[right] = i
                ranks[i] = r = get(new << 32 | ids[right], -1)
                if r >= 0:
                    heappush(waiting, r << 32 | i)
            else:
                ranks[i] = -1
            left = before[i]
            if left >= 0:
                ranks[left] = r = get(ids[left] << 32 | new, -1)
                if r >= 0:
                    heappush(waiting, r << 32 | left)
        return [i for i in ids if i >= 0]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], len(self.made)) if len(self.pair_keys) else np.zeros_like(key)

    def merge_many(self, data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """merge() of all words data[start : start + length]: (ids, padded, and how many). Each step merges one pair of every word."""
        none = len(self.made)
        ids = self.symbols[0][data[starts[:, None] + np.arange(length)[None, :]]]
        ids[:, -1] = self.symbols[1][data[starts + length - 1]]
        ranks = self.pair_rank(ids[:, :-1], ids[:, 1:])
        out, counts = np.zeros_like(ids), np.full(len(ids), length)
        live, n = np.arange(len(ids)), length
        while len(live):
            best = ranks.argmin(axis=1) if n > 1 else np.zeros(len(live), dtype=np.int64)
            rank = ranks[np.arange(len(live)), best] if n > 1 else np.full(len(live), none)
            ended = rank == none
            if ended.any():
                out[live[ended], :n] = ids[ended]
                counts[live[ended]] = n
                on = ~ended
                live, ids, ranks, best, rank = live[on], ids[on], ranks[on], best[on], rank[on]
                if not len(live):
                    break
            row = np.arange(len(live))
            ids[row, best] = self.made_ids[rank]
            shift = np.arange(n - 1)[None, :]
            ids = np.take_along_axis(ids, shift + (shift > best[:, None]), axis=1)
            n -= 1
            if n > 1:
                shift = np.arange(n - 1)[None, :]
                ranks = np.take_along_axis(ranks, shift + (shift >= best[:, None]), axis=1)
                left = best > 0
                ranks[row[left], best[left] - 1] = self.pair_rank(ids[row[left], best[left] - 1], ids[row[left], best[left]])
                right = best < n - 1
                ranks[row[right], best[right]] = self.pair_rank(ids[row[right], best[right]], ids[row[right], best[right] + 1])
        return out, counts

    def encode_words(self, words: list[str]) -> pa.ListArray:
        """The ids of each pre-token: from the lexicon, or merged."""
        raw = [w.encode("utf-8", "replace") for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        number = self.lexicon.lookup_many(data, starts, lengths) if self.lexicon else np.full(len(raw), -1)
        pieces, order = [], []
        known = np.flatnonzero(number >= 0)
        if len(known):
            at = self.lexicon.at.astype(np.int64)
            pieces.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(self.lexicon.ids)).take(pa.array(number[known])))
            order.append(known)
        unseen = number < 0
        for n in np.unique(lengths[unseen]).tolist():
            rows = np.flatnonzero(unseen & (lengths == n))
            if 0 < n <= LONGEST and self.whole:
                ids, counts = self.merge_many(data, starts[rows], n)
                flat = ids[np.arange(n)[None, :] < counts[:, None]]
            else:
                found = [self.merge(raw[i]) for i in rows.tolist()]
                counts, flat = np.array([len(x) for x in found]), np.array([i for x in found for i in x], dtype=np.int64)
            pieces.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(flat.astype(np.uint32))))
            order.append(rows)
        if not pieces:
            return pa.array([], pa.list_(pa.uint32()))
        back = np.empty(len(raw), dtype=np.int64)
        back[np.concatenate(order)] = np.arange(len(raw))
        return pa.concat_arrays(pieces).take(pa.array(back))

    @staticmethod
    def words(piece: str) -> list[str]:
        """The pre-tokens of a piece of text without special tokens."""
        if piece.isascii():
            low = piece.lower()
            if low.isalpha():
                return [low]
            if low[:-1].isalpha() and low[-1] in MARKS:
                return [low[:-1], low[-1]]
            return PATTERN.findall(low)
        return PATTERN.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())

    def pieces(self, chunk: str) -> list[str | int]:
        """Pre-tokens, and the ids of special tokens, in order."""
        if self.cut_special is None or "<" not in chunk:
            return self.words(chunk)
        out: list[str | int] = []
        for part in self.cut_special.split(chunk):
            out += [self.special[part]] if part in self.special else self.words(part)
        return out

    @staticmethod
    def chunks(raw: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Runs without ASCII white space, across which no rule looks: the distinct ones, which one each is, and where each starts."""
        data = np.frombuffer(raw, dtype=np.uint8)
        inside = ~IS_SPACE[data]
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
        found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
        return found.dictionary.to_pylist(), found.indices.to_numpy(), starts

    def run(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin and the last's end)."""
        distinct, which, starts = self.chunks(b"\n".join(texts))
        index: dict[str | int, int] = {}
        flat, sizes = [], []
        for chunk in distinct:
            found = self.pieces(chunk)
            sizes.append(len(found))
            flat += [index.setdefault(x, len(index)) for x in found]
        names = list(index)
        plain = [x for x in names if isinstance(x, str)]
        ids = self.encode_words(plain)
        if len(plain) < len(names):
            special = [i for i, x in enumerate(names) if not isinstance(x, str)]
            back = np.empty(len(names), dtype=np.int64)
            back[[i for i, x in enumerate(names) if isinstance(x, str)] + special] = np.arange(len(names))
            ids = pa.concat_arrays([ids, pa.array([[names[i]] for i in special], pa.list_(pa.uint32()))]).take(pa.array(back))
        lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        flat_words = np.array(flat, dtype=np.int64)
        of_chunk = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat_words)) if distinct else pa.array([], pa.list_(pa.int64()))
        n_ids = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(n_ids, np.repeat(np.arange(len(distinct)), sizes), lengths[flat_words]) if distinct else None
        every = ids.take(of_chunk.take(pa.array(which)).flatten()).flatten().to_numpy(zero_copy_only=False)
        upto = np.concatenate(([0], np.cumsum(n_ids[which])))
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
        bounds = np.concatenate(([0], upto[np.searchsorted(starts, ends)]))
        return every.astype("<u4", copy=False), bounds

    def encode(self, text: str | None) -> list[int]:
        return self.run([(text or "").encode("utf-8", "replace")])[0].tolist()

    def decode(self, ids) -> str:
        """The file names no decoder: tokens, word ends shown, are joined by a space."""
        return " ".join([t for t in map(self.token.get, ids) if t is not None])

    def decode_many(self, ids: np.ndarray, bounds: np.ndarray) -> pa.StringArray:
        """decode() of each text's ids."""
        shown = self.shown.take(pa.array(ids))
        offsets = np.frombuffer(shown.buffers()[1], dtype=np.int32)[: len(ids) + 1].astype(np.int64) if len(ids) else np.zeros(1, dtype=np.int64)
        data = shown.buffers()[2].to_pybytes() if len(ids) else b""
        at = offsets[bounds]
        return pa.array([data[a : b - 1] if b > a else b"" for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)], pa.binary()).cast(pa.string())


@lru_cache(maxsize=2)
def worker_tokenizer(path: str, digest: str, data) -> Tokenizer:
    """One tokenizer for each worker; the lexicon's file is written once to the worker's own folder, and mapped."""
    if not data:
        return Tokenizer(path)
    f, name = tempfile.mkstemp(suffix=".lex")
    try:
        with os.fdopen(f, "wb") as out:
            out.write(data.value)
        return Tokenizer(path, name)
    finally:
        os.unlink(name)  # the mapping stays


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts' UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def count_words(docs: DataFrame, path: str) -> DataFrame:
    """(word, n): every pre-token of every text with its count."""

    def run(batches):
        tok, counts = worker_tokenizer(path, "", None), Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for whole in batches:
            for b in in_slices(whole, 0, SLICE):
                distinct, which, _ = tok.chunks(b"\n".join(text_bytes(b.column(0))))
                for chunk, n in zip(distinct, np.bincount(which, minlength=len(distinct)).tolist(), strict=True):
                    for word in tok.pieces(chunk):
                        if isinstance(word, str):
                            counts[word] += n
                if len(counts) > COUNTER:
                    yield flush()
        yield flush()

    return small_batches(docs.select("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the corpus's most frequent pre-tokens: all above a count that leaves `words` of them at most."""
    counted = cut(count_words(docs, path).filter(F.length("word") <= LONGEST))
    # counts and how many words have each: no more rows than the root of twice the corpus's words
    seen, least = 0, None
    for r in counted.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        seen += r["count"]
        if seen > words:
            break
        least = r["n"]
    top = counted.filter(F.col("n") >= least).select("word").toArrow().column(0).to_pylist() if least else []
    top = [w for w in top if w]
    ids = Tokenizer(path).encode_words(top).to_pylist()
    return compile_lexicon(dict(zip((w.encode("utf-8", "replace") for w in top), ids, strict=True)))


def encode_documents(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> DataFrame:
    """docs with the columns ids (binary: little-endian unsigned 32-bit integers), n_tokens and decoded.

    path names the vocabulary file, which must be on every machine. A null
    text counts as empty: no ids, an empty decoded text. Every row and column
    of docs stays; where docs has a column of a new one's name, the new one's is
    lengthened by underscores (common.fresh).
    """
    added = fresh(docs.columns, "ids", "n_tokens", "decoded")
    data = frequent_lexicon(docs, path, words)
    shared, digest = docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()
    at, names, schema = docs.columns.index("text"), [*docs.columns, *added], widened(docs, added, "binary", "long", "string")

    def run(batches):
        tok = worker_tokenizer(path, digest, shared)
        for whole in batches:
            for b in in_slices(whole, at, SLICE):
                ids, bounds = tok.run(text_bytes(b.column(at)))
                data, ends = ids.tobytes(), (4 * bounds).tolist()
                packed = pa.array([data[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns, packed, pa.array(np.diff(bounds), pa.int64()), tok.decode_many(ids, bounds)], names=names)

    return small_batches(docs).mapInArrow(run, schema)
