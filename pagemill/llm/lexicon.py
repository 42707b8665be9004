"""A minimal acyclic transducer: words of bytes to lists of token ids, in one flat, memory-mapped file.

States that have the same futures are shared, so common endings are stored
once. Each arc carries how many words precede it among its state's words;
their sum along a path is the word's number, and that finds the word's ids.
Words are numbered in the order of the arcs, the arc with most words first.
"""

from __future__ import annotations

import mmap

import numpy as np

MAGIC = 0x4C455831


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file's bytes for these words; empty words are left out."""
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, target), ...))
    counts: list[int] = []  # words accepted from a state

    def freeze(final: bool, arcs: list[tuple[int, int]]) -> int:
        state = (final, tuple(arcs))
        if state not in register:
            register[state] = len(states)
            states.append(state)
            counts.append(final + sum(counts[t] for _, t in arcs))
        return register[state]

    # open path of the word last added: (final, arcs) by depth; arcs of the deeper states are frozen as soon as the path leaves them
    path: list[list] = [[False, []]]
    last = b""
    for word in [*words, b""]:
        common = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        while len(path) > common + 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(final, arcs)))
        if word:
            path += [[False, []] for _ in range(len(word) - common)]
            path[-1][0] = True
            last = word
    root = freeze(*path[0])

    first, label, target, before = [0], [], [], []
    for final, arcs in states:
        ahead = int(final)
        for byte, to in sorted(arcs, key=lambda a: -counts[a[1]]):  # the likeliest first
            label.append(byte)
            target.append(to)
            before.append(ahead)
            ahead += counts[to]
        first.append(len(label))
    ids = [entries[w] for w in _in_arc_order(states, root, first, label, target)]
    at = np.cumsum([0, *map(len, ids)], dtype=np.uint32)
    parts = [np.array(first, np.uint32), np.array([s[0] for s in states], np.uint32), np.array(label, np.uint32), np.array(target, np.uint32), np.array(before, np.uint32), at, np.array([i for x in ids for i in x], np.uint32)]
    return b"".join([np.array([MAGIC, root, *map(len, parts)], np.uint32).tobytes(), *(p.tobytes() for p in parts)])


def _in_arc_order(states, root, first, label, target):
    """The words in the order of their numbers: depth first, a state's own end before its arcs."""
    stack = [(root, b"")]
    while stack:
        state, word = stack.pop()
        if states[state][0]:
            yield word
        stack += [(target[i], word + bytes([label[i]])) for i in range(first[state + 1] - 1, first[state] - 1, -1)]


class Lexicon:
    """Lookups in a compiled file that is mapped into memory, so that all workers of a machine share its pages."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        all_ = np.frombuffer(self._map, dtype=np.uint32)
        if all_[0] != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        self.root, parts, at = int(all_[1]), [], 9
        for n in all_[2:9].tolist():
            parts.append(all_[at : at + n])
            at += n
        self.first, self.final, self.label, self.target, self.before, self.at, self.ids = parts
        self.n_states, self.n_words = len(self.final), len(self.at) - 1

    def lookup_many(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each word data[start : start + length], or -1. All words take their next byte together."""
        number = np.zeros(len(starts), dtype=np.int64)
        state = np.full(len(starts), self.root, dtype=np.int64)
        out = np.full(len(starts), -1, dtype=np.int64)
        live = np.flatnonzero(lengths > 0)
        step = 0
        while len(live):
            byte = data[starts[live] + step]
            arc, last = self.first[state[live]].astype(np.int64), self.first[state[live] + 1]
            found = np.full(len(live), -1, dtype=np.int64)
            trying = np.flatnonzero(arc < last)
            while len(trying):  # arcs stand in order of their weight, so few tries suffice
                hit = self.label[arc[trying]] == byte[trying]
                found[trying[hit]] = arc[trying[hit]]
                trying = trying[~hit]
                arc[trying] += 1
                trying = trying[arc[trying] < last[trying]]
            on = found >= 0
            live, found = live[on], found[on]
            number[live] += self.before[found]
            state[live] = self.target[found]
            step += 1
            ended = lengths[live] == step
            done = live[ended]
            out[done] = np.where(self.final[state[done]] > 0, number[done], -1)
            live = live[~ended]
        return out

    def lookup(self, word: bytes) -> list[int] | None:
        """The word's ids, or None if it isn't in the lexicon."""
        n = int(self.lookup_many(np.frombuffer(word, dtype=np.uint8), np.zeros(1, np.int64), np.array([len(word)]))[0])
        return None if n < 0 else self.ids[self.at[n] : self.at[n + 1]].tolist()
