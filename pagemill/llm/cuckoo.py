"""A cuckoo filter in numpy: insertions, deletions and lookups of 64-bit keys in bulk."""

from __future__ import annotations

import numpy as np

from .common import mix64

SLOTS = 4


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key's two buckets differ by its fingerprint's hash.

    No key that is held is ever missed; one that is not held is found by
    chance in about 2 * SLOTS / 2**16 of the cases. A key inserted n times can be
    removed n times. Where an insertion finds no place, a larger
    filter is made of the keys, which the caller has in its exact table.
    """

    def __init__(self, capacity: int = 64) -> None:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.75)))))
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of these keys. A key may occur 2 * SLOTS times at most, which is all that its buckets hold."""
        size = max(1, len(keys))
        for _ in range(8):
            made = cls(size)
            if made.insert(keys):
                return made
            size *= 2
        raise ValueError("a key occurs too often for its two buckets")

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        made.table = np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy()
        return made

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix64(keys.astype(np.uint64))
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, one, self._other(mark, one)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix64(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray, rounds: int = 500) -> bool:
        """Whether all keys found a place; if not, the filter is to be made anew, larger."""
        mark, one, two = self._places(keys)
        mark, one, two = self._fill(mark, one, one, two)
        mark, one, two = self._fill(mark, two, one, two)
        rng, at = np.random.default_rng(len(keys)), two
        for _ in range(rounds):
            if not len(mark):
                return True
            first = np.unique(at, return_index=True)[1]  # one eviction in a bucket each round
            bucket, slot = at[first], rng.integers(0, SLOTS, len(first))
            put_out = self.table[bucket, slot].copy()
            self.table[bucket, slot] = mark[first]
            free = put_out == 0
            stay = np.ones(len(mark), dtype=bool)
            stay[first] = False
            mark = np.concatenate((mark[stay], put_out[~free]))
            at = np.concatenate((at[stay], self._other(put_out[~free], bucket[~free])))
            mark, at, _ = self._fill(mark, at, at, at)
        return not len(mark)

    def _fill(self, mark, at, one, two):
        """Put marks into free slots of buckets `at`; what found none comes back with its other columns."""
        order = np.argsort(at, kind="stable")
        b = at[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        empty = self.table[b] == 0
        nth = np.cumsum(empty, axis=1)
        fits = rank < nth[:, -1] if len(b) else np.zeros(0, dtype=bool)
        slot = (nth[fits] == (rank[fits] + 1)[:, None]).argmax(axis=1)
        self.table[b[fits], slot] = mark[order][fits]
        rest = order[~fits]
        return mark[rest], one[rest], two[rest]

    def remove(self, keys: np.ndarray) -> None:
        """Take out one entry for each key; only keys that were inserted may be removed."""
        marks, ones, twos = self._places(keys)
        for mark, one, two in zip(marks.tolist(), ones.tolist(), twos.tolist(), strict=True):
            for bucket in (one, two):
                at = np.flatnonzero(self.table[bucket] == mark)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break
