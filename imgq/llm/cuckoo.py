"""A cuckoo filter over 64-bit hashes, filled and emptied in bulk with numpy."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; 0 marks a free slot.

    A fingerprint may sit in either of two buckets, each of which follows from
    the other and the fingerprint alone, so entries can be moved and deleted.
    Deleting a hash that was never inserted is the caller's error.
    """

    def __init__(self, buckets: int):
        if buckets < 1 or buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(1 << max(0, int(np.ceil(np.log2(max(n, 1) / (SLOTS * 0.8))))))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls(len(data) // (2 * SLOTS))
        out.table = np.frombuffer(data, dtype="<u2").reshape(-1, SLOTS).copy()
        return out

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = _spread(np.asarray(hashes).astype(np.int64).view(np.uint64))
        prints = ((x >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        return prints, (x & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        step = _spread(prints.astype(np.uint64) * _MIX) & np.uint64(len(self.table) - 1)
        return bucket ^ step.astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, bucket = self._place(hashes)
        found = (self.table[bucket] == prints[:, None]).any(axis=1)
        return found | (self.table[self._other(prints, bucket)] == prints[:, None]).any(axis=1)

    def insert(self, hashes: np.ndarray, rounds: int = 500) -> bool:
        """Insert distinct hashes; False if the table is too full (it is then spoilt)."""
        prints, bucket = self._place(hashes)
        for turn in range(rounds):
            if not len(prints):
                return True
            order = np.argsort(bucket, kind="stable")
            prints, bucket = prints[order], bucket[order]
            head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            rank = np.arange(len(bucket)) - np.repeat(head, np.diff(np.r_[head, len(bucket)]))
            free = self.table[bucket] == 0
            fits = rank < free.sum(axis=1)
            slot = np.argmax(np.cumsum(free, axis=1) == (rank + 1)[:, None], axis=1)
            self.table[bucket[fits], slot[fits]] = prints[fits]
            prints, bucket = prints[~fits], bucket[~fits]
            if turn and len(prints):  # one of each full bucket gives way
                first = np.r_[True, bucket[1:] != bucket[:-1]]
                b, s = bucket[first], turn % SLOTS
                out = self.table[b, s].copy()
                self.table[b, s] = prints[first]
                prints = np.r_[out, prints[~first]]
                bucket = np.r_[b, bucket[~first]]
            bucket = self._other(prints, bucket)
        return not len(prints)

    def delete(self, hashes: np.ndarray) -> None:
        for p, b in zip(*self._place(hashes), strict=True):
            for at in (int(b), int(self._other(np.array([p]), np.array([b]))[0])):
                slots = np.flatnonzero(self.table[at] == p)
                if len(slots):
                    self.table[at, slots[0]] = 0
                    break


def build(hashes: np.ndarray) -> CuckooFilter:
    """A filter that holds the distinct hashes, grown until all fit."""
    hashes = np.unique(np.asarray(hashes, dtype=np.int64))
    n = len(hashes)
    while True:
        out = CuckooFilter.for_keys(n)
        if out.insert(hashes):
            return out
        n = max(2 * n, 2)
