"""Cuckoo filters over 64-bit hashes, inserted and probed in bulk by numpy (Fan et al., 2014).

A filter has 2**bits buckets of four 16-bit fingerprints; a key's two buckets differ by a hash of its fingerprint, so an
entry can move, and be deleted, without the key. Inserting the same key twice stores it twice. Keys that find no place
after ``MAX_KICKS`` rounds are kept beside the table, as (bucket, fingerprint) pairs, so no key is ever lost. A present key
is always found; an absent one is found about once in 8000 probes. A filter does not know whose an entry is: who deletes has
to know that the key has one in this filter.
"""

from __future__ import annotations

import struct

import numpy as np

from lapidary.llm.text import mix

SLOTS = 4
LOAD = 0.85
MAX_KICKS = 500
_U = np.uint64


class CuckooFilter:
    def __init__(self, bits: int):
        self.bits = bits
        self.table = np.zeros((1 << bits, SLOTS), np.uint16)
        self.over = np.zeros(0, _U)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """A filter with room for so many keys."""
        return cls(max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD))))))

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = ((h >> _U(48)) % _U(65535) + _U(1)).astype(np.uint16)
        return mark, (mix(h) & _U((1 << self.bits) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(_U) + _U(0x5BD1E995)) & _U((1 << self.bits) - 1)).astype(np.int64)

    def insert(self, h: np.ndarray) -> None:
        h = np.asarray(h, _U)
        mark, bucket = self._places(h)
        for kick in range(MAX_KICKS):
            if not len(mark):
                return
            for turn in range(2):  # each key's first bucket, then its other one
                order = np.argsort(bucket, kind="stable")
                b, m = bucket[order], mark[order]
                nth = np.arange(len(b)) - np.searchsorted(b, b)
                free = self.table[b] == 0
                rank = np.cumsum(free, axis=1)
                fits = nth < rank[:, -1]
                slot = np.argmax((rank == nth[:, None] + 1) & free, axis=1)
                self.table[b[fits], slot[fits]] = m[fits]
                bucket, mark = b[~fits], m[~fits]
                if turn == 0:
                    bucket = self._other(bucket, mark)
            if not len(mark):
                return
            # one key a bucket pushes an entry out, the rest wait
            _, first = np.unique(bucket, return_index=True)
            at, slot = bucket[first], (mix(mark[first].astype(_U) + _U(kick)) % _U(SLOTS)).astype(np.int64)
            out = self.table[at, slot].copy()
            self.table[at, slot] = mark[first]
            wait = np.ones(len(mark), bool)
            wait[first] = False
            bucket = np.concatenate([self._other(at, out), self._other(bucket[wait], mark[wait])])
            mark = np.concatenate([out, mark[wait]])
        # what has no place is kept as (bucket, mark) pairs, found by either bucket
        pairs = (np.minimum(bucket, self._other(bucket, mark)).astype(_U) << _U(16)) | mark.astype(_U)
        self.over = np.sort(np.concatenate([self.over, pairs]))

    def count(self, h: np.ndarray) -> np.ndarray:
        """How many entries each key may have: at least as many as were inserted and not deleted."""
        mark, one = self._places(np.asarray(h, _U))
        two = self._other(one, mark)
        found = (self.table[one] == mark[:, None]).sum(axis=1) + np.where(one == two, 0, (self.table[two] == mark[:, None]).sum(axis=1))
        pair = (np.minimum(one, two).astype(_U) << _U(16)) | mark.astype(_U)
        return found + np.searchsorted(self.over, pair, side="right") - np.searchsorted(self.over, pair, side="left")

    def __contains__(self, h: int) -> bool:
        return bool(self.count(np.array([h], _U))[0])

    def delete(self, h: np.ndarray) -> None:
        """Take out one entry for each time a key is given. Only keys that were inserted so often may be deleted."""
        mark, one = self._places(np.asarray(h, _U))
        two = self._other(one, mark)
        # entries of equal mark and buckets are one kind, whichever key they were made for
        pair, times = np.unique((np.minimum(one, two).astype(_U) << _U(16)) | mark.astype(_U), return_counts=True)
        mark, one = (pair & _U(0xFFFF)).astype(np.uint16), (pair >> _U(16)).astype(np.int64)
        first = np.searchsorted(self.over, pair)
        beside = np.minimum(np.searchsorted(self.over, pair, side="right") - first, times)
        self.over = np.delete(self.over, np.repeat(first, beside) + np.arange(beside.sum()) - np.repeat(np.cumsum(beside) - beside, beside))
        times = times - beside
        for bucket in (one, self._other(one, mark)):
            hit = self.table[bucket] == mark[:, None]
            out = hit & (np.cumsum(hit, axis=1) <= times[:, None])
            at, slot = np.nonzero(out)
            self.table[bucket[at], slot] = 0
            times = times - out.sum(axis=1)

    def to_bytes(self) -> bytes:
        return struct.pack("<iq", self.bits, len(self.over)) + self.over.tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        bits, n = struct.unpack_from("<iq", raw)
        out = cls(bits)
        out.over = np.frombuffer(raw, _U, n, 12).copy()
        out.table = np.frombuffer(raw, np.uint16, offset=12 + 8 * n).reshape(1 << bits, SLOTS).copy()
        return out
