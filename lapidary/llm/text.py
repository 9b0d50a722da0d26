"""Vectorised scanning of UTF-8 text held in Arrow buffers.

A word is a run of bytes outside 0x20 and 0x09-0x0D, that is ``[^\\x20\\x09-\\x0D]+``: in UTF-8 no byte of a longer
character falls in that set, so a scan over bytes finds the same words as a scan over code points.

Memory: about 60 bytes for each byte of a chunk; a chunk holds whole texts, ``CHUNK_BYTES`` of them or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=_U, endpoint=False)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)  # A-Z as a-z
LOWER[0x41:0x5B] += 32


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches that go to Python small: by default a batch has 10,000 rows, whatever their length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finaliser of SplitMix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Powers:
    up = down = np.ones(1, _U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, factor in (("up", _BASE), ("down", _INVERSE)):
                powers = np.full(max(n, 1 << 16), factor, _U)
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers, dtype=_U))
        return cls.up[:n], cls.down[:n]


@dataclass
class Chunk:
    """Whole texts, end to end: text i is ``buf[bounds[i]:bounds[i + 1]]``."""

    rows: pa.RecordBatch
    buf: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def __post_init__(self):
        n = len(self.buf)
        up, self._down = _Powers.upto(n + 1)
        self._prefix = np.zeros(n + 1, _U)
        np.cumsum(_BYTES[self.buf] * up[:n], out=self._prefix[1:])
        self._points = np.zeros(n + 1, np.int64)
        np.cumsum((self.buf & 0xC0) != 0x80, out=self._points[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the spans, equal for equal bytes wherever they stand."""
        h = (self._prefix[end] - self._prefix[start]) * self._down[start]
        return mix(h + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))

    def points(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Code points in the spans."""
        return self._points[end] - self._points[start]

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        return np.searchsorted(self.bounds[1:], at, side="right")

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each text has."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.bounds])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of all words, in order."""
        if not len(self.buf):
            none = np.zeros(0, np.int64)
            return none, none, none
        space = SPACE[self.buf]
        first = np.zeros(len(self.buf) + 1, bool)
        first[self.bounds] = True
        before = np.concatenate([[True], space[:-1]])
        after = np.concatenate([space[1:], [True]])
        start = np.flatnonzero(~space & (before | first[:-1]))
        end = np.flatnonzero(~space & (after | first[1:])) + 1
        return start, end, self.owner(start)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of all lines: texts split at newlines, an empty text being one empty line."""
        at = np.flatnonzero(self.buf == 0x0A)
        doc = self.owner(at)
        count = np.bincount(doc, minlength=len(self)) + 1
        last = np.cumsum(count) - 1
        end = np.empty(count.sum(), np.int64)
        inner = np.ones(len(end), bool)
        inner[last] = False
        end[inner], end[last] = at, self.bounds[1:]
        start = np.empty(len(end), np.int64)
        start[1:] = end[:-1] + 1
        start[last - count + 1] = self.bounds[:-1]
        return start, end, np.repeat(np.arange(len(self)), count)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES, fold: np.ndarray | None = None) -> Iterator[Chunk]:
    """The batches' rows, in order, a null text as an empty one; ``fold``: what each byte is read as."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            bounds = offsets[at : to + 1] - offsets[at]
            part = data[offsets[at] : offsets[to]]
            yield Chunk(batch.slice(at, to - at), part if fold is None else fold[part], bounds)
            at = to


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and rolling hash of every run of n words within one text."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    rolled = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        rolled *= _U(0xC2B2AE3D27D4EB4F)
        rolled += h[j : len(h) - n + 1 + j]
    at = np.flatnonzero(doc[: len(rolled)] == doc[n - 1 :])
    return at, mix(rolled[at])
