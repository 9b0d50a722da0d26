"""Packing token ids into sequences by reciprocal-capacity classes.

A text's ids are cut into full sequences and a rest. The rest is cut, largest first, at the slot sizes capacity // k, until
what is left lies within ``SLACK`` of a slot or is small (under capacity // ``CLASSES``). A piece of class k, longer than
capacity // (k + 1) and at most capacity // k, goes into a bin that takes k pieces of that class: filled by count alone, so
every worker fills its own bins and no two have to agree. Small pieces are laid end to end and cut where a sequence is
full. At the end of a worker's rows its unfilled bins, at most one a class, are laid end to end in the same way, so that a
worker leaves one unfilled sequence. Padding is thus at most SLACK a slot and one sequence a worker.

One narrow map, no shuffle; a worker holds one open bin a class (``CLASSES`` sequences of ids) and one chunk of texts. A
sequence's id is the partition's number times 2**32 plus a count, so a redone task gives the same ids.

Results by definition: a null or empty text has the one id that ends a text; equal rows are packed twice; null ids stay
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.llm.text import bounded_batches, chunks
from lapidary.llm.tokens import encoder

CAPACITY = 2048
CLASSES = 16
SLACK = 1 / 64
END_ID = 1
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bin_class", pa.int32())])
FLUSH = 20_000


def cut(n: int, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of n ids, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k >= classes or capacity // k - rest <= slack * (capacity // k):
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class Packer:
    """One worker's bins. ``add`` and ``finish`` give rows (doc_id, start, ids, doc_tokens, sequence, offset, class)."""

    def __init__(self, first: int, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK):
        self.capacity, self.classes, self.slack = capacity, classes, slack
        self.next, self.bins, self.loose, self.loose_at = first, {}, None, 0

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _lay(self, doc, start: int, ids: np.ndarray, tokens: int):
        """End to end, cut where the sequence is full."""
        while len(ids):
            if self.loose is None:
                self.loose, self.loose_at = self._new(), 0
            part = ids[: self.capacity - self.loose_at]
            yield doc, start, part, tokens, self.loose, self.loose_at, self.classes
            start, ids, self.loose_at = start + len(part), ids[len(part) :], self.loose_at + len(part)
            if self.loose_at == self.capacity:
                self.loose = None

    def add(self, doc, ids: np.ndarray):
        start, tokens = 0, len(ids)
        for n in cut(tokens, self.capacity, self.classes, self.slack):
            part = ids[start : start + n]
            k = self.capacity // n
            if k >= self.classes:
                yield from self._lay(doc, start, part, tokens)
            elif k == 1:
                yield doc, start, part, tokens, self._new(), 0, 1
            else:
                held = self.bins.setdefault(k, [])
                held.append((doc, start, part.copy(), tokens))
                if len(held) == k:
                    yield from self._close(k)
            start += n

    def _close(self, k: int):
        sequence, at = self._new(), 0
        for doc, start, part, tokens in self.bins.pop(k):
            yield doc, start, part, tokens, sequence, at, k
            at += len(part)

    def finish(self):
        for k in sorted(self.bins):
            for held in self.bins[k]:
                yield from self._lay(*held)
        self.bins = {}


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bin_class.

    ``vocabulary`` is the path of a tokenizers file that every executor has.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode = TaskContext.get(), encoder(vocabulary).encode
        packer = Packer((task.partitionId() if task else 0) << 32, capacity, classes, slack)
        rows = []

        def take(found):
            for doc, start, ids, tokens, sequence, at, k in found:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, sequence, at, k))

        def flush():
            columns = zip(*rows) if rows else [[]] * len(SCHEMA)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)
            rows.clear()
            return batch

        for chunk in chunks(batches):
            ids, bounds = encode(chunk)
            for i, doc in enumerate(chunk.rows.column("doc_id").to_pylist()):
                take(packer.add(doc, np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id))))
            if len(rows) > FLUSH:
                yield flush()
        take(packer.finish())
        yield flush()

    return docs.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bin_class int")
