"""Quality rules: how much of a text stands in repeated n-grams and lines.

Rolling hashes of two to ten words are taken in numpy over whole texts. A text passes when the share of its word
characters inside repeats stays under the limits of ``LIMITS``, the ones published for a large web corpus (Rae et al.,
2021): its most frequent 2-, 3- and 4-gram, all repeated 5- to 10-grams, and repeated lines.

Each text is judged alone, so the operator is one narrow map over the scan: no shuffle, memory bounded by a chunk of
texts, and a lost task is redone from its input split. Two different n-grams of one text are taken as equal only when
their 64-bit hashes agree, about once in 10**11 texts of a thousand words.

Results by definition: a null or empty text has no words and fails the base rule; texts without a word have every
share 0; equal rows get equal results; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.llm.text import SPACE, Chunk, bounded_batches, chunks, mix, windows

#: Largest share allowed for each measure.
LIMITS = {
    "dup_lines": 0.30,
    "dup_line_chars": 0.20,
    "top_2gram": 0.20,
    "top_3gram": 0.18,
    "top_4gram": 0.16,
    "dup_5gram": 0.15,
    "dup_6gram": 0.14,
    "dup_7gram": 0.13,
    "dup_8gram": 0.12,
    "dup_9gram": 0.11,
    "dup_10gram": 0.10,
}
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
MIN_WORDS, MAX_REPEAT_PERCENT, BASE_WINDOW = 50, 50, 3
_U = np.uint64


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts the keys, where each run of equal keys begins, and how long it is."""
    order = np.argsort(key)
    ordered = key[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(key)))


def _covered(at: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words stand in a window of n words beginning at one of the given words."""
    edge = np.bincount(at, minlength=words + 1)[: words + 1] - np.bincount(at + n, minlength=words + 1)[: words + 1]
    return np.cumsum(edge[:words]) > 0


def measure(chunk: Chunk) -> dict[str, np.ndarray]:
    """Counts and shares of each text of the chunk."""
    texts = len(chunk)
    start, end, doc = chunk.words()
    h, chars = chunk.hashes(start, end), chunk.points(start, end)
    per = lambda which, weight=None: np.bincount(which, weight, minlength=texts)
    n_words, word_chars = per(doc).astype(np.int64), per(doc, chars).astype(np.int64)
    total = np.maximum(word_chars, 1)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": chunk.per_text(SYMBOLS[chunk.buf])}

    ls, le, ld = chunk.lines()
    has_word = np.zeros(len(chunk.buf) + 1, np.int64)
    np.cumsum(~SPACE[chunk.buf], out=has_word[1:])
    some = has_word[le] > has_word[ls]
    ls, le, ld = ls[some], le[some], ld[some]
    order, first, run = _repeated(mix(chunk.hashes(ls, le) + ld.astype(_U)))
    again = np.ones(len(ls), bool)
    again[np.minimum.reduceat(order, first) if len(first) else first] = False
    out["n_dup_lines"] = per(ld[again]).astype(np.int64)
    out["dup_lines"] = out["n_dup_lines"] / np.maximum(per(ld), 1)
    inside = np.concatenate([[0], np.cumsum(chars)])
    line_chars = inside[np.searchsorted(start, le)] - inside[np.searchsorted(start, ls)]
    out["dup_line_chars"] = per(ld[again], line_chars[again]) / total

    for n in (2, 3, 4, 5, 6, 7, 8, 9, 10):
        at, key = windows(h, doc, n)
        order, first, run = _repeated(mix(key + doc[at].astype(_U)))
        many = run > 1
        if n <= 4:
            some = at[order[first[many]]]
            best = np.zeros(texts)
            np.maximum.at(best, doc[some], run[many] * (inside[some + n] - inside[some]))
            out[f"top_{n}gram"] = np.minimum(best / total, 1.0)
        if n == BASE_WINDOW or n > 4:
            hit = _covered(at[order[np.repeat(many, run)]], n, len(h))
            if n == BASE_WINDOW:
                out["n_repeat_words"] = per(doc[hit]).astype(np.int64)
            else:
                out[f"dup_{n}gram"] = per(doc[hit], chars[hit]) / total
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n_words)
    out["kept"] = ~out["base_failed"]
    for name, limit in LIMITS.items():
        out["kept"] &= out[name] <= limit
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, counts, base_failed, kept and the measured shares."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [pa.field("doc_id", pa.int64())] + [pa.field(c, pa.int64()) for c in COUNTS]
    fields += [pa.field(c, pa.bool_()) for c in ("base_failed", "kept")] + [pa.field(c, pa.float64()) for c in LIMITS]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found = measure(chunk)
            found["doc_id"] = chunk.rows.column("doc_id")
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) if f.name != "doc_id" else found["doc_id"] for f in schema], schema=schema)

    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
    return docs.mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))
