"""Near-duplicates by SetSketch registers: band register values, estimate jointly by likelihood, then verify.

A document's set is that of its distinct word shingles, A-Z lower-cased. Each of ``REGISTERS`` registers looks at every
shingle through an exponential random number of its own and keeps the least, on a scale of powers of ``BASE``, as one byte:
floor(1 - log(least)), cut to 0..255. Larger bytes belong to smaller minima, so the sketch of a union is the larger of two
bytes at each register (``merge``), and equal bytes are the likelier the more two sets have in common (``agreement``).

* Bands: registers are cut into bands whose number and width follow from the recall wanted at the threshold, by that law.
  Documents that share a band are candidates; the places where they meet are those of the n-gram join.
* Joint estimate: at these places sketches meet first, 256 bytes a document. For each pair three counts, of registers that
  are larger at the one, at the other, or equal, and the two known set sizes give a likelihood of the similarity, whose
  maximum is the estimate. A pair stays unless its estimate is ``MARGIN`` standard errors below the threshold (a pair at
  the threshold is lost so once in 30,000), or its sizes alone exclude it. Documents without such a pair go no further.
* Verification: texts of the rest go to the same places, and pairs are confirmed on full shingle sets.

Scale: texts of equal words are one node with a count; the only tables of a row a document are sketches (some 300 bytes)
and the result. Large groups are dealt into pairs of blocks or into buckets, hot keys are answered by broadcasts bounded by
1 / HEAVY, and components come from contraction rounds, as in the n-gram join. A dense group of g different texts costs
g**2 comparisons of bytes, never g**2 rows.

Results by definition: null texts and texts without a word have an empty set and are linked with nothing; a null id counts
below all others and comes back as null (kept); rows that repeat an id are documents of their own, of which each has the
class of its text; an empty table gives no rows; other columns are ignored. Texts and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.llm.ngramjoin import BLOCK, HEAVY, MOST_BROADCAST, NULL_ID, _looked_up, _places, _runs, _Tables, _verify, components, minima, shingles, text_key
from lapidary.llm.text import LOWER, bounded_batches, chunks

WORDS = 4
THRESHOLD = 0.8
RECALL = 0.999
REGISTERS = 256
BASE = 1.2
RATE = 20.0
MARGIN = 4.0
_STEPS = 24  # halvings of the range of an estimate


def registers(least: np.ndarray, base: float = BASE, rate: float = RATE) -> np.ndarray:
    """Register bytes from the least 32-bit hashes: the hash as a share of 1 is 1 - exp(-rate * x) of an exponential x."""
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / (1 << 32)) / rate
    return np.clip(np.floor(1 - np.log(x) / np.log(base)), 0, 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def _larger(share: np.ndarray, base: float = BASE) -> np.ndarray:
    """Chance that a register is larger at the set whose own elements are ``share`` of both sizes' sum."""
    return -np.log1p(-share * (base - 1) / base) / np.log(base)


def agreement(similarity: float, own: np.ndarray, base: float = BASE) -> np.ndarray:
    """Chance that a register is equal; ``own``: the first set's part of both sizes' sum."""
    return 1 - _larger(np.maximum(own - (1 - own) * similarity, 0), base) - _larger(np.maximum(1 - own - own * similarity, 0), base)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = REGISTERS, base: float = BASE) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at the threshold with this probability, whatever its sizes."""
    own = np.linspace(threshold / (1 + threshold), 1 / (1 + threshold), 101)
    equal = float(agreement(threshold, own, base).min())
    best = (1, 1)
    for rows in range(1, 33):
        bands = 1 if equal**rows >= 1 else int(np.ceil(np.log(1 - recall) / np.log1p(-(equal**rows))))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def estimate(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, own: np.ndarray, base: float = BASE) -> np.ndarray:
    """The likeliest similarity given how many registers are larger, smaller and equal, and the part of the sizes.

    The likelihood has one maximum, which is where its slope changes sign; the slope is halved in on for all pairs at once.
    """
    other, log = 1 - own, np.log(base)
    low, high = np.zeros(len(own)), np.minimum(own / other, other / own)
    factor = (base - 1) / base
    for _ in range(_STEPS):
        j = (low + high) / 2
        a, b = own - other * j, other - own * j
        chance, more = np.maximum(_larger(a, base), 1e-300), np.maximum(_larger(b, base), 1e-300)
        # of the chances, by the similarity
        da, db = -other * factor / ((1 - a * factor) * log), -own * factor / ((1 - b * factor) * log)
        slope = larger * da / chance + smaller * db / more - equal * (da + db) / np.maximum(1 - chance - more, 1e-300)
        up = slope > 0
        low, high = np.where(up, j, low), np.where(up, high, j)
    return (low + high) / 2


def standard_error(similarity: float, own: np.ndarray, count: int, base: float = BASE) -> np.ndarray:
    """Of an estimate from so many registers, by the information that they have at this similarity."""
    other, log, factor = 1 - own, np.log(base), (base - 1) / base
    a, b = np.maximum(own - other * similarity, 1e-9), np.maximum(other - own * similarity, 1e-9)
    chance, more = _larger(a, base), _larger(b, base)
    da, db = other * factor / ((1 - a * factor) * log), own * factor / ((1 - b * factor) * log)
    return 1 / np.sqrt(count * (da**2 / chance + db**2 / more + (da + db) ** 2 / (1 - chance - more)))


def may_be_near(left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs (left x right) of sketches stay."""
    a, b = left_size.astype(float)[:, None], right_size.astype(float)[None]
    out = np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9
    larger, equal = np.zeros(out.shape, np.int16), np.zeros(out.shape, np.int16)
    for r in range(left.shape[1]):
        x, y = left[:, r, None], right[None, :, r]
        larger += x > y
        equal += x == y
    x, y = np.nonzero(out)
    for at in range(0, len(x), 1 << 16):
        i, j = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
        own = left_size[i] / (left_size[i] + right_size[j])
        more, same = larger[i, j].astype(float), equal[i, j].astype(float)
        least = threshold - MARGIN * standard_error(threshold, own, left.shape[1])
        out[i, j] = estimate(more, left.shape[1] - more - same, same, own) >= least
    return out


_NEAR = pa.schema([("node", pa.int64()), ("g", pa.int64()), ("i", pa.int32()), ("j", pa.int32())])


def _estimated(threshold: float):
    """Nodes that have a pair which may be near, of those that meet in one place."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        node, side, group, size = (table.column(c).to_numpy() for c in ("node", "side", "comp", "size"))
        sketch = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint8).reshape(len(node), -1)
        order = np.lexsort((node, side, group))
        found = []
        for lo, hi in _runs(group[order]):
            rows = order[lo:hi]
            left, right = rows[side[rows] < 2], rows[side[rows] == 2]
            if len(right):
                near = may_be_near(sketch[left], size[left], sketch[right], size[right], threshold)
                found += [left[near.any(axis=1)], right[near.any(axis=0)]]
            elif len(left) > 1 and side[left[0]] == 0:
                near = may_be_near(sketch[left], size[left], sketch[left], size[left], threshold)
                np.fill_diagonal(near, False)
                found.append(left[near.any(axis=1)])
        own = np.concatenate(found) if found else np.zeros(0, np.int64)
        g, i, j = (k.as_py() for k in key)
        return pa.table([pa.array(node[own]), pa.array(np.full(len(own), g)), pa.array(np.full(len(own), i, np.int32)), pa.array(np.full(len(own), j, np.int32))], schema=_NEAR)

    return run


def sketched(docs: DataFrame, n: int = WORDS, count: int = REGISTERS) -> DataFrame:
    """Rows (doc_id, row_key, node, size, registers): node is a hash of the word sequence, null without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, fold=LOWER):
            key, doc, whole = shingles(chunk, n)
            by = np.lexsort((key, doc))
            key, doc = key[by], doc[by]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[new], doc[new]
            bytes_ = registers(minima(key, np.searchsorted(doc, np.arange(len(chunk) + 1)), count))
            size = np.bincount(doc, minlength=len(chunk)).astype(np.int64)
            held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(count), len(chunk), [None, pa.py_buffer(bytes_.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(chunk.rows.column(c) for c in ("doc_id", "row_key")), pa.array(whole.view(np.int64), mask=whole == 0), pa.array(size), held], names=["doc_id", "row_key", "node", "size", "registers"])

    return docs.mapInArrow(run, "doc_id long, row_key long, node long, size long, registers binary")


def near_duplicates(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over links), kept."""
    bounded_batches(docs.sparkSession)
    tables = _Tables(docs)
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(F.col(text_col)).alias("row_key"))
    every = tables.keep(sketched(docs, n))

    nodes = every.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("doc_id", "row_key")).alias("first_row"), F.count("*").alias("copies"), F.first("size").alias("grams"), F.first("registers").alias("registers"))
    nodes = tables.keep(nodes)
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.substring("registers", b * rows + 1, F.lit(rows))))
    entries = nodes.select(F.posexplode(band).alias("at", "band"), "node")
    buckets = tables.keep(entries.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1"))
    heavy = buckets.where(F.col("size") * HEAVY > bands * nodes.count()).select("band")
    met = _looked_up(entries.select("band", "node"), "band", buckets.select("band", "least"), heavy).where("least is not null")
    found = components(met.select(F.col("node").alias("a"), F.col("least").alias("b")), tables)
    places = tables.keep(_places(found, nodes, entries, buckets, block, tables))

    # sketches meet, then the texts of what may be near
    sketches = places.join(nodes.select("node", F.col("grams").alias("size"), "registers"), "node")
    near = tables.keep(sketches.groupBy("g", "i", "j").applyInArrow(_estimated(threshold), "node long, g long, i int, j int"))
    asked = near.select("node").distinct().join(nodes.select("node", "first_row"), "node").select("node", "first_row.doc_id", "first_row.row_key")
    asked = tables.keep(asked)
    asked = F.broadcast(asked) if asked.count() <= MOST_BROADCAST else asked.hint("merge")
    texts = docs.join(asked, ["doc_id", "row_key"]).groupBy("node").agg(F.first("text").alias("text"))
    to = places.join(near, ["node", "g", "i", "j"], "left_semi")
    verified = tables.keep(texts.join(to, "node").groupBy("g", "i", "j").applyInArrow(_verify(n, threshold, LOWER), "node long, links long, root long"))

    labels = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")), tables)
    classes = tables.keep(labels.join(nodes.select("node", "first_row"), "node").groupBy("label").agg(F.min("first_row.doc_id").alias("class_id"), F.count("*").alias("members")))
    classed = _looked_up(labels, "label", classes.drop("members"), classes.where(F.col("members") * HEAVY > labels.count()).select("label")).select("node", "class_id")
    known = tables.keep(nodes.select("node", "first_row", "copies").join(classed, "node", "left").select("node", F.coalesce("class_id", "first_row.doc_id").alias("class_id"), "copies"))
    # a text of many copies is one node with many rows
    copied = known.where(F.col("copies") * HEAVY > every.count()).select("node")
    out = _looked_up(every.where("node is not null").select("doc_id", "node", "size"), "node", known.drop("copies"), copied)
    out = out.unionByName(every.where("node is null").select("doc_id", "node", "size"), allowMissingColumns=True)
    class_id = F.coalesce("class_id", "doc_id")
    back = lambda c: F.when(c != NULL_ID, c)
    return out.select(back(F.col("doc_id")).alias("doc_id"), F.col("size").alias("n_shingles"), back(class_id).alias("component_id"), (F.col("doc_id") == class_id).alias("kept"))
