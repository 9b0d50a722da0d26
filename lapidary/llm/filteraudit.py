"""Audit of how filters act together: for every order of the filters, what each step removes, and each filter's Shapley share.

A document is known by its mask, the set of the filters that it fails. Counts by (part, mask), the cells, decide everything:
a filter removes at its step the documents whose mask has it and none of the filters before. The orders are visited by a
walk on which each differs from the last by one swap of neighbours (``walk``, the plain-changes order). Such a swap leaves
what stands before and after the two filters as it was, so only two steps are read from the cells again. A filter's
removals are summed along the walk, each order counted once: its Shapley share times the number of orders.

Scale: documents are measured in one narrow pass (numpy over whole texts, a digest in the JVM), after which a row of some
60 bytes stands for each. Equal rows are counted before they are shuffled, and the first holder of a text is found by its
digest and met again by (digest, id), so a text that a third of the corpus shares is no hot key. Cells are at most
2**filters a part; parts are dealt over tasks and each part's orders are made there. No table is broadcast by force.

Results by definition: a null text is an empty one, a null part the empty string; a null id is smaller than none and
none is smaller than it, so such a row is never a copy, nor is anything a copy of it; rows that repeat id and text are no
copies of each other; a label counts if any row of ``labels`` with that id has it as 1; an empty table gives no rows; other
columns are ignored. Words are compared by 64-bit hashes within their text, texts by SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.llm.store import shared_folder
from lapidary.llm.text import bounded_batches, chunks

FILTERS = "ABCDE"
FEW_WORDS = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 2
SYMBOLS = b"#$%&*|"
PARTS_AT_ONCE = 64


def walk(n: int) -> Iterator[tuple[list[int], int | None]]:
    """Every order of n things, and the place whose thing was swapped with the next one to get there (none at the start).

    The largest thing that can move does: each moves in its direction until the end or a larger thing, and those larger
    than the one that moved turn round.
    """
    order, step = list(range(n)), [-1] * n
    yield order, None
    while True:
        for thing in reversed(range(n)):
            at = order.index(thing)
            to = at + step[thing]
            if 0 <= to < n and order[to] < thing:
                break
        else:
            return
        order[at], order[to] = order[to], order[at]
        step[thing + 1 :] = [-s for s in step[thing + 1 :]]
        yield order, min(at, to)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Rows (doc_id, part, digest, mask): which of the filters A to D a text fails, as bits."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    others = ["doc_id", "part", "digest"]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            start, end, doc = chunk.words()
            words = np.bincount(doc, minlength=len(chunk))
            h = chunk.hashes(start, end)
            by = np.lexsort((h, doc))
            h, doc = h[by], doc[by]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            distinct = np.bincount(doc[new], minlength=len(chunk))
            capitals = chunk.per_text((chunk.buf >= 0x41) & (chunk.buf <= 0x5A))
            points = chunk.points(chunk.bounds[:-1], chunk.bounds[1:])
            fails = [words < FEW_WORDS, 100 * distinct < DISTINCT_PERCENT * words, 100 * capitals > CAPITALS_PERCENT * points, chunk.per_text(symbol[chunk.buf]) > 0]
            mask = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
            yield pa.RecordBatch.from_arrays([*(chunk.rows.column(c) for c in others), pa.array(mask, pa.int32())], names=[*others, "mask"])

    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells (part, mask, n, good, toxic) with filter E, a copy of a text of a smaller id, as the fifth bit."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "filters")
    # equal rows are one; the only table of a row a document
    measured(docs).groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    known = rows.where("doc_id is not null").join(first, ["digest", "doc_id"], "left").join(told, "doc_id", "left")
    known = known.select("part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(16)).alias("mask"), "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    nameless = rows.where("doc_id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return known.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in ("good", "toxic")))


_MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_orders(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row (part, filter_order, step, ...) for each part, order of the filters and step, from cells (part, mask, n, good, toxic)."""
    k = len(filters)
    masks = np.arange(1 << k)
    lists = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2**k at most

    def steps(cell: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Orders, and measures by (part, order, step); ``cell``: by (n, good, toxic), part and mask."""
        has = [masks >> f & 1 == 1 for f in range(k)]
        own = np.empty((len(_MEASURES) - 1, cell.shape[1], k), np.int64)
        share, orders, out = np.zeros((cell.shape[1], k), np.int64), [], []

        def read(step: int, order: list[int]) -> None:
            f, before = order[step], sum(1 << g for g in order[:step])
            here = has[f] & (masks & before == 0)
            own[1, :, step], own[4, :, step], own[5, :, step] = cell[:, :, here].sum(axis=2)
            own[0, :, step] = cell[0][:, masks & (before | 1 << f) == 0].sum(axis=1)
            own[2, :, step] = cell[0][:, has[f] & (masks & before != 0)].sum(axis=1)
            own[3, :, step] = cell[0][:, 1 << f]

        for order, swapped in walk(k):
            for step in range(k) if swapped is None else (swapped, swapped + 1):
                read(step, order)
            share[:, order] += own[1]
            orders.append(list(order))
            out.append(own.copy())
        shapley = np.stack([share[:, order] for order in orders])
        return ["".join(filters[f] for f in order) for order in orders], np.concatenate([np.stack(out, axis=1), shapley[None]]).transpose(0, 2, 1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                rows = batch.slice(at, PARTS_AT_ONCE)
                held = rows.column("cells")
                owner = np.repeat(np.arange(len(rows)), held.value_lengths().to_numpy())
                cell = np.zeros((3, len(rows), 1 << k), np.int64)
                flat = held.flatten()
                for i, name in enumerate(("n", "good", "toxic")):
                    cell[i, owner, flat.field("mask").to_numpy()] = flat.field(name).to_numpy()
                orders, found = steps(cell)
                each = len(orders) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("part").take(pa.array(np.repeat(np.arange(len(rows)), each))),
                        pa.array(np.repeat(np.array(orders), k)[np.tile(np.arange(each), len(rows))].tolist(), pa.string()),
                        pa.array(np.tile(np.arange(k) + 1, len(rows) * len(orders)), pa.int32()),
                        *(pa.array(m.ravel()) for m in found),
                    ],
                    names=["part", "filter_order", "step", *_MEASURES],
                )

    return lists.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in _MEASURES))
