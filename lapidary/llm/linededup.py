"""Line dedup over sharded cuckoo filters backed by exact reference counts; insertions and deletions of documents.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; keys of ``MIN_CHARS`` code points
or more count. Keys are compared by 128-bit hash. The index is three tables:

* postings (k1, k2, doc, row, line, first): where each key stands; ``row`` is a hash of the text, which tells apart rows
  that share an id; ``first`` marks the key's first line in its row;
* refs (k1, k2, refs, owner, last, layers): in how many rows, the smallest and largest id of these, and the filter layers
  that hold the key's entries;
* filters (shard, filter): cuckoo filters of the shard's keys. A key has one entry, or two where it stands in several
  documents, so that a probe tells "absent", "in one document" and "in several"; a batch that finds no room adds a layer.

``insert`` probes the filters with a batch's keys: what they don't know is new and goes straight to the refs, the rest is
merged with them by an exact join. How many entries a key gets, and which are taken out of which layer by ``delete``,
follows from the exact refs alone, so that a filter's chance hits change nothing and the index is again what it was.
``dedup`` probes the filters with each line's key and looks up only lines that may be repeated in the exact table of their
shard.

Scale: postings are counted by key before any key's rows meet (partial aggregation), so a line in a third of all documents
is one row a task. The first insertion fixes the number of shards, ``SHARD_KEYS`` keys each at most and two a shuffle partition at least; an index
that has grown many times over is built anew. When lines are probed, keys that hold over 1/``HEAVY`` of all postings (fewer than ``HEAVY``
keys, which bounds that broadcast) are spread over ``SALTS`` tasks, the other keys are routed by hash; a task streams its
lines past its shard's filter and table. Texts are shuffled once, by document, to meet their dropped lines.

Results by definition: a null or empty text is one empty line; null ids count as one document, before all others; lines of
rows with one id never drop each other; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.llm.cuckoo import LOAD, SLOTS, CuckooFilter
from lapidary.llm.store import shared_folder
from lapidary.llm.text import SPACE, Chunk, bounded_batches, chunks

MIN_CHARS = 10
SHARD_KEYS = 1 << 16
HEAVY = 2048
SALTS = 64
MOST_BROADCAST = 100_000
NULL_ID = -(2**63)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_U = np.uint64
POSTING = "doc long, row long, k1 long, k2 long, line int, first boolean"
REF = "k1 long, k2 long, refs long, owner long, last long, layers array<int>"


@dataclass
class LineIndex:
    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int | None  # None: empty, not known yet

    def write(self, path: str) -> LineIndex:
        """The index as tables under ``path``, lineage cut."""
        spark = self.refs.sparkSession
        for name in ("postings", "refs", "filters"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        return LineIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "refs", "filters")), self.shards)


def empty_index(spark: SparkSession) -> LineIndex:
    return LineIndex(spark.createDataFrame([], POSTING), spark.createDataFrame([], REF), spark.createDataFrame([], "shard int, filter binary"), None)


def row_key(text: Column) -> Column:
    """A hash that tells apart rows that share an id."""
    return F.xxhash64(text.cast("string"))


def _shard(shards: int) -> Column:
    return F.pmod("k1", F.lit(shards)).cast("int").alias("shard")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line whose key counts: doc, row, k1, k2, line, first."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"), row_key(F.col(text_col)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            start, end, owner = chunk.lines()
            solid = np.append(np.flatnonzero(~SPACE[chunk.buf]), len(chunk.buf))
            a = np.minimum(solid[np.searchsorted(solid, start)], end)
            b = np.maximum(np.where(a < end, solid[np.maximum(np.searchsorted(solid, end) - 1, 0)] + 1, a), a)
            line = np.arange(len(start)) - np.searchsorted(owner, owner)
            counts = chunk.points(a, b) >= MIN_CHARS
            a, b, owner, line = a[counts], b[counts], owner[counts], line[counts]
            low = _LOWER[chunk.buf]
            k1 = Chunk(chunk.rows, low, chunk.bounds).hashes(a, b)
            k2 = Chunk(chunk.rows, low ^ np.uint8(0x5A), chunk.bounds).hashes(a, b)
            order = np.lexsort((line, k2, k1, owner))
            first = np.ones(len(a), bool)
            same = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1]) & (owner[order][1:] == owner[order][:-1])
            first[order[1:][same]] = False
            ids, rows = (chunk.rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[owner]), pa.array(rows[owner]), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(line, pa.int32()), pa.array(first)],
                names=["doc", "row", "k1", "k2", "line", "first"],
            )

    return docs.mapInArrow(run, POSTING)


def _load(raw: bytes) -> list[CuckooFilter]:
    layers, at = [], 0
    while at < len(raw):
        (n,) = struct.unpack_from("<q", raw, at)
        layers.append(CuckooFilter.from_bytes(raw[at + 8 : at + 8 + n]))
        at += 8 + n
    return layers


def _dump(layers: list[CuckooFilter]) -> bytes:
    return b"".join(struct.pack("<q", len(raw)) + raw for raw in (layer.to_bytes() for layer in layers))


def _count(layers: list[CuckooFilter], h: np.ndarray) -> np.ndarray:
    return sum((layer.count(h) for layer in layers), np.zeros(len(h), np.int64))


def _streamed(rows: DataFrame, keys: list[str], schema: str, visit) -> DataFrame:
    """Deal rows out by the keys, sorted by (keys, kind), and call ``visit(kind, batch)`` for every run of one kind.

    ``visit`` is made afresh for each partition; it also gets (None, None) at the end of each key's rows.
    """
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle, last = visit(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in [*keys, "kind"]])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                key = tuple(marks[:-1, a])
                if last is not None and key != last:
                    yield from handle(None, None, last)
                last = key
                yield from handle(int(marks[-1, a]), batch.slice(a, b - a), key)
        if last is not None:
            yield from handle(None, None, last)

    return rows.mapInArrow(run, schema)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


_KNOWN = pa.schema([("k1", pa.int64()), ("k2", pa.int64())])


def _seen():
    """Which of a batch's keys the filters may hold."""
    layers: list[CuckooFilter] = []

    def handle(kind, batch, key):
        nonlocal layers
        if kind == 0:
            layers = _load(batch.column("filter")[0].as_py())
        elif kind == 1:
            hit = np.flatnonzero(_count(layers, _column(batch, "k1").view(_U)) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(hit)) for c in ("k1", "k2")], schema=_KNOWN)
        else:
            layers = []

    return handle


def _put_in():
    """Insert the keys' new entries; a row (shard, filter, layer) says into which layer."""
    layers: list[CuckooFilter] = []
    fresh: list[np.ndarray] = []

    def handle(kind, batch, key):
        nonlocal layers, fresh
        if kind == 0:
            layers = _load(batch.column("filter")[0].as_py())
        elif kind == 1:
            fresh.append(np.repeat(_column(batch, "k1").view(_U), _column(batch, "times")))
        else:
            new = np.concatenate(fresh) if fresh else np.zeros(0, _U)
            room = layers[-1].table.size * LOAD - np.count_nonzero(layers[-1].table) if layers else 0
            if len(new) > room:
                layers.append(CuckooFilter.sized(len(new)))
            if len(new):
                layers[-1].insert(new)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([_dump(layers)], pa.binary()), pa.array([len(layers) - 1], pa.int32())], names=["shard", "filter", "layer"])
            layers, fresh = [], []

    return handle


def _take_out():
    """Delete the entries (k1, layer) that are no longer due."""
    layers: list[CuckooFilter] = []

    def handle(kind, batch, key):
        nonlocal layers
        if kind == 0:
            layers = _load(batch.column("filter")[0].as_py())
        elif kind == 1:
            h, which = _column(batch, "k1").view(_U), _column(batch, "times")
            for i in np.unique(which):
                layers[i].delete(h[which == i])
        else:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([_dump(layers)], pa.binary())], names=["shard", "filter"])
            layers = []
        yield from ()

    return handle


def _with_filters(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """The shards' filters (kind 0) and the keys that go to them (kind 1)."""
    old = filters.select("shard", F.lit(0).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in ("k1", "k2", "times")), "filter")
    return old.unionByName(keys.withColumn("kind", F.lit(1)).withColumn("filter", F.lit(None).cast("binary")), allowMissingColumns=True)


def _counted(found: DataFrame) -> DataFrame:
    return found.where("first").groupBy("k1", "k2").agg(F.count("*").alias("refs"), F.min("doc").alias("owner"), F.max("doc").alias("last"))


def _due(owner: str = "owner", last: str = "last") -> Column:
    """How many filter entries a key of these ids has."""
    return F.when(F.col(owner) < F.col(last), 2).otherwise(1).cast("long")


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """The index with these documents, whose ids it must not hold yet. Texts are read once."""
    return insert_postings(index, postings(docs, id_col, text_col))


def insert_postings(index: LineIndex, found: DataFrame) -> LineIndex:
    found = _kept(found, "postings")
    counted = _kept(_counted(found), "lines")
    old = index.shards is not None
    if not old:
        # never so few that tasks stand idle
        tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        index = replace(index, shards=max(2 * tasks, -(-counted.count() // SHARD_KEYS)))
    shard = _shard(index.shards)
    none = F.array().cast("array<int>")
    if old:
        # a filter that answers wrongly sends a new key through the join, which is exact
        maybe = _kept(_streamed(_with_filters(index.filters, counted.select(shard, "k1", "k2")), ["shard"], "k1 long, k2 long", _seen), "known")
        before = index.refs.join(maybe, ["k1", "k2"], "left_semi").select("k1", "k2", *(F.col(c).alias(f"_{c}") for c in ("refs", "owner", "last", "layers")))
        merged = counted.join(before, ["k1", "k2"], "left")
        merged = merged.select("k1", "k2", (F.col("refs") + F.coalesce("_refs", F.lit(0))).alias("refs"), F.least("owner", "_owner").alias("owner"), F.greatest("last", "_last").alias("last"), F.coalesce("_layers", none).alias("layers"))
        merged = _kept(merged, "merged")
    else:
        merged = counted.withColumn("layers", none)
    merged = merged.withColumn("times", _due() - F.size("layers"))
    filters = _kept(_streamed(_with_filters(index.filters, merged.where("times > 0").select(shard, "k1", "times")), ["shard"], "shard int, filter binary, layer int", _put_in), "filters")
    # one small row a shard says into which layer this batch's entries went
    layer = filters.select("shard", "layer")
    grown = merged.withColumn("shard", shard).join(F.broadcast(layer) if index.shards <= MOST_BROADCAST else layer, "shard")
    grown = grown.select("k1", "k2", "refs", "owner", "last", F.concat("layers", F.array_repeat("layer", F.col("times").cast("int"))).alias("layers"))
    refs = grown if not old else index.refs.join(counted, ["k1", "k2"], "left_anti").unionByName(grown)
    return LineIndex(index.postings.unionByName(found) if old else found, refs, filters.select("shard", "filter"), index.shards)


def delete(index: LineIndex, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """The index without the documents of these ids; ids that it doesn't hold change nothing."""
    if index.shards is None:
        return index
    gone = ids.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc")).distinct()
    kept = index.postings.join(gone, "doc", "left_anti")
    hit = index.postings.join(gone, "doc", "left_semi").select("k1", "k2").distinct()
    left = _counted(kept.join(hit, ["k1", "k2"], "left_semi"))
    changed = index.refs.join(hit, ["k1", "k2"], "left_semi").select("k1", "k2", "layers").join(left, ["k1", "k2"], "left")
    changed = _kept(changed.withColumn("due", F.when(F.col("refs").isNull(), 0).otherwise(_due())), "changed")
    less = changed.select(_shard(index.shards), "k1", F.explode(F.expr("transform(slice(layers, cast(due as int) + 1, 2), x -> cast(x as long))")).alias("times"))
    filters = _streamed(_with_filters(index.filters, less), ["shard"], "shard int, filter binary", _take_out)
    still = changed.where("refs is not null").select("k1", "k2", "refs", "owner", "last", F.expr("slice(layers, 1, cast(due as int))").alias("layers"))
    return LineIndex(kept, index.refs.join(hit, ["k1", "k2"], "left_anti").unionByName(still), filters, index.shards)


_DROP = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("line", pa.int32())])


def _probe():
    layers: list[CuckooFilter] = []
    table: list[np.ndarray] = []
    exact = None

    def handle(kind, batch, key):
        nonlocal layers, table, exact
        if kind == 0:
            layers = _load(batch.column("filter")[0].as_py())
        elif kind == 1:
            table.append(np.rec.fromarrays([_column(batch, c) for c in ("k1", "k2", "doc")], names="k1,k2,owner"))
        elif kind == 2:
            if exact is None:
                rows = np.concatenate(table) if table else np.zeros(0, [("k1", "i8"), ("k2", "i8"), ("owner", "i8")])
                exact = rows[np.lexsort((rows["k2"], rows["k1"]))]
            k1, k2, doc = (_column(batch, c) for c in ("k1", "k2", "doc"))
            maybe = np.flatnonzero(_count(layers, k1.view(_U)) > 1)
            at = np.searchsorted(exact["k1"], k1[maybe])
            drop = np.zeros(len(maybe), bool)
            # keys of equal first half stand together; one step suffices unless 64-bit hashes collide
            while len(maybe):
                inside = at < len(exact)
                same = np.zeros(len(maybe), bool)
                same[inside] = exact["k1"][at[inside]] == k1[maybe[inside]]
                found = same.copy()
                found[same] = exact["k2"][at[same]] == k2[maybe[same]]
                drop[found] = exact["owner"][at[found]] != doc[maybe[found]]
                if not (same & ~found).any():
                    break
                at = at + (same & ~found)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(maybe[drop])) for c in ("doc", "row", "line")], schema=_DROP)
        else:
            layers, table, exact = [], [], None

    return handle


def dropped_lines(found: DataFrame, index: LineIndex) -> DataFrame:
    """Of these postings, the lines (doc, row, line) that other documents' lines make redundant."""
    if index.shards is None:
        return found.sparkSession.createDataFrame([], "doc long, row long, line int")
    nothing = {"row": "long", "line": "int", "filter": "binary"}
    empty = lambda *names: (F.lit(None).cast(nothing[c]).alias(c) for c in names)
    shard = _shard(index.shards)
    repeated = index.refs.where("owner < last").select("k1", "k2", F.col("owner").alias("doc"), "refs")
    total = F.broadcast(index.refs.agg(F.sum("refs").alias("total")))
    heavy = F.broadcast(repeated.join(total).where(F.col("refs") * HEAVY > F.col("total")).select("k1", "k2", F.lit(True).alias("heavy")))  # fewer than HEAVY rows
    salts = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    state = repeated.join(heavy, ["k1", "k2"], "left").select(shard, F.explode(salts).alias("salt"), F.lit(1).alias("kind"), "k1", "k2", "doc", *empty("row", "line", "filter"))
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("doc", "row"), F.lit(SALTS))).otherwise(0).cast("int")
    lines = found.join(heavy, ["k1", "k2"], "left").select(shard, salt.alias("salt"), F.lit(2).alias("kind"), "k1", "k2", "doc", "row", "line", *empty("filter"))
    # a salted task holds heavy keys only: where it has no filter of its own, its table alone decides
    spread = state.where("salt > 0").select("shard", "salt").distinct()
    own = index.filters.select("shard", F.lit(0).alias("salt"), "filter")
    filters = own.unionByName(index.filters.join(spread, "shard").select("shard", "salt", "filter"))
    first = filters.select("shard", "salt", F.lit(0).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in ("k1", "k2", "doc")), *empty("row", "line"), "filter")
    return _streamed(first.unionByName(state).unionByName(lines), ["shard", "salt"], "doc long, row long, line int", _probe)


def _without(text: str | None, gone: list[int] | None) -> tuple[str, int]:
    lines = (text or "").split("\n")
    if gone:
        out = set(gone)
        return "\n".join(x for i, x in enumerate(lines) if i not in out), len(lines)
    return text or "", len(lines)


def dedup(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, whole: bool = False) -> DataFrame:
    """The documents with their kept lines as text, and n_lines (before) and n_dropped.

    ``whole`` says that the index holds just these documents, so that their lines needn't be found again.
    With ``digest`` the result is doc_id, n_lines, n_dropped and kept_sha256 instead, and no texts.
    """
    spark = docs.sparkSession
    lines = index.postings if whole else postings(docs, id_col, text_col)
    drops = dropped_lines(lines.select("doc", "row", "k1", "k2", "line"), index).groupBy("doc", "row").agg(F.collect_set("line").alias("gone"))
    others = [c for c in docs.columns if c != text_col] if not digest else [id_col]
    left = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_doc"), row_key(F.col(text_col)).alias("_key"), F.struct(*map(F.col, others)).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    met = left.join(drops, (left["_doc"] == drops["doc"]) & (left["_key"] == drops["row"]), "left").select("_row", "_text", "gone")
    bounded_batches(spark)
    kind = met.schema["_row"].dataType.simpleString()
    if digest:

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = [_without(t, g) for t, g in zip(batch.column("_text").to_pylist(), batch.column("gone").to_pylist())]
                dropped = [len(g or ()) for g in batch.column("gone").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([n for _, n in kept], pa.int64()), pa.array(dropped, pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t, _ in kept])], names=["_row", "n_lines", "n_dropped", "kept_sha256"])

        out = met.mapInArrow(hashed, f"_row {kind}, n_lines long, n_dropped long, kept_sha256 string")
        return out.select(F.col(f"_row.{id_col}").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_without(t, g) for t, g in zip(batch.column("_text").to_pylist(), batch.column("gone").to_pylist())]
            dropped = [len(g or ()) for g in batch.column("gone").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64()), pa.array(dropped, pa.int64())], names=["_row", "_text", "n_lines", "n_dropped"])

    out = met.mapInArrow(rewritten, f"_row {kind}, _text string, n_lines long, n_dropped long")
    back = [F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return out.select(*back, *(F.col(c) for c in ("n_lines", "n_dropped") if c not in docs.columns))
