"""N-gram Jaccard self-join by MinHash banding.

Documents whose sets of word n-grams (five words; a shorter text is one n-gram) have a Jaccard similarity of ``threshold``
or more are linked. Equal texts form one node first. Each node's signature is cut into bands; band and row counts are
chosen for the target recall at the threshold (``choose_bands``). Nodes that share a band hash (stand in one bucket) are
candidates and verified on full n-gram sets, by counting shared n-grams as matrix products.

Where pairs meet. Candidates fall into components. A component of up to ``BLOCK`` nodes is verified in one place, all pairs
at once; small ones share places. A larger one is dealt into blocks, and each pair of blocks has a place, or, where that
sends fewer copies of texts, each of its buckets has one (in blocks again where the bucket is large): a group of near
copies shares most of its buckets, so pairs of blocks of the whole are cheaper, while a chain of loosely related texts has
many small buckets. A pair that shares several buckets counts in the smallest one.

Result: one row per document with ``class_id`` (the smallest id of the documents connected to it by links) and ``n_links``
(to how many other documents it is linked, copies included). Pairs are counted where they are verified and never become
rows, so a large group of near copies costs a row for each member and pair of blocks.

Scale: exact copies are pre-aggregated. Band rows are (hash, node); a bucket's smallest node comes from a partial
aggregate. Where rows look up a node or a bucket that holds over 1/``HEAVY`` of them, the answer is broadcast (fewer than
``HEAVY`` rows); the rest is shuffled. A block has at most ``BLOCK`` texts of ``GRAMS`` n-grams on average. Only candidates'
texts move: their rows are known by id and text hash. Components come from contraction rounds over (node, node) rows in
the shared folder; nothing but counts reaches the driver. All intermediate tables stand under spark.checkpoint.dir.

Results by definition: null texts and texts without a word have no n-grams: they are linked to nothing and are their own
class; null ids count as one id below all others and come back as null; rows that repeat an id are documents of their own;
an empty table gives no rows; other columns are ignored. Texts and n-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.llm.store import shared_folder
from lapidary.llm.text import Chunk, bounded_batches, chunks, mix, windows

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 256
BLOCK = 1024
GRAMS = 1_000_000
HEAVY = 1024
MOST_BROADCAST = 1_000_000  # rows of three numbers
COLUMNS = 4096
NULL_ID = -(2**63)
_U = np.uint64


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at the threshold with this probability."""
    best = (1, 1)
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= 1 else int(np.ceil(np.log(1 - recall) / np.log1p(-hit)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts' n-grams, their texts (ascending), and a hash of each text's word sequence (0: no word)."""
    start, end, doc = chunk.words()
    h = chunk.hashes(start, end)
    at, key = windows(h, doc, n)
    count = np.bincount(doc, minlength=len(chunk))
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < n))
    whole = np.zeros(len(chunk), _U)
    place = np.arange(len(h)) - np.repeat(first, count)
    if len(h):
        some = count > 0
        # a sum of mixed (word, place) pairs depends on the whole sequence
        whole[some] = mix(np.add.reduceat(mix(h + place.astype(_U) * _U(0x9E3779B97F4A7C15)), first[some]) + count[some].astype(_U)) | _U(1)
    doc_of = np.concatenate([doc[at], short])
    key = np.concatenate([key, whole[short]])
    order = np.argsort(doc_of, kind="stable")
    return key[order], doc_of[order], whole


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8_2011)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minima(key: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """The least of each of ``count`` 32-bit hashes (text x hash) over each text's n-grams ``key[bounds[i]:bounds[i + 1]]``."""
    a, b = _factors(count)
    a, b = a[:, None], b[:, None]
    small = (key >> _U(32)).astype(np.uint32)
    least = np.empty((len(bounds) - 1, count), np.uint32)
    for i, (x, y) in enumerate(zip(bounds, bounds[1:])):
        out = np.full(count, np.iinfo(np.uint32).max, np.uint32)
        for at in range(x, y, 2048):
            np.minimum(out, (small[None, at : min(at + 2048, y)] * a + b).min(axis=1), out=out)
        least[i] = out
    return least


def signatures(key: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (text x band) from each text's n-gram hashes ``key[bounds[i]:bounds[i + 1]]``."""
    least = minima(key, bounds, bands * rows)
    band = np.full((len(least), bands), 0, _U) + np.arange(1, bands + 1, dtype=_U)
    for r in range(rows):
        band = mix(band * _U(0x9E3779B97F4A7C15) + least.reshape(len(least), bands, rows)[:, :, r])
    return band


def text_key(text: Column) -> Column:
    """A hash that tells apart rows that share an id."""
    return F.xxhash64(F.lit(17), text.cast("string"))


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            key, doc, whole = shingles(chunk, n)
            band = signatures(key, np.searchsorted(doc, np.arange(len(chunk) + 1)), bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(chunk) + 1) * bands, pa.int32()), pa.array(band.view(np.int64).ravel()))
            grams = np.bincount(doc, minlength=len(chunk)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(chunk.rows.column(c) for c in others), pa.array(whole.view(np.int64), mask=whole == 0), lists, pa.array(grams)], names=[*others, "node", "bands", "grams"])

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in others) + ", node long, bands array<long>, grams long")


class _Tables:
    """Tables of one run under the shared folder."""

    def __init__(self, df: DataFrame):
        self.spark, self.folder, self.n = df.sparkSession, shared_folder(df.sparkSession, "ngrams"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.parquet(f"{self.folder}/{self.n}")


def _looked_up(rows: DataFrame, column: str, table: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Left join of stored ``rows`` with ``table`` on ``column``; values of over 1/HEAVY of the rows are answered by broadcast."""
    if heavy is None:
        heavy = rows.groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") * HEAVY > rows.count()).select(column)
    heavy = table.join(F.broadcast(heavy), column, "left_semi")  # fewer than HEAVY rows
    served = rows.join(F.broadcast(heavy), column)
    rest = rows.join(F.broadcast(heavy.select(column)), column, "left_anti").join(table, column, "left")
    return served.unionByName(rest)


def components(edges: DataFrame, tables: _Tables) -> DataFrame:
    """(node, label): for each node of the edges (a, b) the smallest reachable node, by rounds of contraction.

    Every round moves each node to its smallest neighbour and renames the edges, until none is left. Nodes are hashes, so
    their order is random and the rounds few.
    """
    rounds = []
    edges = tables.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
        least = tables.keep(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")))
        # two steps at once
        second = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = tables.keep(_looked_up(least, "label", second).select("node", F.coalesce("next", "label").alias("label")))
        rounds.append(step)
        to = lambda c: step.select(F.col("node").alias(c), F.col("label").alias(f"new_{c}"))  # noqa: B023, E731
        half = tables.keep(_looked_up(edges, "a", to("a")).select("new_a", "b"))
        moved = _looked_up(half, "b", to("b")).where("new_a <> new_b")
        edges = tables.keep(moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))

    def follow(found: DataFrame, step: DataFrame) -> DataFrame:
        step = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        return tables.keep(_looked_up(found, "label", step).select("node", F.coalesce("next", "label").alias("label")))

    return reduce(follow, rounds[1:], rounds[0])


_LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _shared(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many n-grams each pair of sets shares."""
    sets = left + (right or [])
    size = np.array([len(s) for s in sets])
    every, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    common = times > 1
    number = np.cumsum(common) - 1
    keep = common[back]
    column, owner = number[back[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right if right is not None else left)), np.float32)
    total = int(number[-1]) + 1 if len(number) else 0
    for at in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, total - at)), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m[: len(left)] @ (m[len(left) :] if right is not None else m).T
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    shared = _shared(left, right).astype(np.float64)
    a = np.array([len(s) for s in left], float)[:, None]
    b = np.array([len(s) for s in (left if right is None else right)], float)[None]
    out = shared >= threshold * (a + b - shared) - 1e-9
    if right is None:
        np.fill_diagonal(out, False)
    return out


def _roots(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of places 0..len(node)-1 with links (a, b): the smallest node reachable from each."""
    label = node.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            return label
        label = new


def _counts_here(hit: np.ndarray, left: np.ndarray, right: np.ndarray, place: int) -> None:
    """Clear linked pairs that share a smaller bucket than this one. ``left``, ``right``: bucket by band, 0 for none."""
    a, b = np.nonzero(hit)
    for at in range(0, len(a), 1 << 16):
        x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        both = (left[x] == right[y]) & (left[x] != 0)
        elsewhere = np.where(both, left[x], np.iinfo(np.int64).max).min(axis=1) != place
        hit[x[elsewhere], y[elsewhere]] = False


def _verify(n: int, threshold: float, fold: np.ndarray | None = None):
    def run(table: pa.Table) -> pa.Table:
        nodes, side, group, copies = (table.column(c).to_numpy() for c in ("node", "side", "comp", "copies"))
        buckets = table.column("buckets").combine_chunks()
        by_band = lambda rows: np.array([buckets[int(i)].as_py() for i in rows], np.int64)
        sets: list = []
        for batch in table.select(["node", "text"]).combine_chunks().to_batches():
            for chunk in chunks(iter([batch]), fold=fold):
                key, doc, _ = shingles(chunk, n)
                cut = np.searchsorted(doc, np.arange(len(chunk) + 1))
                sets += [np.unique(key[x:y]) for x, y in zip(cut, cut[1:])]
        order = np.lexsort((nodes, side, group))
        out = []
        for lo, hi in _runs(group[order]):
            own = order[lo:hi]
            left, right = own[side[own] < 2], own[side[own] == 2]
            if len(right):
                hit = _linked([sets[i] for i in left], [sets[i] for i in right], threshold)
                if buckets[int(own[0])].is_valid:
                    _counts_here(hit, by_band(left), by_band(right), group[own[0]])
                links = np.concatenate([hit @ copies[right], hit.T @ copies[left]])
                both = np.concatenate([left, right])
                a, b = np.nonzero(hit)
                roots = _roots(nodes[both], a, b + len(left))
            elif len(left) > 1 and side[left[0]] == 0:
                hit = _linked([sets[i] for i in left], None, threshold)
                if buckets[int(own[0])].is_valid:
                    _counts_here(hit, by_band(left), by_band(left), group[own[0]])
                links, both = hit @ copies[left], left
                roots = _roots(nodes[both], *np.nonzero(hit))
            else:
                continue
            some = links > 0
            out.append((nodes[both][some], links[some], roots[some]))
        if not out:
            return _LINKS.empty_table()
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_LINKS)

    return run


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cut = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1), len(x)]
    return list(zip(cut, cut[1:])) if len(x) else []


def _dealt(rows: DataFrame, group: str) -> DataFrame:
    """For members of a group of ``nb`` blocks a row (g, i, j, side) for each pair of blocks that they are part of.

    A node of block m meets block c in the pair of both, on side 1 or 2, and its own block on side 0.
    """
    mine = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("nb") - 1),
        lambda c: F.struct(F.least(c, "mine").alias("i"), F.greatest(c, "mine").alias("j"), F.when(c == F.col("mine"), 0).when(F.col("mine") < c, 1).otherwise(2).alias("side")),
    )
    return rows.withColumn("mine", mine).select("node", F.col(group).alias("comp"), "copies", "buckets", F.col(group).alias("g"), F.explode(pairs).alias("at")).select("node", "comp", "copies", "buckets", "g", "at.*")


def _places(found: DataFrame, nodes: DataFrame, entries: DataFrame, buckets: DataFrame, block: int, tables: _Tables) -> DataFrame:
    """Rows (node, comp, copies, buckets, g, i, j, side): where each candidate's text has to go to meet the others."""
    count = lambda size, grams: F.greatest(F.ceil(F.col(size) / F.lit(block)), F.ceil(F.col(grams) / F.lit(GRAMS))).cast("int")
    members = tables.keep(found.join(nodes.select("node", "copies", "grams"), "node").withColumnRenamed("label", "comp"))
    sizes = tables.keep(members.groupBy("comp").agg(F.count("*").alias("size"), F.sum("grams").alias("all_grams")).withColumn("nb", count("size", "all_grams")))
    whole = members.agg(F.count("*"), F.sum("grams")).first()
    groups = max(1, -(-whole[0] // block), -(-(whole[1] or 0) // GRAMS))
    large = sizes.where("nb > 1").select("comp", "size", "nb")  # of over a block each
    members = tables.keep(_looked_up(members, "comp", large, large.where(F.col("size") * HEAVY > whole[0]).select("comp")))
    no_buckets = F.lit(None).cast("array<long>").alias("buckets")
    small = members.where("nb is null").select("node", "comp", "copies", no_buckets, F.pmod(F.xxhash64("comp"), F.lit(groups)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"))
    loose = members.where("nb is not null").select("node", "comp", "copies", "grams")
    if loose.isEmpty():
        return small

    # the large components' buckets; buckets of the same nodes are one
    mine = tables.keep(loose.join(entries, "node").select("node", "comp", "copies", "grams", "at", "band"))
    held = mine.groupBy("band").agg(F.count("*").alias("bucket_size"), F.sum("grams").alias("bucket_grams"), F.first("comp").alias("comp"), F.sum(F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(1 << 40))).alias("same"), F.sum(F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(1 << 40))).alias("same_too"))
    held = held.where("bucket_size > 1").withColumn("bucket_nb", count("bucket_size", "bucket_grams"))
    one = Window.partitionBy("comp", "bucket_size", "same", "same_too")
    held = tables.keep(held.withColumn("bucket", F.min("band").over(one)))
    cost = held.where("band = bucket").groupBy("comp").agg(F.sum(F.col("bucket_size") * F.col("bucket_nb")).alias("bucket_cost"))
    by_bucket = tables.keep(large.join(cost, "comp").where(F.col("bucket_cost") < F.col("size") * F.col("nb")).select("comp", F.lit(True).alias("loose")))
    members = tables.keep(_looked_up(members.where("nb is not null"), "comp", by_bucket))
    tight = _dealt(members.where("loose is null").withColumn("buckets", no_buckets), "comp")

    heavy = held.where(F.col("bucket_size") * HEAVY > mine.count()).select("band")
    known = _looked_up(mine.join(by_bucket, "comp", "left_semi"), "band", held.select("band", "bucket", "bucket_nb"), heavy)
    by_node = known.groupBy("node").agg(F.first("copies").alias("copies"), F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bucket", F.lit(0)).alias("bucket"), F.coalesce("bucket_nb", F.lit(1)).alias("nb")))), lambda x: F.struct(x["bucket"].alias("bucket"), x["nb"].alias("nb"))).alias("all"))
    to = by_node.select("node", "copies", F.transform("all", lambda x: x["bucket"]).alias("buckets"), F.explode(F.array_distinct("all")).alias("b")).where("b.bucket <> 0")
    spread = _dealt(to.select("node", "copies", "buckets", "b.bucket", "b.nb"), "bucket")
    return small.unionByName(tight).unionByName(spread)


def ngram_join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, n_copies (rows with this text).

    With ``keep`` also row_key, the hash of the text (``text_key``), and kept: whether id and text are those that stand for
    their class, its smallest id (a null one first) and of several texts of that id the one of the smallest key. Rows of
    equal id and text have equal verdicts. Rows without a word (not ``worded``) stand for themselves.
    """
    bounded_batches(docs.sparkSession)
    tables = _Tables(docs)
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(F.col(text_col)).alias("row_key"))
    signed = tables.keep(_signed(docs, n, bands, rows))

    nodes = signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("doc_id", "row_key")).alias("first_row"), F.count("*").alias("copies"), F.min("bands").alias("bands"), F.min("grams").alias("grams"))
    nodes = tables.keep(nodes)
    # band hashes are mixed with the band's number
    entries = nodes.select(F.posexplode("bands").alias("at", "band"), "node")
    buckets = tables.keep(entries.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1"))
    heavy = buckets.where(F.col("size") * HEAVY > bands * nodes.count()).select("band")
    near = _looked_up(entries.select("band", "node"), "band", buckets.select("band", "least"), heavy).where("least is not null").select(F.col("node").alias("a"), F.col("least").alias("b"))
    found = components(near, tables)
    places = _places(found, nodes, entries, buckets, block, tables)

    # one text of each candidate node
    asked = tables.keep(found.join(nodes.select("node", "first_row"), "node").select("node", "first_row.doc_id", "first_row.row_key"))
    asked = F.broadcast(asked) if asked.count() <= MOST_BROADCAST else asked.hint("merge")
    texts = docs.join(asked, ["doc_id", "row_key"]).groupBy("node").agg(F.first("text").alias("text"))
    verified = tables.keep(texts.join(places, "node").groupBy("g", "i", "j").applyInArrow(_verify(n, threshold), "node long, links long, root long"))

    labels = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")), tables)
    classes = tables.keep(labels.join(nodes.select("node", "first_row"), "node").groupBy("label").agg(F.min("first_row").alias("class_row"), F.count("*").alias("size")))
    classed = _looked_up(labels, "label", classes.drop("size"), classes.where(F.col("size") * HEAVY > labels.count()).select("label")).select("node", "class_row")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "first_row", "copies").join(classed, "node", "left").join(links, "node", "left")
    known = tables.keep(known.select("node", F.coalesce("class_row", "first_row").alias("class_row"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")))
    # a text of many copies is one node with many rows
    copied = known.where(F.col("n_copies") * HEAVY > signed.count()).select("node")
    out = _looked_up(signed.where("node is not null").select("doc_id", "node", "row_key"), "node", known, copied)
    silent = signed.where("node is null").select("doc_id", "node", "row_key")
    out = out.unionByName(silent, allowMissingColumns=True)
    back = lambda c, name: F.when(c != NULL_ID, c).alias(name)
    stands = F.col("class_row").isNull() | ((F.col("class_row.doc_id") == F.col("doc_id")) & (F.col("class_row.row_key") == F.col("row_key")))
    verdict = ["row_key", stands.alias("kept"), F.col("class_row").isNotNull().alias("worded")] if keep else []
    return out.select(back(F.col("doc_id"), "doc_id"), back(F.coalesce("class_row.doc_id", "doc_id"), "class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), *verdict)
