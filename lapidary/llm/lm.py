"""Language-model scoring by deleted interpolation (Jelinek and Mercer, 1980).

log10 P(text) sums over its tokens the logarithm of a mixture: of the maximum-likelihood estimates of the token after its
``order - 1``, ..., 1, 0 predecessors and of the base distribution (counts plus 0.1). From the longest context down, each
level takes a share of what the levels above left; the share depends on how often that level's context was seen
(``BUCKETS`` frequency classes a level). All shares are learnt together by expectation-maximisation on held-out counts:
those of the rows of fold ``DELETED``, whose counts are deleted from the estimates meanwhile. The final estimates use all
training counts.

Plan. Documents are gathered into blocks of about ``BLOCK_TOKENS`` tokens, held-out ones apart. A block names the distinct
n-grams it holds, as sorted hashes in one array a shard, with its own counts; shards add the counts up and answer each block
with one array of totals in the block's order. So what moves is an entry for each n-gram and block, not for each
occurrence. The count of a context is that of the shorter n-gram before the token, which the block asks for anyhow. Two
passes use the answers: held-out blocks only, to learn the shares (the evidence is binned, see ``_cells``, for the driver's
EM), then all blocks.

Scale: a shard is a range of the hashes of all n-grams of one length, so a frequent n-gram is one entry a block; blocks hold
a fixed number of tokens and shards about ``SHARD_ENTRIES`` entries, so both counts grow with the input and neither's size
does. Blocks and answers are written to spark.checkpoint.dir and read again, so nothing is lost with an executor. Memory:
one block, or one shard's entries. The driver gets the totals N and V and the cells, at most (2 * BUCKETS * BINS)**(order - 1)
and far fewer in fact, whatever the corpus.

Words are compared by 64-bit hashes. Longer n-grams are compared by fingerprints of ``SPARE_BITS`` bits more than the number
of all tokens has, so one that was never seen is taken for a seen one with a probability of 2**-SPARE_BITS at every size.

Results by definition: a null text is empty: its one token is the end; equal rows count each time; without training
tokens the base has N = 0 and V = 0; null ids are held in training; without held-out rows all shares are a half; a
frequency class without held-out tokens takes the share of the class below; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.llm.store import shared_folder
from lapidary.llm.text import Chunk, bounded_batches, chunks, mix

ORDER = 3
BLOCK_TOKENS = 1_500_000
SHARD_ENTRIES = 1 << 22
SPARE_BITS = 18
BUCKETS = 12
BINS = 26
EM_STEPS = 100
ADD = 0.1
DELETED, LEARN, OUT = 0, 1, 2  # folds: held-out counts of the training texts, the other training texts, no training
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_END, _BEGIN = _U(0x9A3F0C1D5E7B2468), _U(0x1B56C4E9D2F08A73)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _pack_numbers(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as byte planes, of the least width that holds them; most high bytes are zero."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + _pack(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)


def _unpack_numbers(raw: bytes) -> np.ndarray:
    width = raw[0]
    return np.ascontiguousarray(_unpack(raw[1:], np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def _pack_keys(sorted_keys: np.ndarray) -> bytes:
    return _pack_numbers(np.diff(sorted_keys, prepend=_U(0)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack_numbers(raw), dtype=_U)


def token_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the chunk, an end after each text's words, and how many each text has."""
    start, end, doc = chunk.words()
    h = Chunk(chunk.rows, _LOWER[chunk.buf], chunk.bounds).hashes(start, end) if len(chunk.buf) else np.zeros(0, _U)
    sizes = np.bincount(doc, minlength=len(chunk)) + 1
    out = np.empty(sizes.sum(), _U)
    last = np.cumsum(sizes) - 1
    words = np.ones(len(out), bool)
    words[last] = False
    out[words], out[last] = h, _END
    return out, sizes


def gram_keys(tokens: np.ndarray, at: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For n = 1..order, the hash of the n-gram that ends at each token, ``at`` its place in its text, begin marks before."""
    key = tokens
    yield key
    for n in range(2, order + 1):
        back = np.concatenate([np.full(n - 1, _BEGIN, _U), tokens[: max(len(tokens) - n + 1, 0)]])[: len(tokens)]
        back[at < n - 1] = _BEGIN
        key = mix(key * _U(0x9E3779B97F4A7C15) + back + _U(n))
        yield key


def fingerprint_bits(tokens: int) -> int:
    return min(64, SPARE_BITS + max(1, int(tokens)).bit_length())


class _Block:
    """The texts of one block and, for each length, its distinct n-grams and where they stand."""

    def __init__(self, row: dict, order: int, bits: int):
        self.sizes, self.folds, self.order = _unpack(row["sizes"], np.int32), _unpack(row["folds"], np.int8), order
        tokens = _unpack_keys(row["words"])[_unpack_numbers(row["tokens"])]
        self.first = np.cumsum(self.sizes) - self.sizes
        at = np.arange(len(tokens)) - np.repeat(self.first, self.sizes)
        self.keys, self.back = [], []
        for n, key in enumerate(gram_keys(tokens, at, order), 1):
            key, back = np.unique(key >> _U(64 - bits) if n > 1 else key, return_inverse=True)
            self.keys.append(key)
            self.back.append(back.astype(np.int32))

    def counts(self) -> list[np.ndarray]:
        taught = np.repeat(self.folds != OUT, self.sizes)
        return [np.bincount(back[taught], minlength=len(key)) for key, back in zip(self.keys, self.back)]

    def levels(self, totals: list[np.ndarray], texts: int, tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n = order..1: (maximum-likelihood estimate after n - 1 predecessors, class of that context), per token."""
        for n in range(self.order, 0, -1):
            if n > 1:
                context = np.empty(len(self.back[0]))
                context[1:] = totals[n - 2][self.back[n - 2][:-1]]
                context[self.first] = texts  # before the first token stand begin marks only
            else:
                context = np.full(len(self.back[0]), float(tokens))
            yield np.divide(totals[n - 1][self.back[n - 1]], context, out=np.zeros(len(context)), where=context > 0), _buckets(context)


def _blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Documents gathered into blocks, held-out ones apart, with their numbers of tokens, of training tokens and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 24
        open_: dict[bool, list] = {False: [], True: []}

        def close(held: bool) -> pa.RecordBatch:
            nonlocal number
            ids, null, folds, sizes, tokens = (np.concatenate(x) for x in zip(*open_[held]))
            open_[held] = []
            number += 1
            # tokens as numbers of the block's distinct ones
            key, back = np.unique(tokens, return_inverse=True)
            taught = folds != OUT
            numbers = [number - 1, held, len(tokens), int(sizes[taught].sum()), int(taught.sum())]
            values = [*(_pack(x) for x in (ids, null, folds, sizes)), _pack_keys(key), _pack_numbers(back)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*numbers, *values], _BLOCKS)], schema=_BLOCKS)

        for chunk in chunks(batches):
            tokens, sizes = token_hashes(chunk)
            ids = chunk.rows.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            folds = chunk.rows.column("fold").to_numpy()
            per = np.repeat(folds == DELETED, sizes)
            for held in (False, True):
                mine = (folds == DELETED) == held
                if mine.any():
                    open_[held].append((ids[mine], null[mine], folds[mine].astype(np.int8), sizes[mine].astype(np.int32), tokens[per == held]))
                    if sum(len(x[-1]) for x in open_[held]) >= block_tokens:
                        yield close(held)
        for held in (False, True):
            if open_[held]:
                yield close(held)

    return docs.mapInArrow(run, "block long, held boolean, n_tokens long, n_taught long, n_texts long, ids binary, null binary, folds binary, sizes binary, words binary, tokens binary")


_BLOCKS = pa.schema([("block", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_taught", pa.int64()), ("n_texts", pa.int64()), *((c, pa.binary()) for c in ("ids", "null", "folds", "sizes", "words", "tokens"))])
_GRAMS = pa.schema([("block", pa.int64()), ("held", pa.bool_()), ("kind", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_TOTALS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("all", pa.binary()), ("learn", pa.binary()), ("distinct", pa.int64())])


def _cuts(key: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Bounds of the shards' ranges in sorted hashes."""
    step = -(-(1 << bits) // shards)
    return np.concatenate([np.searchsorted(key, np.array([i * step for i in range(shards)], _U)), [len(key)]])


def _totals(blocks: DataFrame, order: int, bits: int, shards: int) -> DataFrame:
    """Answers (block, kind, shard, all, learn): totals of the block's n-grams, in the block's order.

    ``learn``, without the held-out counts, is for held-out blocks only. ``distinct`` stands in one row of each shard.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, order, bits)
                for kind, (key, count) in enumerate(zip(block.keys, block.counts())):
                    cut = _cuts(key, shards, bits if kind else 64)
                    out = [(row["block"], row["held"], kind, s, _pack_keys(key[a:b]), _pack_numbers(count[a:b])) for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _GRAMS)], schema=_GRAMS)

    def add(table: pa.Table) -> pa.Table:
        keys = [_unpack_keys(x.as_py()) for x in table.column("keys")]
        cut = np.cumsum([0, *map(len, keys)])
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([_unpack_numbers(x.as_py()).astype(np.float64) for x in table.column("counts")])
        held = table.column("held").to_numpy()
        total = np.bincount(back, counts, minlength=len(every))
        learn = total - np.bincount(back, counts * np.repeat(held, np.diff(cut)), minlength=len(every))
        answers = [_pack_numbers(total[back[a:b]]) for a, b in zip(cut, cut[1:])]
        apart = [_pack_numbers(learn[back[a:b]]) if h else None for h, a, b in zip(held, cut, cut[1:])]
        distinct = [int(np.count_nonzero(total))] + [0] * (len(keys) - 1)
        return pa.table([table.column("block"), table.column("kind"), table.column("shard"), pa.array(answers, pa.binary()), pa.array(apart, pa.binary()), pa.array(distinct)], schema=_TOTALS)

    named = blocks.mapInArrow(name, "block long, held boolean, kind int, shard int, keys binary, counts binary")
    return named.groupBy("kind", "shard").applyInArrow(add, "block long, kind int, shard int, all binary, learn binary, distinct long")


def _answered(answers: pa.Table, column: str, order: int) -> list[np.ndarray]:
    """Per length, the totals of each of the block's n-grams."""
    parts: list[list] = [[] for _ in range(order)]
    for a in sorted(answers.select(["kind", "shard", column]).to_pylist(), key=lambda a: (a["kind"], a["shard"])):
        parts[a["kind"]].append(_unpack_numbers(a[column]))
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]


def _buckets(context: np.ndarray) -> np.ndarray:
    """Frequency class of a context: 0 unseen, then by powers of two."""
    return np.minimum(np.ceil(np.log2(context + 1)).astype(np.int64), BUCKETS - 1)


def _cells(levels: list[tuple[np.ndarray, np.ndarray]], base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A cell for each token, and its log2 ratios of estimate and base, level x token.

    A cell is the classes of the contexts and the whole parts of the log2 ratios, 0 for an estimate of zero.
    """
    cell, ratios = np.zeros(len(base), np.int64), []
    for estimate, bucket in levels:
        ratio = np.log2(np.maximum(estimate, 1e-300) / base)
        part = np.where(estimate > 0, np.clip(np.floor(ratio) + 5, 1, BINS - 1), 0).astype(np.int64)
        cell = (cell * BUCKETS + bucket) * BINS + part
        ratios.append(np.where(estimate > 0, ratio, 0.0))
    return cell, np.array(ratios)


def learn_shares(cell: np.ndarray, count: np.ndarray, sums: np.ndarray, order: int = ORDER) -> np.ndarray:
    """EM for the shares (level from the longest context down x frequency class) of all levels together.

    ``cell``: cells of held-out tokens; ``count``: how many tokens each has; ``sums``: the sums of their log2 ratios.
    """
    shares = np.full((order, BUCKETS), 0.5)
    shares[:, 0] = 0.0  # an unseen context has no estimate
    if not len(cell):
        return shares
    bucket, ratio, rest = [], [], cell.copy()
    for i in reversed(range(order)):
        part, rest = rest % BINS, rest // BINS
        bucket.insert(0, rest % BUCKETS)
        rest = rest // BUCKETS
        ratio.insert(0, np.where(part > 0, np.exp2(sums[i] / count), 0.0))
    seen = np.array([np.bincount(b, count, minlength=BUCKETS) > 0 for b in bucket])
    for _ in range(EM_STEPS):
        left, weight = np.ones(len(cell)), []
        for s, b in zip(shares, bucket):
            weight.append(left * s[b])
            left = left * (1 - s[b])
        whole = sum(w * r for w, r in zip(weight, ratio)) + left
        below = count * left / whole  # tokens expected from the base, then from each level and all below it
        for i in reversed(range(order)):
            own = count * weight[i] * ratio[i] / whole
            below = below + own
            reached = np.bincount(bucket[i], below, minlength=BUCKETS)
            new = np.bincount(bucket[i], own, minlength=BUCKETS) / np.maximum(reached, 1e-300)
            shares[i, 1:] = np.where(reached > 0, np.clip(new, 1e-6, 1 - 1e-6), shares[i])[1:]
    for i in range(order):
        for b in range(2, BUCKETS):
            if not seen[i, b]:
                shares[i, b] = shares[i, b - 1]
    return shares


@dataclass
class Sizes:
    order: int
    bits: int
    tokens: int  # training tokens: N
    texts: int  # training texts
    learn_tokens: int  # without the held-out ones
    learn_texts: int
    distinct: int  # V

    def base(self, counts: np.ndarray, tokens: int) -> np.ndarray:
        return (counts + ADD) / (tokens + ADD * (self.distinct + 1))


@dataclass
class Counted:
    """Blocks of texts and the totals of their n-grams, as tables in the shared folder."""

    blocks: DataFrame
    answers: DataFrame
    sizes: Sizes


def count_grams(docs: DataFrame, fold, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_tokens: int = BLOCK_TOKENS, shard_entries: int = SHARD_ENTRIES) -> Counted:
    """``fold``: a Column of DELETED, LEARN or OUT for each row. Writes two tables under spark.checkpoint.dir."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = shared_folder(spark, "lm")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(fold, F.lit(LEARN)).cast("int").alias("fold"))
    _blocks(docs, block_tokens).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    learn = lambda c: F.sum(F.when(~F.col("held"), F.col(c)))
    sizes = [int(x or 0) for x in blocks.agg(F.sum("n_tokens"), F.sum("n_taught"), F.sum("n_texts"), learn("n_taught"), learn("n_texts")).first()]
    bits, shards = fingerprint_bits(sizes[0]), max(1, -(-sizes[0] // shard_entries))
    _totals(blocks, order, bits, shards).write.option("compression", "uncompressed").parquet(f"{folder}/totals")
    totals = spark.read.parquet(f"{folder}/totals")
    distinct = int(totals.where("kind = 0").agg(F.sum("distinct")).first()[0] or 0)
    return Counted(blocks, totals.drop("distinct"), Sizes(order, bits, *sizes[1:], distinct))


def fit_shares(counted: Counted) -> np.ndarray:
    """The mixture's shares, learnt on the held-out blocks."""
    sizes, order = counted.sizes, counted.sizes.order
    names = [f"sum_{i}" for i in range(order)]

    def evidence(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            block = _Block(row, order, sizes.bits)
            totals = _answered(right, "learn", order)
            base = sizes.base(totals[0], sizes.learn_tokens)[block.back[0]]
            cell, ratios = _cells(list(block.levels(totals, sizes.learn_texts, sizes.learn_tokens)), base)
            key, back = np.unique(cell, return_inverse=True)
            out.append(pa.table([pa.array(key), pa.array(np.bincount(back).astype(float)), *(pa.array(np.bincount(back, r)) for r in ratios)], names=["cell", "n", *names]))
        return pa.concat_tables(out)

    held = counted.blocks.where("held")
    mine = counted.answers.join(held.select("block"), "block", "left_semi")
    found = held.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(evidence, ", ".join(["cell long", "n double", *(f"{c} double" for c in names)]))
    got = found.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", *names))).toPandas()
    return learn_shares(got["cell"].to_numpy(np.int64), got["n"].to_numpy(), got[names].to_numpy().T, order)


def rate(counted: Counted, shares: np.ndarray) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    sizes, order = counted.sizes, counted.sizes.order

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        for row in left.to_pylist():
            block = _Block(row, order, sizes.bits)
            totals = _answered(right, "all", order)
            known = totals[0][block.back[0]]
            base = sizes.base(known, sizes.tokens)
            p, unclaimed = np.zeros(len(base)), np.ones(len(base))
            for share, (estimate, bucket) in zip(shares, block.levels(totals, sizes.texts, sizes.tokens)):
                p += unclaimed * share[bucket] * estimate
                unclaimed *= 1 - share[bucket]
            p += unclaimed * base
            texts = len(block.sizes)
            text = np.repeat(np.arange(texts), block.sizes)
            per = lambda x: np.bincount(text, x, minlength=texts)
            ids = pa.array(_unpack(row["ids"], np.int64), mask=_unpack(row["null"], bool))
            return pa.table([ids, pa.array(block.sizes.astype(np.int64)), pa.array(per(known > 0).astype(np.int64)), pa.array(np.full(texts, sizes.tokens)), pa.array(per(np.log10(base))), pa.array(per(np.log10(p)))], schema=_SCORES)
        return _SCORES.empty_table()

    return counted.blocks.groupBy("block").cogroup(counted.answers.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_texts(docs: DataFrame, fold, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_tokens: int = BLOCK_TOKENS, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """Count, learn the shares and rate: one row per document, as ``rate`` gives it."""
    counted = count_grams(docs, fold, id_col, text_col, order, block_tokens, shard_entries)
    return rate(counted, fit_shares(counted))
