"""Approximate nearest neighbours by largest cosine: a vantage-point tree per shard, past which all queries stream.

Vectors are scaled to length one, where the straight distance orders as the cosine does and is a metric. A tree splits its
vectors at the median distance from a vantage point and keeps the range of distances on either side. A side is skipped for
a query when the triangle inequality shows that nothing in it can be nearer than the query's k-th best so far; ``factor``
relaxes that: with best distance t, a side is skipped when its range lies further than factor * t away. Factor one skips
nothing that could be nearer, so the search is exact; a smaller one skips more.

What may be near is rated by its cosine in double precision on the original vectors, pair by pair, and kept by (cosine,
smaller id), so that equal vectors get equal scores and no rounding of a distance decides. Before that every vector is
brought near one by a power of two, which changes no digit of the cosine but keeps squares from overflow and underflow.

Scale: a shard is a hash-dealt part of the table (about ``SHARD_ROWS`` vectors), so equal vectors spread over all shards. A
task gets a shard's vectors, then the queries in batches; it makes the tree once and holds one batch of queries. Queries are
copied to every shard by nature of a query set against all rows; vectors move once. No vectors reach the driver. A shard's
tree is lost with its executor and made again from the shuffle.

Results by definition: vectors that are null, zero, or hold a null or non-finite component take no part, as queries
neither; vectors of different lengths never meet; rows that repeat an id are separate candidates, but no query finds its
own id; a query id that is repeated is asked once, with its shortest and then smallest vector; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapidary.llm.text import bounded_batches

SHARD_ROWS = 8192
LEAF = 64
FACTOR = 0.95
_EPS = 1e-12  # of squared distances, which are exact to some 1e-15


class Tree:
    """A vantage-point tree over the rows of a matrix, by the angle between them."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray | None = None, leaf: int = LEAF):
        self.vectors, self.unit, self.leaf = near_one(vectors), unit(vectors), leaf
        self.ids = np.arange(len(vectors)) if ids is None else ids
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple] = []
        if len(vectors):
            self._build(0, len(vectors))

    def _build(self, a: int, b: int) -> int:
        node = len(self.nodes)
        self.nodes.append((a, b, None))
        if b - a > self.leaf:
            rows = self.order[a:b]
            point = rows[0]
            d = np.sqrt(squares(self.unit[point][None], self.unit[rows])[0])
            by = np.argsort(d, kind="stable")
            self.order[a:b], d = rows[by], d[by]
            mid = (b - a) // 2
            inner, outer = self._build(a, a + mid), self._build(a + mid, b)
            self.nodes[node] = (a, b, (point, (d[0], d[mid - 1], inner), (d[mid], d[-1], outer)))
        return node

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest rows of each query (-1 where there are fewer) and their cosines; ties to the smaller id.

        ``skip``: for each query an id that it must not find.
        """
        asked, own = unit(queries), near_one(queries)
        best = np.full((len(queries), k), -np.inf)
        rows = np.full((len(queries), k), -1)
        self.visited = 0
        reach = lambda which: np.maximum(2.0 - 2.0 * best[which, -1], 0.0)  # noqa: E731  squared distance of the k-th best

        def leaf(which: np.ndarray, a: int, b: int) -> None:
            self.visited += len(which) * (b - a)
            found = self.order[a:b]
            near = squares(asked[which], self.unit[found]) <= reach(which)[:, None] + _EPS
            if skip is not None:
                near &= self.ids[found][None] != skip[which][:, None]
            at, hit = np.nonzero(near)
            if not len(at):
                return
            # what came before and what is near now, by query, cosine and id
            some = which[np.unique(at)]
            q = np.concatenate([which[at], np.repeat(some, k)])
            r = np.concatenate([found[hit], rows[some].ravel()])
            c = np.concatenate([cosines(own[which[at]], self.vectors[found[hit]]), best[some].ravel()])
            by = np.lexsort((np.where(r < 0, np.iinfo(np.int64).max, self.ids[r]), -c, q))
            q, r, c = q[by], r[by], c[by]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            keep = place < k
            best[q[keep], place[keep]], rows[q[keep], place[keep]] = c[keep], r[keep]

        def visit(node: int, which: np.ndarray) -> None:
            if not len(which):
                return
            a, b, split = self.nodes[node]
            if split is None:
                return leaf(which, a, b)
            point, inner, outer = split
            d = np.sqrt(squares(asked[which], self.unit[point][None])[:, 0])
            inside = d <= (inner[1] + outer[0]) / 2
            for first, second, mine in ((inner, outer, inside), (outer, inner, ~inside)):
                here, far = which[mine], d[mine]
                visit(first[2], here)
                gap = np.maximum(second[0] - far, far - second[1])
                # roots of squares near zero are exact to some 1e-7
                visit(second[2], here[gap <= factor * np.sqrt(reach(here)) + 1e-6])

        if self.nodes:
            visit(0, np.arange(len(queries)))
        return rows, best


def near_one(m: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two to a largest component between a half and one."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1]) if m.size else m


def unit(m: np.ndarray) -> np.ndarray:
    m = near_one(m)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True)) if m.size else m


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared straight distances between unit vectors."""
    return np.maximum(2.0 - 2.0 * (a @ b.T), 0.0)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; equal pairs of rows give equal values, whatever stands around them."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row of ``queries`` its k nearest rows of ``vectors``."""
    bounded_batches(vectors.sparkSession)

    def valid(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim")).where(sound & F.col("id").isNotNull())

    rows = valid(vectors)
    asked = valid(queries).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q")).select("id", "q.v", "q.dim")
    # the number of shards follows from the count, taken by one aggregate
    shards = max(1, -(-rows.count() // shard_rows))
    base = rows.select("id", "v", "dim", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"))
    probes = asked.select("id", "v", "dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"))
    met = base.unionByName(probes).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "kind")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1 if batch.num_rows else []
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                dim, shard, kind = marks[:, a]
                if (dim, shard) != key:
                    key, held, tree = (dim, shard), [], None
                own, v = batch.column("id").slice(a, b - a).to_numpy(), _matrix(batch.column("v").slice(a, b - a))
                if kind == 0:
                    held.append((own, v))
                elif held:
                    if tree is None:
                        tree = Tree(np.concatenate([v for _, v in held]), np.concatenate([i for i, _ in held]))
                        held = held[:1]
                    found, score = tree.search(v, k, factor, own)
                    at, col = np.nonzero(found >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(tree.ids[found[at, col]]), pa.array(score[at, col])], schema=_FOUND)

    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
