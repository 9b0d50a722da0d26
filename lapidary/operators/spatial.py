"""Distance questions as bucketed equi-joins.

A distance join deals both sides out by (group keys, grid cell). Cells are three times as wide as the reach; one side stands
in every cell that its reach touches (2.8 on average), so that every pair meets exactly once. Catalyst would plan a bare
distance predicate as a nested loop. It knows neither how many cells a row stands in nor how far Parquet packs rows, and would
broadcast what it takes for small; both sides of these joins grow with the input, so they are hinted to be merged.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Width of a cell in reaches. Wider cells: fewer copies of rows, more pairs to compare.
SIDE = 3.0


def _cells(df: DataFrame, x: str, y: str, width: float | Column) -> DataFrame:
    return df.withColumns({"_cx": F.floor(F.col(x) / width), "_cy": F.floor(F.col(y) / width)})


def _touched(df: DataFrame, x: str, y: str, width: float | Column, share: float | Column) -> DataFrame:
    """The row once in each cell that the square of ``share`` cell widths to all sides of it touches."""
    slack = F.lit(1e-6)  # a place's rounding, in cells
    along = lambda v: F.explode(F.sequence(F.floor(F.col(v) / width - share - slack), F.floor(F.col(v) / width + share + slack)))
    return df.withColumn("_cx", along(x)).withColumn("_cy", along(y))


def within(left: DataFrame, right: DataFrame, reach: float | str, keys: list[str], x: str = "x_mm", y: str = "y_mm") -> DataFrame:
    """All pairs of rows with equal keys closer than ``reach``; columns are prefixed a_ and b_, with their distance.

    ``reach`` may be the name of a column of both sides that is one of the keys or the same in all rows of a key.
    """
    width = (F.col(reach) if isinstance(reach, str) else F.lit(float(reach))) * SIDE
    name = lambda df, p: df.select(*(F.col(c).alias(c if c in keys or c in ("_cx", "_cy") else f"{p}_{c}") for c in df.columns))
    a, b = name(_cells(left, x, y, width), "a"), name(_touched(right, x, y, width, F.lit(1 / SIDE)), "b")
    dx, dy = F.col(f"a_{x}") - F.col(f"b_{x}"), F.col(f"a_{y}") - F.col(f"b_{y}")
    pairs = a.join(b.hint("merge"), [*keys, "_cx", "_cy"]).withColumn("distance", F.sqrt(dx * dx + dy * dy))
    near = F.col("distance") < (F.col(reach if reach in keys else f"a_{reach}") if isinstance(reach, str) else reach)
    return pairs.where(near).drop("_cx", "_cy")


def close_pairs(stones: DataFrame, clearance: float, keys: list[str], order: str = "stone_id", x: str = "x_mm", y: str = "y_mm", size: str = "phys_mm") -> DataFrame:
    """Unordered pairs of one table whose round bodies are less than ``clearance`` apart, as ``neighbour_pairs`` gives them.

    Bodies fall into classes by powers of four of their size. Each class has a grid of its own, as wide as its largest body
    needs; a pair meets on the grid of the larger one, so small bodies are not compared at the reach of large ones. A body
    is on the grid of its class and of those above, which one aggregate finds.
    """
    class_of = F.ceil(F.log2(F.greatest(F.col(size), F.lit(1e-6))) / 2).cast("int")
    widths = {r[0]: max(r[1] + clearance, 1e-6) for r in stones.groupBy(class_of.alias("c")).agg(F.max(size)).collect() if r[0] is not None}
    if not widths:
        return neighbour_pairs(stones, 1.0, keys, order, x, y)
    wide = F.create_map(*(F.lit(v) for c, w in sorted(widths.items()) for v in (c, w)))
    rows = stones.withColumn("_class", class_of)
    at = wide[F.col("_grid")] * SIDE
    # no farther than to a body as large as its class has
    own_reach = F.greatest((F.col(size) + clearance + wide[F.col("_grid")]) / 2, F.lit(0.0)) / at
    a = _touched(rows.withColumn("_grid", F.col("_class")), x, y, at, own_reach)
    above = F.filter(F.array(*map(F.lit, sorted(widths))), lambda c: c >= F.col("_class"))
    b = _cells(rows.withColumn("_grid", F.explode(above)), x, y, at)
    name = lambda df, p: df.select(*(F.col(c).alias(c if c in (*keys, "_cx", "_cy", "_grid") else f"{p}_{c}") for c in df.columns))
    dx, dy = F.col(f"a_{x}") - F.col(f"b_{x}"), F.col(f"a_{y}") - F.col(f"b_{y}")
    met = name(a, "a").join(name(b, "b").hint("merge"), [*keys, "_grid", "_cx", "_cy"]).withColumn("distance", F.sqrt(dx * dx + dy * dy))
    # of one class each pair meets from both ends
    met = met.where((F.col("distance") - (F.col(f"a_{size}") + F.col(f"b_{size}")) / 2 < clearance) & ((F.col("a__class") > F.col("b__class")) | (F.col(f"a_{order}") < F.col(f"b_{order}"))))
    turned = F.col(f"a_{order}") > F.col(f"b_{order}")
    own = [c for c in stones.columns if c not in keys]
    ends = [F.when(turned, F.col(f"{q}_{c}")).otherwise(F.col(f"{p}_{c}")).alias(f"{p}_{c}") for p, q in (("a", "b"), ("b", "a")) for c in own]
    return met.select(*keys, *ends, "distance")


def neighbour_pairs(stones: DataFrame, reach: float, keys: list[str], order: str = "stone_id", x: str = "x_mm", y: str = "y_mm") -> DataFrame:
    """Unordered pairs of one table closer than ``reach``."""
    return within(stones, stones, reach, keys, x, y).where(F.col(f"a_{order}") < F.col(f"b_{order}"))


def gap() -> Column:
    """Between the edges of a pair of round stones; negative where they overlap."""
    return F.col("distance") - (F.col("a_phys_mm") + F.col("b_phys_mm")) / 2


def both_ends(pairs: DataFrame, keys: list[str], columns: list[str], order: str = "stone_id") -> DataFrame:
    """Each pair once from either end: keys, order (this end), other, columns."""
    ends = F.array(F.struct(F.col(f"a_{order}").alias(order), F.col(f"b_{order}").alias("other")), F.struct(F.col(f"b_{order}").alias(order), F.col(f"a_{order}").alias("other")))
    return pairs.select(*keys, *columns, F.explode(ends).alias("_end")).select(*keys, "_end.*", *columns)


def with_largest(stones: DataFrame, keys: list[str], extra: float, name: str = "_reach", factor: float = 1.0) -> DataFrame:
    """Adds ``name``: the largest size of the row's design, times ``factor``, and ``extra``."""
    largest = stones.groupBy(*keys).agg((F.max("phys_mm") * factor + extra).alias(name))
    return stones.join(largest, keys)


def nearest_gap(stones: DataFrame, keys: list[str], reach: float = 1.5) -> DataFrame:
    """Every stone with its smallest gap to another whose centre is nearer than the design's largest size and ``reach``; else null."""
    rows = with_largest(stones.select(*keys, "stone_id", "x_mm", "y_mm", "phys_mm"), keys, reach)
    pairs = within(rows, rows, "_reach", keys).where("a_stone_id < b_stone_id").withColumn("gap", gap())
    least = both_ends(pairs, keys, ["gap"]).groupBy(*keys, "stone_id").agg(F.min("gap").alias("gap"), F.count("*").alias("near"))
    return stones.join(least, [*keys, "stone_id"], "left")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], order: str, first: float, largest: float | None = None) -> DataFrame:
    """The true nearest right row of each left row, by rings of doubling reach: exact once a hit lies within the reach.

    Rings go on to the distance that the places can have at most, or to ``largest``.
    """
    if largest is None:
        ends = left.select("x_mm", "y_mm").unionByName(right.select("x_mm", "y_mm")).agg(*(f(c) for c in ("x_mm", "y_mm") for f in (F.max, F.min))).first()
        largest = 0.0 if ends[0] is None else ((ends[0] - ends[1]) ** 2 + (ends[2] - ends[3]) ** 2) ** 0.5
    hits, reach, rest = [], first, left
    while not hits or reach <= largest * 2:
        best = within(rest, right, reach, keys).groupBy(*keys, f"a_{order}").agg(F.min(F.struct("distance", f"b_{order}")).alias("_best"))
        hits.append(stored(best.select(*keys, F.col(f"a_{order}").alias(order), F.col(f"_best.b_{order}").alias("nearest"), F.col("_best.distance").alias("distance")), "nearest"))
        rest, reach = stored(rest.join(hits[-1].select(*keys, order), [*keys, order], "left_anti"), "rest"), reach * 2
        if rest.isEmpty():
            break
    found = reduce(DataFrame.unionByName, hits)
    return left.join(found, [*keys, order], "left")


def components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``component``, the smallest node of each node's connected component, to (keys, node).

    ``edges`` are (keys, a, b). Each round moves every node to its smallest neighbour, two steps at once, and renames the
    edges, until none is left; the smallest node of a component never moves. On long paths, too, a round leaves less than
    half of the nodes. Tables in the shared folder cut the lineage.
    """
    ordered = lambda df, a, b: df.where(F.col(a) != F.col(b)).select(*keys, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    edges, rounds = stored(ordered(edges, "a", "b"), "edges"), []
    while not edges.isEmpty():
        ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
        least = edges.select(*keys, F.explode(ends).alias("e")).groupBy(*keys, "e.node").agg(F.min("e.other").alias("other")).select(*keys, "node", F.least("node", "other").alias("label"))
        least = stored(least, "least")
        second = least.select(*keys, F.col("node").alias("label"), F.col("label").alias("_next"))
        step = stored(least.join(second, [*keys, "label"]).select(*keys, "node", F.col("_next").alias("label")), "step")
        rounds.append(step)
        to = lambda c: step.select(*keys, F.col("node").alias(c), F.col("label").alias(f"_{c}"))  # noqa: B023, E731
        edges = stored(ordered(edges.join(to("a"), [*keys, "a"]).join(to("b"), [*keys, "b"]), "_a", "_b"), "edges")
    labels = nodes.select(*keys, "node", F.col("node").alias("component"))
    for step in rounds:
        step = step.select(*keys, F.col("node").alias("component"), F.col("label").alias("_next"))
        labels = stored(labels.join(step, [*keys, "component"], "left").select(*keys, "node", F.coalesce("_next", "component").alias("component")), "labels")
    return labels


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table under the checkpoint folder, read again."""
    checkpoint_folder(df)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def checkpoint_folder(df: DataFrame) -> None:
    """Where checkpoints go: spark.checkpoint.dir. A local session without one gets a folder of its machine."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir():
        return
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(root or "/tmp/checkpoints")


def mutual_best(pairs: DataFrame, keys: list[str], a: str, b: str, cost: str) -> DataFrame:
    """Of candidate pairs, those that are each other's cheapest (ties: smaller partner)."""
    best = lambda me, you: pairs.groupBy(*keys, me).agg(F.min(F.struct(cost, you)).alias("_best")).select(*keys, me, F.col(f"_best.{you}").alias(you))
    return pairs.join(best(a, b), [*keys, a, b], "left_semi").join(best(b, a), [*keys, a, b], "left_semi")


def tiles_of(x: str, y: str, size: float, overlap: float) -> Column:
    """The tiles (col, row) of ``size`` that hold a point, neighbouring tiles overlapping by ``overlap``."""
    step = size - overlap

    def along(v: str) -> Column:
        last = F.floor(F.col(v) / step)
        return F.sequence(F.greatest(F.floor((F.col(v) - size) / step) + 1, F.lit(0)), last)

    return F.flatten(F.transform(along(x), lambda i: F.transform(along(y), lambda j: F.struct(i.alias("col"), j.alias("row")))))
