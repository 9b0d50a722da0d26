"""Queries on the shape of a layout: nearest-neighbour statistics, regularity, ownership of cells, runs and peaks along lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapidary.functions import beads as B
from lapidary.functions import color
from lapidary.functions.numeric import half_up, quantile_outer, rounded, sorted_values
from lapidary.operators import passes
from lapidary.operators import spatial as S
from lapidary.operators.shaped import shaped_pairs
from lapidary.plans.distances import _DE, _PAIRS, _TOUCH, _touch_colors
from lapidary.plans.registry import Registry
from lapidary.sources import tables as T

query = Registry()
KEY = ["design_id"]
_P = _PAIRS.rstrip()


def _ends(spark: SparkSession, sf: str, reach: float, *columns: str) -> DataFrame:
    """Each stone with each other one nearer than ``reach``: distance, gap and the two's columns (own_ and other_)."""
    rows = T.stones(spark, sf).select("design_id", "stone_id", "x_mm", "y_mm", "phys_mm", *columns)
    pairs = S.within(rows, rows, reach, KEY).where("a_stone_id <> b_stone_id").withColumn("gap", S.gap())
    return pairs.withColumnRenamed("a_stone_id", "stone_id").withColumnRenamed("b_stone_id", "other")


_BOTH = _P + """, ends AS (SELECT design_id, a AS stone_id, b AS other, pa AS phys, ca AS code, cb AS other_code, d, gap FROM pairs WHERE d < 12 UNION ALL SELECT design_id, b, a, pb, cb, ca, d, gap FROM pairs WHERE d < 12)"""


def _q(p: float, of: str = "q") -> str:
    return f"{of}[LEAST(len({of}) - 1, CAST(FLOOR(CAST({p} AS DOUBLE) * len({of})) AS BIGINT)) + 1]"


@query("stones", sql=_BOTH + f""", each_one AS (SELECT design_id, s.stone_id, s.phys_mm, MIN(d) AS nn1, MIN(gap) AS gap, COUNT(*) FILTER (WHERE gap < CAST(0.6 AS DOUBLE)) AS touch FROM stones s LEFT JOIN ends USING (design_id, stone_id) GROUP BY ALL)
SELECT design_id, n, {', '.join(half_up(_q(p, 'main'), 2) + f' AS nn1_{name}' for p, name in ((0.1, 'p10'), (0.5, 'median'), (0.9, 'p90')))}, {half_up(_q(0.5, 'gaps'), 2)} AS gap_median, t0, t1, t2, t3, t4, {half_up('mean', 2)} AS touch_mean FROM (
  SELECT design_id, COUNT(*) AS n, list(nn1 ORDER BY nn1) FILTER (WHERE phys_mm = CAST(2.8 AS DOUBLE) AND nn1 IS NOT NULL) AS main, list(gap ORDER BY gap) FILTER (WHERE gap IS NOT NULL) AS gaps,
    {', '.join(f"COUNT(*) FILTER (WHERE LEAST(touch, 4) = {i}) AS t{i}" for i in range(5))}, AVG(touch) AS mean FROM each_one GROUP BY design_id)""")
def geometry_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Centre distances of the main size, gaps, and how many stones touch none, one, two, three or more."""
    near = _ends(spark, sf, 12.0).groupBy("design_id", "stone_id").agg(F.min("distance").alias("nn1"), F.min("gap").alias("gap"), F.count_if(F.col("gap") < 0.6).alias("touch"))
    rows = T.stones(spark, sf).select("design_id", "stone_id", "phys_mm").join(near, ["design_id", "stone_id"], "left").withColumn("touch", F.coalesce("touch", F.lit(0)))
    held = [F.count_if(F.least("touch", F.lit(4)) == i).alias(f"t{i}") for i in range(5)]
    sums = rows.groupBy("design_id").agg(F.count("*").alias("n"), sorted_values(F.when(F.col("phys_mm") == 2.8, F.col("nn1"))).alias("main"), sorted_values(F.col("gap")).alias("gaps"), *held, F.avg("touch").alias("mean"))
    at = lambda c, p: rounded(quantile_outer(F.col(c), p), 2)
    return sums.select("design_id", "n", at("main", 0.1).alias("nn1_p10"), at("main", 0.5).alias("nn1_median"), at("main", 0.9).alias("nn1_p90"), at("gaps", 0.5).alias("gap_median"), *(f"t{i}" for i in range(5)), rounded(F.col("mean"), 2).alias("touch_mean"))


@query("stones", sql=_BOTH + f""", each_one AS (SELECT design_id, stone_id, MIN(d) AS nn, MIN(gap) AS gap, COUNT(*) FILTER (WHERE gap < CAST(1.5 AS DOUBLE)) AS nb, COUNT(*) FILTER (WHERE gap < CAST(1.5 AS DOUBLE) AND code = other_code) AS same FROM ends GROUP BY ALL),
counted AS (SELECT design_id, list(nn ORDER BY nn) AS nn, list(gap ORDER BY gap) AS gaps, COUNT(*) FILTER (WHERE gap < CAST(-0.3 AS DOUBLE)) AS n_overlaps, COUNT(*) FILTER (WHERE nb > 0) AS with_nb, COUNT(*) FILTER (WHERE nb > 0 AND same = 0) AS alone FROM each_one GROUP BY design_id),
tight AS (SELECT design_id, COUNT(*) FILTER (WHERE gap < CAST(-0.05 AS DOUBLE)) AS pair_overlap, COUNT(*) FILTER (WHERE gap >= CAST(-0.05 AS DOUBLE) AND gap < CAST(0.1 AS DOUBLE)) AS pair_close FROM pairs WHERE d < 12 GROUP BY design_id)
SELECT design_id, {', '.join(half_up(_q(p, c), 4) + f' AS {c}_{name}' for c in ('nn', 'gaps') for p, name in ((0.1, 'p10'), (0.5, 'p50'), (0.9, 'p90')))}, n_overlaps, pair_overlap, pair_close, {half_up('CASE WHEN with_nb > 0 THEN 100 * CAST(alone AS DOUBLE) / with_nb ELSE 0 END', 4)} AS isolated_pct FROM counted JOIN tight USING (design_id)""")
def neighbour_stats(spark: SparkSession, sf: str) -> DataFrame:
    ends = _ends(spark, sf, 12.0, "code_id")
    near = F.col("gap") < 1.5
    each = ends.groupBy("design_id", "stone_id").agg(
        F.min("distance").alias("nn"), F.min("gap").alias("gap"), F.count_if(near).alias("nb"), F.count_if(near & (F.col("a_code_id") == F.col("b_code_id"))).alias("same"),
        # a pair counts at its smaller end
        F.count_if((F.col("stone_id") < F.col("other")) & (F.col("gap") < -0.05)).alias("_overlap"), F.count_if((F.col("stone_id") < F.col("other")) & (F.col("gap") >= -0.05) & (F.col("gap") < 0.1)).alias("_close"),
    )
    rows = each.groupBy("design_id").agg(sorted_values(F.col("nn")).alias("nn"), sorted_values(F.col("gap")).alias("gaps"), F.count_if(F.col("gap") < -0.3).alias("n_overlaps"), F.count_if(F.col("nb") > 0).alias("with_nb"), F.count_if((F.col("nb") > 0) & (F.col("same") == 0)).alias("alone"), F.sum("_overlap").alias("pair_overlap"), F.sum("_close").alias("pair_close"))
    at = lambda c, p, name: rounded(quantile_outer(F.col(c), p), 4).alias(f"{c}_{name}")
    cuts = [at(c, p, name) for c in ("nn", "gaps") for p, name in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))]
    alone = rounded(F.when(F.col("with_nb") > 0, 100.0 * F.col("alone") / F.col("with_nb")).otherwise(0.0), 4)
    return rows.select("design_id", *cuts, "n_overlaps", "pair_overlap", "pair_close", alone.alias("isolated_pct"))


@query("stones", "beads", sql=f"SELECT design_id, {half_up('SUM(CASE WHEN shape = ' + chr(39) + 'round' + chr(39) + ' THEN CAST(3.141592653589793 AS DOUBLE) * d_mm * d_mm / 4 ELSE CAST(0.7 AS DOUBLE) * d_mm * d_mm END) / 90000', 6)} AS coverage FROM beads GROUP BY design_id")
def shaped_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """The covered share of the canvas, shaped stones as seven tenths of their box."""
    d2 = F.col("d_mm") * F.col("d_mm")
    area = F.when(F.col("shape") == "round", F.lit(math.pi) * d2 / 4).otherwise(F.lit(0.7) * d2)
    return T.beads(spark, sf).groupBy("design_id").agg(rounded(F.sum(area) / 90000, 6).alias("coverage"))


@query("stones", "catalog", sql=_TOUCH + f"""SELECT design_id, COUNT(*) AS edges, {half_up('AVG(CASE WHEN ca <> cb THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)', 6)} AS flip_rate, COUNT(*) FILTER (WHERE de < 8) AS similar, {half_up('AVG(CASE WHEN ca <> cb THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) FILTER (WHERE de < 8)', 6)} AS similar_flip_rate FROM {color.nest('touching', _DE)} GROUP BY design_id""")
def flip_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Of touching pairs, the share with different codes; the same of those of nearly one colour."""
    differ = F.when(F.col("a_code_id") != F.col("b_code_id"), 1.0).otherwise(0.0)
    near = F.col("de") < 8
    return _touch_colors(spark, sf).groupBy("design_id").agg(F.count("*").alias("edges"), rounded(F.avg(differ), 6).alias("flip_rate"), F.count_if(near).alias("similar"), rounded(F.avg(F.when(near, differ)), 6).alias("similar_flip_rate"))


_ANGLE = "(6 * ATAN2(b.y_mm - a.y_mm, b.x_mm - a.x_mm))"


@query("stones", sql=f""", near AS (SELECT a.design_id, a.layer, a.stone_id, COS({_ANGLE}) AS re, SIN({_ANGLE}) AS im, SQRT((a.x_mm - b.x_mm) * (a.x_mm - b.x_mm) + (a.y_mm - b.y_mm) * (a.y_mm - b.y_mm)) - (a.phys_mm + b.phys_mm) / 2 AS gap
  FROM stones a JOIN stones b ON a.design_id = b.design_id AND a.layer = b.layer AND a.stone_id <> b.stone_id AND abs(a.x_mm - b.x_mm) < 11 AND abs(a.y_mm - b.y_mm) < 11),
each_one AS (SELECT design_id, layer, stone_id, COUNT(*) AS n, SQRT(SUM(re) * SUM(re) + SUM(im) * SUM(im)) / COUNT(*) AS psi6 FROM near WHERE gap < CAST(0.8 AS DOUBLE) GROUP BY ALL)
SELECT design_id, layer, COUNT(*) AS inner_stones, {half_up('AVG(psi6)', 6)} AS psi6, {half_up('AVG(n)', 6)} AS degree FROM each_one WHERE n >= 3 GROUP BY ALL""")
def hexagonal_order(spark: SparkSession, sf: str) -> DataFrame:
    """How hexagonal the neighbours of stones with three or more touching ones stand: 1 in a perfect lattice."""
    rows = T.stones(spark, sf).select("design_id", "layer", "stone_id", "x_mm", "y_mm", "phys_mm")
    pairs = S.within(rows, rows, 10.8, ["design_id", "layer"]).where((F.col("a_stone_id") != F.col("b_stone_id")) & (S.gap() < 0.8))
    angle = 6 * F.atan2(F.col("b_y_mm") - F.col("a_y_mm"), F.col("b_x_mm") - F.col("a_x_mm"))
    each = pairs.groupBy("design_id", "layer", "a_stone_id").agg(F.count("*").alias("n"), (F.hypot(F.sum(F.cos(angle)), F.sum(F.sin(angle))) / F.count("*")).alias("psi6")).where("n >= 3")
    return each.groupBy("design_id", "layer").agg(F.count("*").alias("inner_stones"), rounded(F.avg("psi6"), 6).alias("psi6"), rounded(F.avg("n"), 6).alias("degree"))


@query("stones", sql=f""", near AS (SELECT a.design_id, a.layer, a.stone_id, b.stone_id AS other, {_ANGLE} AS angle, (a.x_mm - b.x_mm) * (a.x_mm - b.x_mm) + (a.y_mm - b.y_mm) * (a.y_mm - b.y_mm) AS dd FROM stones a JOIN stones b ON a.design_id = b.design_id AND a.layer = b.layer AND a.stone_id <> b.stone_id AND abs(a.x_mm - b.x_mm) < 6 AND abs(a.y_mm - b.y_mm) < 6),
first AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id, stone_id ORDER BY dd, other) AS k FROM near WHERE SQRT(dd) < 6) WHERE k = 1)
SELECT design_id, layer, COUNT(*) AS n, {half_up('ATAN2(SUM(SIN(angle)), SUM(COS(angle))) / 6 * 180 / CAST(3.141592653589793 AS DOUBLE)', 4)} AS degrees FROM first GROUP BY ALL""")
def region_angle(spark: SparkSession, sf: str) -> DataFrame:
    """The main direction of a layer's lattice, modulo 60 degrees, from each stone's nearest neighbour."""
    rows = T.stones(spark, sf).select("design_id", "layer", "stone_id", "x_mm", "y_mm")
    pairs = S.within(rows, rows, 6.0, ["design_id", "layer"]).where("a_stone_id <> b_stone_id")
    dx, dy = F.col("a_x_mm") - F.col("b_x_mm"), F.col("a_y_mm") - F.col("b_y_mm")
    first = pairs.groupBy("design_id", "layer", "a_stone_id").agg(F.min(F.struct((dx * dx + dy * dy).alias("dd"), "b_stone_id", (6 * F.atan2(-dy, -dx)).alias("angle"))).alias("m"))
    angle = F.col("m.angle")
    return first.groupBy("design_id", "layer").agg(F.count("*").alias("n"), rounded(F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle))) / 6 * 180 / F.lit(math.pi), 4).alias("degrees"))


_OWNER_SQL = """, cells AS (SELECT i AS x, j AS y FROM range(75) a(i), range(75) b(j)),
reach AS (SELECT s.design_id, c.x, c.y, s.stone_id, SQRT((c.x * 4 + 2 - s.x_mm) * (c.x * 4 + 2 - s.x_mm) + (c.y * 4 + 2 - s.y_mm) * (c.y * 4 + 2 - s.y_mm)) AS d, s.phys_mm / 2 AS r FROM stones s JOIN cells c ON abs(c.x * 4 + 2 - s.x_mm) <= 9 AND abs(c.y * 4 + 2 - s.y_mm) <= 9),
owned AS MATERIALIZED (SELECT design_id, x, y, stone_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id, x, y ORDER BY d - r, stone_id) AS k FROM reach WHERE d <= 3 + r) WHERE k = 1)
"""


#: Width of a cell, what a stone owns beyond its edge, the largest stone, cells along a side.
_CELLS = (4.0, 3.0, 10.0, 75)


def owners(stones: DataFrame, cell: float, spare: float, most: float, cells: int) -> DataFrame:
    """(design_id, x, y, stone_id): the stone whose edge is nearest to each cell's middle, at most ``spare`` beyond it."""
    around = F.sequence(F.lit(-math.ceil((most / 2 + spare) / cell)), F.lit(math.ceil((most / 2 + spare) / cell)))
    spots = stones.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).withColumns({"x": F.floor(F.col("x_mm") / cell) + F.col("i"), "y": F.floor(F.col("y_mm") / cell) + F.col("j")}).where(F.col("x").between(0, cells - 1) & F.col("y").between(0, cells - 1))
    dx, dy = F.col("x") * cell + cell / 2 - F.col("x_mm"), F.col("y") * cell + cell / 2 - F.col("y_mm")
    spots = spots.withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= spare + F.col("phys_mm") / 2)
    return spots.groupBy("design_id", "x", "y").agg(F.min(F.struct((F.col("d") - F.col("phys_mm") / 2).alias("over"), "stone_id")).alias("m")).select("design_id", "x", "y", "m.stone_id")


def _owned(spark: SparkSession, sf: str) -> DataFrame:
    return owners(T.stones(spark, sf).select("design_id", "stone_id", "x_mm", "y_mm", "phys_mm"), *_CELLS)


@query("stones", sql=_OWNER_SQL + "SELECT design_id, stone_id, COUNT(*) AS cells FROM owned GROUP BY ALL")
def cell_owners(spark: SparkSession, sf: str) -> DataFrame:
    """How many 4 mm cells each stone owns."""
    return _owned(spark, sf).groupBy("design_id", "stone_id").agg(F.count("*").alias("cells"))


def _adjacent(stones: DataFrame) -> DataFrame:
    """Designs too large for a task: cells, their owners and sides as tables."""
    stones = S.stored(stones, "stones")
    owned = owners(stones, *_CELLS).withColumn("sides", F.array(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy"))))
    owned = S.stored(owned, "owned")
    here = owned.select("design_id", "x", "y", F.col("stone_id").alias("p"))
    # a cell shows itself to its left and upper neighbour
    shown = owned.select("design_id", F.explode(F.slice("sides", 2, 2)).alias("s"), "x", "y", F.col("stone_id").alias("q")).select("design_id", (F.col("x") - F.col("s.dx")).alias("x"), (F.col("y") - F.col("s.dy")).alias("y"), "q")
    pairs = here.join(shown, ["design_id", "x", "y"]).where("p <> q").select("design_id", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    of = lambda c: stones.select("design_id", F.col("stone_id").alias(c), F.col("x_mm").alias(f"{c}x"), F.col("y_mm").alias(f"{c}y"), F.col("phys_mm").alias(f"{c}p"))
    met = pairs.join(of("a"), ["design_id", "a"]).join(of("b"), ["design_id", "b"])
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return met.where(F.sqrt(dx * dx + dy * dy) <= F.lit(1.5) * 3 + (F.col("ap") + F.col("bp")) / 2 - F.lit(2.8)).select("design_id", "a", "b")


@query("stones", sql=_OWNER_SQL + """, sides AS (SELECT a.design_id, a.stone_id AS p, b.stone_id AS q FROM owned a JOIN owned b ON a.design_id = b.design_id AND b.x = a.x + 1 AND b.y = a.y WHERE a.stone_id <> b.stone_id
  UNION ALL SELECT a.design_id, a.stone_id, b.stone_id FROM owned a JOIN owned b ON a.design_id = b.design_id AND b.x = a.x AND b.y = a.y + 1 WHERE a.stone_id <> b.stone_id)
SELECT DISTINCT design_id, LEAST(p, q) AS a, GREATEST(p, q) AS b FROM sides JOIN (SELECT design_id, stone_id AS p, x_mm AS px, y_mm AS py, phys_mm AS pp FROM stones) USING (design_id, p) JOIN (SELECT design_id, stone_id AS q, x_mm AS qx, y_mm AS qy, phys_mm AS pq FROM stones) USING (design_id, q)
WHERE SQRT((px - qx) * (px - qx) + (py - qy) * (py - qy)) <= CAST(1.5 AS DOUBLE) * 3 + (pp + pq) / 2 - CAST(2.8 AS DOUBLE)""")
def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    """Stones whose cells lie side by side, unless a long way apart."""
    return passes.side_by_side(T.stones(spark, sf), KEY, _adjacent, *_CELLS, least=2.8)


# Along lines ----------------------------------------------------------------------------------------------------------

_LINE = "line AS (SELECT design_id, CAST(FLOOR(y_mm / 15) AS BIGINT) AS row, x_mm, stone_id, phys_mm, lab_l, lab_a, lab_b, edge FROM beads)"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return T.beads(spark, sf).withColumn("row", F.floor(F.col("y_mm") / 15))


def _along(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("x_mm", "stone_id")


@query("stones", "beads", sql=f""", {_LINE}, named AS (SELECT *, CASE WHEN {B.material()} IN ('pearl', 'white') THEN 'pale' ELSE 'rich' END AS family FROM line), cut AS (SELECT *, CASE WHEN family IS DISTINCT FROM LAG(family) OVER (PARTITION BY design_id, row ORDER BY x_mm, stone_id) THEN 1 ELSE 0 END AS new FROM named),
runs AS (SELECT design_id, row, run, ANY_VALUE(family) AS family, COUNT(*) AS n FROM (SELECT *, SUM(new) OVER (PARTITION BY design_id, row ORDER BY x_mm, stone_id) AS run FROM cut) GROUP BY ALL)
SELECT design_id, row, COUNT(*) AS runs, MAX(n) AS longest, COUNT(*) = 2 AND MIN(n) >= 2 AS gradient FROM runs GROUP BY ALL""")
def runs_along(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one material family along each row of stones; exactly two of two or more make a gradient."""
    rows = _lines(spark, sf).withColumn("family", F.when(F.expr(B.material()).isin("pearl", "white"), "pale").otherwise("rich"))
    return islands(rows, ["design_id", "row"], "family").groupBy("design_id", "row").agg(F.count("*").alias("runs"), F.max("n").alias("longest"), ((F.count("*") == 2) & (F.min("n") >= 2)).alias("gradient"))


def islands(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of equal values along (x_mm, stone_id): keys, run, value, n."""
    order = _along(*keys)
    new = F.when(F.lag(value).over(order).eqNullSafe(F.col(value)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(order)).groupBy(*keys, "run", value).agg(F.count("*").alias("n"))


@query("stones", "beads", sql=f""", {_LINE}, stepped AS (SELECT *, COALESCE(tenths - LAG(tenths) OVER (PARTITION BY design_id, row ORDER BY x_mm, stone_id), 0) AS step FROM (SELECT *, CAST(FLOOR(x_mm * 10 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS tenths FROM line)), placed AS (SELECT *, SUM(step) OVER (PARTITION BY design_id, row ORDER BY x_mm, stone_id ROWS UNBOUNDED PRECEDING) AS along FROM stepped)
SELECT design_id, row, CAST(along // 120 AS BIGINT) AS bin, MIN(stone_id) AS stone_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id, row, along // 120 ORDER BY x_mm, stone_id) AS k FROM placed) WHERE k = 1 GROUP BY ALL""")
def resampled(spark: SparkSession, sf: str) -> DataFrame:
    """The first stone of each 12 mm walked along a row."""
    # in tenths of a millimetre, whose sums are exact
    rows = _lines(spark, sf).withColumn("tenths", F.floor(F.col("x_mm") * 10 + F.lit(0.5)))
    walked = rows.withColumn("step", F.coalesce(F.col("tenths") - F.lag("tenths").over(_along("design_id", "row")), F.lit(0))).withColumn("along", F.sum("step").over(_along("design_id", "row").rowsBetween(Window.unboundedPreceding, 0)))
    return walked.groupBy("design_id", "row", F.floor(F.col("along") / 120).alias("bin")).agg(F.min(F.struct("x_mm", "stone_id")).alias("m")).select("design_id", "row", "bin", "m.stone_id")


_RING = "ring AS (SELECT design_id, CAST(FLOOR(x_mm / 10) AS BIGINT) AS i, COUNT(*) AS v FROM stones GROUP BY ALL)"


def peaks(rows: DataFrame, keys: list[str], at: str, value: str, size: int, window: int) -> DataFrame:
    """Places of a ring of ``size`` that no place within the window exceeds, nor any before it equals."""
    # the ring is unrolled: its last places before the first, its first ones after the last
    unrolled = rows.withColumn("_turn", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_at", F.col(at) + F.col("_turn") * size).where(F.col("_at").between(-window, size - 1 + window))
    order = Window.partitionBy(*keys).orderBy("_at")
    before, after = F.max(value).over(order.rangeBetween(-window, -1)), F.max(value).over(order.rangeBetween(1, window))
    top = (F.col(value) > F.coalesce(before, F.lit(-1))) & (F.col(value) >= F.coalesce(after, F.lit(-1)))
    return unrolled.withColumn("_top", top).where("_top AND _turn = 0").drop("_turn", "_at", "_top")


@query("stones", sql=f", {_RING} SELECT design_id, i, v FROM ring a WHERE NOT EXISTS (SELECT 1 FROM ring b WHERE b.design_id = a.design_id AND b.i <> a.i AND ((((a.i - b.i) + 30) % 30 <= 2 AND b.v >= a.v) OR (((b.i - a.i) + 30) % 30 <= 2 AND b.v > a.v)))")
def ring_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of the canvas, seen as a ring of thirty, that hold more stones than the two on either side."""
    ring = T.stones(spark, sf).groupBy("design_id", F.floor(F.col("x_mm") / 10).alias("i")).agg(F.count("*").alias("v"))
    return peaks(ring, ["design_id"], "i", "v", 30, 2)


@query("stones", sql=""", ranked AS (SELECT design_id, n, ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY n DESC, code_id) AS k, SUM(n) OVER (PARTITION BY design_id) AS whole FROM (SELECT design_id, code_id, COUNT(*) AS n FROM stones GROUP BY ALL)),
curve AS (SELECT design_id, k, CAST(FLOOR(CAST(whole - SUM(n) OVER (PARTITION BY design_id ORDER BY k) AS DOUBLE) / 20) AS BIGINT) AS error FROM ranked)
SELECT design_id, CAST(MIN(k) AS INTEGER) AS codes, MIN(error) AS error FROM curve c WHERE k <= 15 AND error = (SELECT MIN(error) FROM curve d WHERE d.design_id = c.design_id AND d.k <= 15) GROUP BY design_id""")
def palette_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Of palette sizes up to fifteen, the smallest that reaches the least error; an error is twenty stones uncovered."""
    counts = T.stones(spark, sf).groupBy("design_id", "code_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("design_id").orderBy(F.desc("n"), "code_id")
    curve = counts.withColumns({"k": F.row_number().over(order), "covered": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "whole": F.sum("n").over(Window.partitionBy("design_id"))}).where("k <= 15")
    curve = curve.withColumn("error", F.floor((F.col("whole") - F.col("covered")).cast("double") / 20))
    return curve.groupBy("design_id").agg(F.min(F.struct("error", "k")).alias("m")).select("design_id", F.col("m.k").alias("codes"), F.col("m.error").alias("error"))


@query("stones", sql=_P + ", found AS (SELECT design_id, a FROM pairs WHERE d < 10 AND gap < CAST(-0.05 AS DOUBLE)) SELECT design_id, COUNT(*) AS n_ids, list(a ORDER BY a)[1:50] AS ids FROM (SELECT DISTINCT design_id, a FROM found) GROUP BY design_id".replace("list(a ORDER BY a)[1:50] AS ids", "array_to_string(list(a ORDER BY a)[1:50], ',') AS ids"))
def finding_ids(spark: SparkSession, sf: str) -> DataFrame:
    """A finding's stones: how many, and the first fifty ids."""
    rows = S.close_pairs(T.stones(spark, sf).select("design_id", "stone_id", "x_mm", "y_mm", "phys_mm"), -0.05, KEY).select("design_id", F.col("a_stone_id").alias("id")).distinct()
    return first_ids(rows, KEY, "id", 50).withColumn("ids", F.array_join("ids", ","))


def first_ids(rows: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """How many values each group has and the smallest of them, no more than ``most`` of which are gathered."""
    ranked = rows.withColumns({"_k": F.row_number().over(Window.partitionBy(*keys).orderBy(value)), "_n": F.count("*").over(Window.partitionBy(*keys))})
    return ranked.where(F.col("_k") <= most).groupBy(*keys).agg(F.max("_n").alias("n_ids"), F.array_sort(F.collect_list(value)).alias("ids"))


_AB = "SQRT((a.x_mm - b.x_mm) * (a.x_mm - b.x_mm) + (a.y_mm - b.y_mm) * (a.y_mm - b.y_mm))"
_TURN = "CAST(stone_id * 37 % 360 AS DOUBLE)"
_PI = "CAST(3.141592653589793 AS DOUBLE)"
_SHAPED = f""", shaped AS MATERIALIZED (SELECT design_id, stone_id, x_mm, y_mm, s.phys_mm, c.shape, radians({_TURN}) AS t, s.phys_mm AS h, s.phys_mm * CASE c.shape WHEN 'marquise' THEN CAST(0.5 AS DOUBLE) WHEN 'teardrop' THEN CAST(0.6 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS w
  FROM stones s JOIN (SELECT code_id, shape FROM catalog) c USING (code_id)),
bounded AS (SELECT *, CASE WHEN shape = 'round' THEN phys_mm ELSE SQRT(w * w + h * h) END AS bound FROM shaped),
near AS MATERIALIZED (SELECT a.design_id, a.stone_id AS a, b.stone_id AS b, a.shape = 'round' AND b.shape = 'round' AS plain, {_AB} - (a.phys_mm + b.phys_mm) / 2 AS exact FROM bounded a JOIN bounded b ON a.design_id = b.design_id AND a.stone_id < b.stone_id
  AND abs(a.x_mm - b.x_mm) < 17 AND abs(a.y_mm - b.y_mm) < 17 WHERE {_AB} - (a.bound + b.bound) / 2 < CAST(0.15 AS DOUBLE)),
steps AS (SELECT CAST(range AS DOUBLE) AS i FROM range(64)),
curve AS (SELECT i, CAST(16 AS DOUBLE) * sin(2 * {_PI} * i / 64) ^ 3 AS u, -(13 * cos(2 * {_PI} * i / 64) - 5 * cos(4 * {_PI} * i / 64) - 2 * cos(6 * {_PI} * i / 64) - cos(8 * {_PI} * i / 64)) AS v FROM steps),
unit AS (SELECT i, (u - MIN(u) OVER ()) / (MAX(u) OVER () - MIN(u) OVER ()) - CAST(0.5 AS DOUBLE) AS u, (v - MIN(v) OVER ()) / (MAX(v) OVER () - MIN(v) OVER ()) - CAST(0.5 AS DOUBLE) AS v FROM curve),
kinds AS (SELECT DISTINCT shape, w, h FROM shaped),
points AS (
  SELECT shape, w, h, i, w / 2 * cos(2 * {_PI} * i / 32) AS u, h / 2 * sin(2 * {_PI} * i / 32) AS v FROM kinds, steps WHERE shape = 'round' AND i < 32
  UNION ALL SELECT shape, w, h, i, unit.u * w, unit.v * h FROM kinds, unit WHERE shape = 'heart'
  UNION ALL SELECT shape, w, h, i, CASE WHEN i <= 32 THEN 1 ELSE -1 END * GREATEST(SQRT(GREATEST(r * r - v * v, CAST(0 AS DOUBLE))) - (r - w / 2), CAST(0 AS DOUBLE)), v FROM (SELECT *, (w * w + h * h) / (4 * w) AS r, CASE WHEN i <= 32 THEN h * (i / 32 - CAST(0.5 AS DOUBLE)) ELSE h * ((64 - i) / 32 - CAST(0.5 AS DOUBLE)) END AS v FROM kinds, steps WHERE shape = 'marquise')
  UNION ALL SELECT shape, w, h, i, CASE WHEN i = 63 THEN CAST(0 AS DOUBLE) ELSE w / 2 * cos(ang) END, CASE WHEN i = 63 THEN h / 2 ELSE w / 2 - h / 2 + w / 2 * sin(ang) END FROM (SELECT *, {_PI} / 2 + touch + (2 * {_PI} - 2 * touch) * i / 62 AS ang FROM (SELECT *, acos(LEAST(CAST(1 AS DOUBLE), w / 2 / (h - w / 2))) AS touch FROM kinds, steps WHERE shape = 'teardrop'))),
sides AS (SELECT shape, w, h, i, u, v, COALESCE(LEAD(u) OVER o, FIRST_VALUE(u) OVER o) AS u2, COALESCE(LEAD(v) OVER o, FIRST_VALUE(v) OVER o) AS v2 FROM points WINDOW o AS (PARTITION BY shape, w, h ORDER BY i)),
lines AS MATERIALIZED (SELECT design_id, stone_id, i, x_mm + u * cos(t) - v * sin(t) AS x, y_mm + u * sin(t) + v * cos(t) AS y, x_mm + u2 * cos(t) - v2 * sin(t) AS x2, y_mm + u2 * sin(t) + v2 * cos(t) AS y2 FROM shaped JOIN sides USING (shape, w, h)
  WHERE (design_id, stone_id) IN (SELECT (design_id, a) FROM near WHERE NOT plain UNION SELECT (design_id, b) FROM near WHERE NOT plain)),
ways AS (SELECT design_id, a, b, a AS p, b AS q FROM near WHERE NOT plain UNION ALL SELECT design_id, a, b, b, a FROM near WHERE NOT plain),
met AS (SELECT w.design_id, w.a, w.b, w.p, p.i, p.x, p.y, s.x AS x1, s.y AS y1, s.x2 - s.x AS dx, s.y2 - s.y AS dy, s.y2 FROM ways w JOIN lines p ON p.design_id = w.design_id AND p.stone_id = w.p JOIN lines s ON s.design_id = w.design_id AND s.stone_id = w.q),
along AS (SELECT *, GREATEST(CAST(0 AS DOUBLE), LEAST(CAST(1 AS DOUBLE), ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) AS k FROM met),
each AS (SELECT design_id, a, b, p, i, MIN(SQRT((x - x1 - k * dx) ^ 2 + (y - y1 - k * dy) ^ 2)) AS d, COUNT(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < dx * (y - y1) / dy + x1) % 2 = 1 AS inside FROM along GROUP BY ALL),
measured AS (SELECT design_id, a, b, CASE WHEN bool_or(inside) THEN -MAX(d) FILTER (WHERE inside) ELSE MIN(d) END AS gap FROM each GROUP BY ALL UNION ALL SELECT design_id, a, b, exact FROM near WHERE plain)
"""


def shaped_stones(spark: SparkSession, sf: str) -> DataFrame:
    """Stones with the shape of their code, its box and a turn."""
    rows = T.stones(spark, sf).select("design_id", "stone_id", "x_mm", "y_mm", "phys_mm", "code_id").join(T.catalog(spark, sf).select("code_id", "shape"), "code_id")
    width = F.when(F.col("shape") == "marquise", 0.5).when(F.col("shape") == "teardrop", 0.6).otherwise(1.0)
    return rows.select("design_id", "stone_id", "x_mm", "y_mm", "phys_mm", "shape", (F.col("phys_mm") * width).alias("w_mm"), F.col("phys_mm").alias("h_mm"), F.expr(_TURN).alias("rot_deg"))


@query("stones", "catalog", sql=_SHAPED + f"SELECT design_id, a, b, {half_up('gap', 4)} AS gap FROM measured WHERE gap < CAST(0.15 AS DOUBLE)")
def shaped_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of stones of any shape that overlap or are less than 0.15 mm apart, by their outlines."""
    return shaped_pairs(shaped_stones(spark, sf), 0.15, KEY).select("design_id", F.col("a_stone_id").alias("a"), F.col("b_stone_id").alias("b"), rounded(F.col("gap"), 4).alias("gap"))
