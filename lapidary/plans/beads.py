"""Queries on measured beads: material rules, gates, histograms, model inputs, tiles and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapidary.functions import beads as B
from lapidary.functions import color
from lapidary.functions.numeric import half_up, rounded
from lapidary.operators import spatial as S
from lapidary.plans.registry import Registry
from lapidary.sources import tables as T

query = Registry()
_CODE = color.nest("catalog", color.lab_steps("r", "g", "b", "c"))


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue with Lab columns c_l, c_a, c_b."""
    return color.add(T.catalog(spark, sf), color.lab_steps("r", "g", "b", "c"), ["c_l", "c_a", "c_b"])


@query("stones", "beads", sql=f"""SELECT design_id, material, tier, COUNT(*) AS n, {half_up(f'AVG({B.confidence()})', 6)} AS confidence, COUNT(*) FILTER (WHERE {B.is_pearl()}) AS pearls, COUNT(*) FILTER (WHERE {B.is_gold()}) AS golden
FROM (SELECT *, {B.material()} AS material, {B.tier('phys_mm')} AS tier FROM beads) GROUP BY ALL""")
def bead_materials(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.beads(spark, sf).withColumns({"material": F.expr(B.material()), "tier": F.expr(B.tier("phys_mm"))}).withColumn("confidence", F.expr(B.confidence()))
    return rows.groupBy("design_id", "material", "tier").agg(F.count("*").alias("n"), rounded(F.avg("confidence"), 6).alias("confidence"), F.count_if(F.expr(B.is_pearl())).alias("pearls"), F.count_if(F.expr(B.is_gold())).alias("golden"))


@query("stones", "beads", sql=f"SELECT design_id, CASE WHEN {B.is_pearl()} THEN 'pearl' ELSE {B.image_material()} END AS material, COUNT(*) AS n FROM beads GROUP BY ALL")
def image_materials(spark: SparkSession, sf: str) -> DataFrame:
    return T.beads(spark, sf).groupBy("design_id", F.when(F.expr(B.is_pearl()), "pearl").otherwise(F.expr(B.image_material())).alias("material")).agg(F.count("*").alias("n"))


@query("stones", "beads", sql=f"SELECT shape, COUNT(*) AS n, COUNT(*) FILTER (WHERE {B.bead_like()}) AS alike FROM beads GROUP BY shape")
def bead_outlines(spark: SparkSession, sf: str) -> DataFrame:
    return T.beads(spark, sf).groupBy("shape").agg(F.count("*").alias("n"), F.count_if(F.expr(B.bead_like())).alias("alike"))


@query("catalog", sql=f"SELECT code_id, {B.code_material('c_l', 'c_a', 'c_b')} AS material, {B.is_gold('c_l', 'c_a', 'c_b')} AS golden FROM {_CODE}")
def code_materials(spark: SparkSession, sf: str) -> DataFrame:
    return _codes(spark, sf).select("code_id", F.expr(B.code_material("c_l", "c_a", "c_b")).alias("material"), F.expr(B.is_gold("c_l", "c_a", "c_b")).alias("golden"))


@query("stones", "beads", "catalog", sql=f"SELECT design_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE {B.hue_fits('lab', 'c')}) AS fits FROM beads JOIN (SELECT code_id, c_a, c_b FROM {_CODE}) USING (code_id) GROUP BY design_id")
def hue_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Stones whose code's hue may stand for the measured colour."""
    rows = T.beads(spark, sf).join(_codes(spark, sf).select("code_id", "c_a", "c_b"), "code_id")
    return rows.groupBy("design_id").agg(F.count("*").alias("n"), F.count_if(F.expr(B.hue_fits("lab", "c"))).alias("fits"))


@query("stones", "beads", sql=f"SELECT design_id, {half_up('FLOOR(d_mm / CAST(0.5 AS DOUBLE)) * CAST(0.5 AS DOUBLE)', 4)} AS edge, COUNT(*) AS n FROM beads GROUP BY ALL")
def size_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return histogram(T.beads(spark, sf), "d_mm", 0.5, ["design_id"])


def histogram(rows: DataFrame, value: str, step: float, keys: list[str]) -> DataFrame:
    """How many values lie in each step: keys, edge (lower), n."""
    return rows.groupBy(*keys, rounded(F.floor(F.col(value) / F.lit(step)) * F.lit(step), 4).alias("edge")).agg(F.count("*").alias("n"))


_RECORD = ["layer", "material", "phys_mm", "t_l", "t_a", "t_b"]


@query("stones", "beads", sql=f"SELECT layer, material, phys_mm, t_l, t_a, t_b, COUNT(*) AS records, {half_up('SUM(wt)', 4)} AS weight FROM (SELECT layer, {B.material()} AS material, phys_mm, d_mm * d_mm AS wt, {half_up('lab_l / 4')} * 4 AS t_l, {half_up('lab_a / 4')} * 4 AS t_a, {half_up('lab_b / 4')} * 4 AS t_b FROM beads) GROUP BY ALL")
def cost_records(spark: SparkSession, sf: str) -> DataFrame:
    """Alike records folded into one with their weight, before any cost is taken."""
    rows = T.beads(spark, sf).withColumn("material", F.expr(B.material())).withColumns({f"t_{c}": rounded(F.col(f"lab_{c}") / 4, 0) * 4 for c in "lab"})
    return rows.groupBy(*_RECORD).agg(F.count("*").alias("records"), rounded(F.sum(F.col("d_mm") * F.col("d_mm")), 4).alias("weight"))


@query("stones", "beads", "catalog", sql=f"SELECT code_id, COUNT(*) AS n, {', '.join(half_up(f'AVG(c_{x} - lab_{x})', 6) + f' AS {x}' for x in 'lab')}, {half_up('SQRT(AVG((c_l - lab_l) * (c_l - lab_l) + (c_a - lab_a) * (c_a - lab_a) + (c_b - lab_b) * (c_b - lab_b)))', 6)} AS spread FROM beads JOIN (SELECT code_id, c_l, c_a, c_b FROM {_CODE} WHERE active) USING (code_id) GROUP BY code_id")
def colour_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """The training set of the colour model: how far each code's catalogue colour lies from what is measured of it."""
    rows = T.beads(spark, sf).join(_codes(spark, sf).where("active").select("code_id", "c_l", "c_a", "c_b"), "code_id")
    off = {x: F.col(f"c_{x}") - F.col(f"lab_{x}") for x in "lab"}
    return rows.groupBy("code_id").agg(F.count("*").alias("n"), *(rounded(F.avg(v), 6).alias(x) for x, v in off.items()), rounded(F.sqrt(F.avg(off["l"] * off["l"] + off["a"] * off["a"] + off["b"] * off["b"])), 6).alias("spread"))


# Prices per million tokens and tokens a call.
PRICE_IN, PRICE_OUT, IMAGE_TOKENS, PROMPT_TOKENS, OUT_TOKENS = 0.5, 3.0, 1120, 450, 2500


@query(sql=f"SELECT l_suppkey AS design_id, COUNT(*) AS calls, COUNT(*) * 1570 AS tokens_in, COUNT(*) * 2500 AS tokens_out, {half_up('(COUNT(*) * 1570 * CAST(0.5 AS DOUBLE) + COUNT(*) * 2500 * CAST(3 AS DOUBLE)) / CAST(1000000 AS DOUBLE)', 3)} AS usd FROM lineitem GROUP BY l_suppkey")
def cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """What a call for each stone would cost."""
    calls = T.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("design_id")).agg(F.count("*").alias("calls"))
    calls = calls.withColumns({"tokens_in": F.col("calls") * (IMAGE_TOKENS + PROMPT_TOKENS), "tokens_out": F.col("calls") * OUT_TOKENS})
    return calls.withColumn("usd", rounded((F.col("tokens_in") * F.lit(PRICE_IN) + F.col("tokens_out") * F.lit(PRICE_OUT)) / F.lit(1e6), 3))


# An image of each part: width and height in pixels.
_IMAGE = {"w": "CAST(300 + p_size * 37 AS BIGINT)", "h": "CAST(200 + p_partkey % 53 * 41 AS BIGINT)"}
TILE_PX, OVERLAP = 472, 0.1


def starts(n: Column, tile: int = TILE_PX, overlap: float = OVERLAP) -> Column:
    """Where even tiles of a length begin, neighbours overlapping by at least a share; one tile where it fits."""
    stride = max(1.0, tile * (1 - overlap))
    k = F.ceil((n - tile) / F.lit(stride)) + 1
    even = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.floor(i * ((n - tile) / (k - 1)) + F.lit(0.5)).cast("long"))
    return F.when(n <= tile, F.array(F.lit(0).cast("long"))).otherwise(even)


@query(sql=f"""WITH images AS (SELECT p_partkey AS image_id, {', '.join(f'{x} AS {c}' for c, x in _IMAGE.items())} FROM part),
counted AS (SELECT *, CASE WHEN w <= 472 THEN 1 ELSE CAST(CEIL((w - 472) / CAST(424.8 AS DOUBLE)) AS BIGINT) + 1 END AS nx, CASE WHEN h <= 472 THEN 1 ELSE CAST(CEIL((h - 472) / CAST(424.8 AS DOUBLE)) AS BIGINT) + 1 END AS ny FROM images)
SELECT image_id, j * nx + i AS tile, CASE WHEN nx = 1 THEN 0 ELSE CAST(FLOOR(i * ((w - 472) / CAST(nx - 1 AS DOUBLE)) + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS x, CASE WHEN ny = 1 THEN 0 ELSE CAST(FLOOR(j * ((h - 472) / CAST(ny - 1 AS DOUBLE)) + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS y,
  LEAST(472, w) AS w, LEAST(472, h) AS h FROM counted, LATERAL (SELECT UNNEST(range(nx)) AS i), LATERAL (SELECT UNNEST(range(ny)) AS j)""")
def tile_plan(spark: SparkSession, sf: str) -> DataFrame:
    images = T.read(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), *(F.expr(x).alias(c) for c, x in _IMAGE.items()))
    spots = images.withColumns({"xs": starts(F.col("w")), "ys": starts(F.col("h"))}).select("*", F.posexplode("ys").alias("j", "y")).select("*", F.posexplode("xs").alias("i", "x"))
    return spots.select("image_id", (F.col("j") * F.size("xs") + F.col("i")).cast("long").alias("tile"), "x", "y", F.least(F.lit(TILE_PX).cast("long"), "w").alias("w"), F.least(F.lit(TILE_PX).cast("long"), "h").alias("h"))


_BOX = [f"CAST((p_partkey * {m}) % 1301 AS DOUBLE) - 100" for m in (17, 31, 47, 61)]


@query(sql=f"""WITH boxes AS (SELECT p_partkey AS box_id, {', '.join(f'{x} AS {c}' for c, x in _IMAGE.items())}, {', '.join(f'{x} AS b{i}' for i, x in enumerate(_BOX))} FROM part),
clamped AS (SELECT *, {', '.join(f'GREATEST(LEAST(b{i}, 1000), 0) / 1000 AS c{i}' for i in range(4))} FROM boxes)
SELECT box_id, {half_up('c1 * w', 4)} AS x0, {half_up('c0 * h', 4)} AS y0, {half_up('c3 * w', 4)} AS x1, {half_up('c2 * h', 4)} AS y1 FROM clamped WHERE c2 > c0 AND c3 > c1""")
def box_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes (y0, x0, y1, x1) in thousandths, clamped, as pixels; those without an area go."""
    rows = T.read(spark, sf, "part").select(F.col("p_partkey").alias("box_id"), *(F.expr(x).alias(c) for c, x in _IMAGE.items()), F.array(*map(F.expr, _BOX)).alias("box"))
    at = F.transform("box", lambda v: F.greatest(F.least(v, F.lit(1000.0)), F.lit(0.0)) / 1000)
    rows = rows.withColumn("c", at).where((F.get("c", F.lit(2)) > F.get("c", F.lit(0))) & (F.get("c", F.lit(3)) > F.get("c", F.lit(1))))
    return rows.select("box_id", *(rounded(F.get("c", F.lit(i)) * F.col(side), 4).alias(name) for name, i, side in (("x0", 1, "w"), ("y0", 0, "h"), ("x1", 3, "w"), ("y1", 2, "h"))))


@query(sql=f"""WITH raw AS (SELECT p_partkey AS region_id, CASE p_partkey % 3 WHEN 0 THEN 'stone' WHEN 1 THEN 'print' ELSE 'cloth' END AS label, CASE p_partkey % 5 WHEN 0 THEN 'pearl' WHEN 1 THEN 'metal' WHEN 2 THEN 'wood' WHEN 3 THEN NULL ELSE 'crystal' END AS material,
  list_transform(range(CAST(2 + p_partkey % 9 AS BIGINT)), lambda i: CAST((p_partkey * 7 + i * 311) % 1400 AS DOUBLE) - 200 + CAST(0.5 AS DOUBLE)) AS points FROM part)
SELECT region_id, CASE WHEN label = 'stone' THEN 'stone' ELSE 'print' END AS label, CASE WHEN material IN ('pearl', 'metal', 'crystal') THEN material ELSE 'other' END AS material, CAST(len(points) // 2 AS BIGINT) AS corners,
  CAST(list_sum(list_transform(points[1:(len(points) // 2) * 2], lambda v: GREATEST(LEAST(FLOOR(v + CAST(0.5 AS DOUBLE)), 1000), 0))) AS DOUBLE) AS total FROM raw WHERE len(points) // 2 >= 3""")
def clean_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled polygons: unknown labels and materials to their default, corners clamped, those of under three corners gone."""
    p = F.col("p_partkey")
    rows = T.read(spark, sf, "part").select(
        p.alias("region_id"),
        F.element_at(F.array(F.lit("stone"), F.lit("print"), F.lit("cloth")), (p % 3 + 1).cast("int")).alias("label"),
        F.element_at(F.array(F.lit("pearl"), F.lit("metal"), F.lit("wood"), F.lit(None).cast("string"), F.lit("crystal")), (p % 5 + 1).cast("int")).alias("material"),
        F.transform(F.sequence(F.lit(0).cast("long"), 1 + p % 9), lambda i: ((p * 7 + i * 311) % 1400).cast("double") - 200 + F.lit(0.5)).alias("points"),
    )
    return cleaned(rows, ("pearl", "metal", "crystal")).select("region_id", "label", "material", (F.size("polygon") / 2).cast("long").alias("corners"), F.aggregate("polygon", F.lit(0.0), lambda n, v: n + v).alias("total"))


def cleaned(rows: DataFrame, materials: tuple[str, ...]) -> DataFrame:
    even = (F.floor(F.size("points") / 2) * 2).cast("int")
    corners = F.slice(F.transform(F.filter("points", lambda v: v.isNotNull() & ~F.isnan(v)), lambda v: F.greatest(F.least(F.floor(v + F.lit(0.5)).cast("double"), F.lit(1000.0)), F.lit(0.0))), F.lit(1), even)
    rows = rows.withColumns({"label": F.when(F.col("label") == "stone", "stone").otherwise("print"), "material": F.when(F.col("material").isin(*materials), F.col("material")).otherwise("other"), "polygon": corners})
    return rows.where(F.size("polygon") >= 6).drop("points")


@query("stones", sql="""SELECT design_id, layer, x, y, COUNT(*) AS n, AVG(phys_mm) AS mean FROM (SELECT design_id, layer, CAST(FLOOR(x_mm / 30) AS BIGINT) AS x, CAST(FLOOR(y_mm / 30) AS BIGINT) AS y, phys_mm FROM stones) GROUP BY ALL""".replace("AVG(phys_mm)", half_up("AVG(phys_mm)", 6)))
def box_down(spark: SparkSession, sf: str) -> DataFrame:
    """Values averaged over square boxes: an image made smaller."""
    at = lambda c: F.floor(F.col(c) / 30).alias(c[0])
    return T.stones(spark, sf).groupBy("design_id", "layer", at("x_mm"), at("y_mm")).agg(F.count("*").alias("n"), rounded(F.avg("phys_mm"), 6).alias("mean"))


_CELLS = "cells AS (SELECT design_id, CAST(FLOOR(x_mm / 20) AS BIGINT) AS x, CAST(FLOOR(y_mm / 20) AS BIGINT) AS y, COUNT(*) AS n FROM stones GROUP BY ALL)"


@query("stones", sql=f", {_CELLS} SELECT a.design_id, a.x, a.y, CAST(SUM(b.n) AS BIGINT) AS around FROM cells a JOIN cells b ON a.design_id = b.design_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY ALL")
def box_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Sums over the 5 x 5 cells around each cell that holds a stone: a window along rows, then one along columns."""
    at = lambda c: F.floor(F.col(c) / 20).alias(c[0])
    cells = T.stones(spark, sf).groupBy("design_id", at("x_mm"), at("y_mm")).agg(F.count("*").alias("n"))
    # cells without stones whose column window must still be read: those beside one in the row
    wide = cells.select("design_id", "y", "n", F.explode(F.sequence(F.col("x") - 2, F.col("x") + 2)).alias("x")).groupBy("design_id", "x", "y").agg(F.sum("n").alias("row_sum"))
    column = Window.partitionBy("design_id", "x").orderBy("y").rangeBetween(-2, 2)
    return wide.withColumn("around", F.sum("row_sum").over(column)).join(cells.select("design_id", "x", "y"), ["design_id", "x", "y"]).select("design_id", "x", "y", "around")


@query("stones", sql=""", cells AS (SELECT i AS x, j AS y FROM range(60) a(i), range(60) b(j)), designs AS (SELECT DISTINCT design_id FROM stones),
covered AS (SELECT DISTINCT s.design_id, c.x, c.y FROM stones s JOIN cells c ON abs(c.x * 5 + CAST(2.5 AS DOUBLE) - s.x_mm) < 8 AND abs(c.y * 5 + CAST(2.5 AS DOUBLE) - s.y_mm) < 8
  WHERE SQRT((c.x * 5 + CAST(2.5 AS DOUBLE) - s.x_mm) * (c.x * 5 + CAST(2.5 AS DOUBLE) - s.x_mm) + (c.y * 5 + CAST(2.5 AS DOUBLE) - s.y_mm) * (c.y * 5 + CAST(2.5 AS DOUBLE) - s.y_mm)) - s.phys_mm / 2 <= 1)
SELECT design_id, """ + half_up("100 * CAST(3600 - COUNT(x) AS DOUBLE) / 3600", 4) + """ AS empty_pct FROM designs LEFT JOIN covered USING (design_id) GROUP BY design_id""")
def empty_area(spark: SparkSession, sf: str) -> DataFrame:
    """The share of 5 mm cells whose middle lies over 1 mm from every stone."""
    rows = T.stones(spark, sf).select("design_id", "stone_id", "x_mm", "y_mm", "phys_mm")
    # a stone visits the cells around it; no grid of all cells is made
    near = F.sequence(F.lit(-2), F.lit(2))
    cells = rows.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).select("*", (F.floor(F.col("x_mm") / 5) + F.col("dx")).alias("x"), (F.floor(F.col("y_mm") / 5) + F.col("dy")).alias("y"))
    px, py = F.col("x") * 5 + F.lit(2.5) - F.col("x_mm"), F.col("y") * 5 + F.lit(2.5) - F.col("y_mm")
    covered = cells.where(F.col("x").between(0, 59) & F.col("y").between(0, 59) & (F.sqrt(px * px + py * py) - F.col("phys_mm") / 2 <= 1)).select("design_id", "x", "y").distinct()
    covered = covered.groupBy("design_id").agg(F.count("*").alias("full"))
    return rows.select("design_id").distinct().join(covered, "design_id", "left").select("design_id", rounded(100.0 * (3600 - F.coalesce("full", F.lit(0))).cast("double") / 3600, 4).alias("empty_pct"))


@query("stones", sql=""", placed AS (SELECT design_id, stone_id, CAST(FLOOR(x_mm / 25) AS BIGINT) AS col, CAST(FLOOR(y_mm / 25) AS BIGINT) AS row FROM stones) SELECT design_id, col, row, COUNT(*) AS owned FROM placed GROUP BY ALL""")
def tile_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Of overlapping tiles, the one whose core holds a stone owns it: the tile of those that hold it whose core does."""
    rows = T.stones(spark, sf).select("design_id", "x_mm", "y_mm", F.explode(S.tiles_of("x_mm", "y_mm", 30.0, 5.0)).alias("t"))
    core = lambda v, i: (F.col(v) >= F.col(f"t.{i}") * 25) & (F.col(v) < F.col(f"t.{i}") * 25 + 25)
    return rows.where(core("x_mm", "col") & core("y_mm", "row")).groupBy("design_id", "t.col", "t.row").agg(F.count("*").alias("owned"))
