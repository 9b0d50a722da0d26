"""Queries on places filled with small beads, and on spots that lie within larger ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapidary.functions import beads as B
from lapidary.functions.color import d
from lapidary.functions.numeric import half_up, rounded
from lapidary.operators import fill, filled
from lapidary.operators import ordered as O
from lapidary.operators import spatial as S
from lapidary.plans.registry import Registry
from lapidary.sources import tables as T

query = Registry()
KEY = ["design_id"]
#: Beads of the given designs lie far apart, and their colours are spread evenly.
SPARSE = fill.Fill(reach=8.0, near=3, cover=0.04, de=90.0, link=7.0, beads=4, inner=0.2)
CELL_MM = 5.0


def _smallest() -> Column:
    return F.lit(T.SIZES[0])


def _beads(spark: SparkSession, sf: str) -> DataFrame:
    return T.beads(spark, sf).select("design_id", "stone_id", "x_mm", "y_mm", "d_mm", "shape", "lab_l", "lab_a", "lab_b", "edge", "solidity").withColumn("material", F.expr(B.material()))


_R = SPARSE
_APART = f"SQRT({d(_R.l_weight**2)} * (a.lab_l - b.lab_l) * (a.lab_l - b.lab_l) + (a.lab_a - b.lab_a) * (a.lab_a - b.lab_a) + (a.lab_b - b.lab_b) * (a.lab_b - b.lab_b)) <= {d(_R.de)}"
_DIST = "SQRT((a.x_mm - b.x_mm) * (a.x_mm - b.x_mm) + (a.y_mm - b.y_mm) * (a.y_mm - b.y_mm))"
_FAR = _R.reach * _R.largest + 1
_ROOT = "SQRT((xx - yy) * (xx - yy) / 4 + xy * xy)"
_AROUND = f""", judged AS MATERIALIZED (SELECT *, {B.material()} AS material FROM beads),
small AS MATERIALIZED (SELECT *, {d(_R.reach)} * GREATEST(d_mm, {d(_R.least_size)}) AS r, CASE WHEN solidity < {d(_R.whole)} THEN 1 ELSE 0 END AS bad, CASE WHEN d_mm < {d(0.9)} * {d(T.SIZES[0])} THEN 1 ELSE 0 END AS low FROM judged WHERE shape = 'round' AND d_mm <= {d(_R.largest)}),
around AS (SELECT a.design_id, a.stone_id, COUNT(*) AS n, SUM((b.x_mm - a.x_mm) * (b.x_mm - a.x_mm)) AS xx, SUM((b.y_mm - a.y_mm) * (b.y_mm - a.y_mm)) AS yy, SUM((b.x_mm - a.x_mm) * (b.y_mm - a.y_mm)) AS xy, SUM(b.d_mm) AS d, SUM(b.d_mm * b.d_mm) AS dd, SUM(b.bad) AS bads, SUM(b.low) AS lows
  FROM small a JOIN small b ON a.design_id = b.design_id AND a.material = b.material AND a.stone_id <> b.stone_id AND abs(a.x_mm - b.x_mm) < {_FAR} AND abs(a.y_mm - b.y_mm) < {_FAR} WHERE {_DIST} <= a.r AND {_APART} GROUP BY ALL),
told AS MATERIALIZED (SELECT design_id, stone_id, x_mm, y_mm, r, n, {half_up(f'CASE WHEN (xx + yy) / 2 + {_ROOT} > 0 THEN ((xx + yy) / 2 - {_ROOT}) / ((xx + yy) / 2 + {_ROOT}) ELSE {d(0.0)} END', 6)} AS two_d,
  {half_up('SQRT(GREATEST((dd + d_mm * d_mm) / (n + 1) - (d + d_mm) / (n + 1) * ((d + d_mm) / (n + 1)), CAST(0 AS DOUBLE))) / ((d + d_mm) / (n + 1))', 6)} AS cv, CAST(bads + bad AS DOUBLE) / (n + 1) AS frag, CAST(lows + low AS DOUBLE) / (n + 1) AS sub
  FROM (SELECT s.design_id, s.stone_id, s.x_mm, s.y_mm, s.r, s.d_mm, s.bad, s.low, COALESCE(n, 0) AS n, COALESCE(xx, 0) AS xx, COALESCE(yy, 0) AS yy, COALESCE(xy, 0) AS xy, COALESCE(d, 0) AS d, COALESCE(dd, 0) AS dd, COALESCE(bads, 0) AS bads, COALESCE(lows, 0) AS lows FROM small s LEFT JOIN around USING (design_id, stone_id))),
spots AS MATERIALIZED (SELECT DISTINCT design_id, py, px FROM (SELECT design_id, py, unnest(range(CAST(CEIL(cx - w) AS BIGINT), CAST(FLOOR(cx + w) AS BIGINT) + 1)) AS px
  FROM (SELECT *, SQRT(GREATEST(r * r - (py - cy) * (py - cy), CAST(0 AS DOUBLE))) AS w FROM (SELECT design_id, x_mm / {d(_R.cell)} AS cx, y_mm / {d(_R.cell)} AS cy, d_mm / 2 / {d(_R.cell)} AS r, unnest(range(CAST(CEIL(cy - r) AS BIGINT), CAST(FLOOR(cy + r) AS BIGINT) + 1)) AS py FROM beads)))),
boxes AS MATERIALIZED (SELECT design_id, stone_id, CAST(FLOOR(cx - a + CAST(0.5 AS DOUBLE)) AS BIGINT) AS x0, CAST(FLOOR(cx + a + CAST(0.5 AS DOUBLE)) AS BIGINT) AS x1, CAST(FLOOR(cy - a + CAST(0.5 AS DOUBLE)) AS BIGINT) AS y0, CAST(FLOOR(cy + a + CAST(0.5 AS DOUBLE)) AS BIGINT) AS y1
  FROM (SELECT design_id, stone_id, x_mm / {d(_R.cell)} AS cx, y_mm / {d(_R.cell)} AS cy, r / {d(_R.cell)} * SQRT(CAST(3.141592653589793 AS DOUBLE)) / 2 AS a FROM told WHERE n >= {_R.near} AND two_d >= {d(_R.spread)})),
covered AS (SELECT l.design_id, l.stone_id, COUNT(s.px) AS held FROM (SELECT *, unnest(range(y0, y1)) AS py FROM boxes) l JOIN spots s ON s.design_id = l.design_id AND s.py = l.py AND s.px >= l.x0 AND s.px < l.x1 GROUP BY ALL),
shares AS (SELECT b.design_id, b.stone_id, {half_up('CAST(COALESCE(held, 0) AS DOUBLE) / ((x1 - x0) * (y1 - y0))', 6)} AS cover FROM boxes b LEFT JOIN covered USING (design_id, stone_id)),
surrounded AS MATERIALIZED (SELECT design_id, stone_id, n, two_d, cv, frag, sub, cover, COALESCE(cover >= {d(_R.cover)}, FALSE) AS dense FROM told LEFT JOIN shares USING (design_id, stone_id))
"""


@query("stones", "beads", sql=_AROUND + f"SELECT design_id, stone_id, n, two_d, cv, {half_up('frag', 6)} AS frag, {half_up('sub', 6)} AS sub, cover, dense FROM surrounded")
def fill_signs(spark: SparkSession, sf: str) -> DataFrame:
    """What lies around each small round bead: neighbours of its kind, their spread, the area under beads."""
    rows = filled.surroundings(_beads(spark, sf), KEY, _smallest(), SPARSE)
    return rows.select("design_id", "stone_id", "n", "two_d", "cv", rounded(F.col("frag"), 6).alias("frag"), rounded(F.col("sub"), 6).alias("sub"), "cover", "dense")


_MED = lambda c: f"list({c} ORDER BY {c})[COUNT({c}) // 2 + 1]"
_REGIONS = _AROUND.rstrip() + f""", lots AS MATERIALIZED (SELECT j.* FROM judged j SEMI JOIN (SELECT * FROM surrounded WHERE dense) USING (design_id, stone_id)),
links AS MATERIALIZED (SELECT a.design_id, a.stone_id AS a, b.stone_id AS b, {_DIST} AS distance, {_APART} AS alike FROM lots a JOIN lots b ON a.design_id = b.design_id AND a.material = b.material AND a.stone_id <> b.stone_id WHERE {_DIST} <= {d(_R.link)} * (a.d_mm + b.d_mm) / 2),
walk AS (SELECT design_id, stone_id AS node, stone_id AS label FROM lots UNION SELECT w.design_id, l.b, w.label FROM walk w JOIN links l ON l.design_id = w.design_id AND l.a = w.node WHERE l.alike),
named AS MATERIALIZED (SELECT design_id, node AS stone_id, MIN(label) AS region FROM walk GROUP BY ALL),
steps AS (SELECT l.design_id, l.a AS stone_id, COUNT(*) AS links, MIN(distance) AS nearest FROM links l JOIN named p ON p.design_id = l.design_id AND p.stone_id = l.a JOIN named q ON q.design_id = l.design_id AND q.stone_id = l.b WHERE p.region = q.region GROUP BY ALL),
held AS (SELECT *, CASE WHEN nearest <= {d(1.6)} * d_mm THEN nearest END AS step FROM lots JOIN named USING (design_id, stone_id) LEFT JOIN steps USING (design_id, stone_id)),
rated AS MATERIALIZED (SELECT design_id, region, ANY_VALUE(material) AS material, COUNT(*) AS beads, {_MED('d_mm')} AS drawn_mm, {', '.join(f"{_MED(f'lab_{c}')} AS lab_{c}" for c in 'lab')}, AVG(CASE WHEN COALESCE(links, 0) >= 3 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS "inner",
  {half_up('SQRT(GREATEST(AVG(d_mm * d_mm) - AVG(d_mm) * AVG(d_mm), CAST(0 AS DOUBLE))) / AVG(d_mm)', 6)} AS cv, AVG(CASE WHEN solidity < {d(_R.whole)} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS frag, AVG(CASE WHEN d_mm < {d(0.9)} * {d(T.SIZES[0])} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS sub,
  CASE WHEN COUNT(step) >= 5 THEN list(step ORDER BY step) FILTER (WHERE step IS NOT NULL)[COUNT(step) // 2 + 1] ELSE {_MED('d_mm')} END AS pitch_mm FROM held GROUP BY ALL),
verdicts AS MATERIALIZED (SELECT *, CASE WHEN beads < {_R.beads} THEN 'few' WHEN "inner" < {d(_R.inner)} THEN 'thin' WHEN "inner" < {d(_R.solid)} AND cv < {d(_R.cv)} AND frag < {d(_R.broken)} AND sub < {d(_R.under)} THEN 'tidy' ELSE 'fill' END AS verdict FROM rated),
codes AS (SELECT material, list(phys_mm ORDER BY phys_mm) AS sizes FROM (SELECT DISTINCT CASE WHEN kind = 'pearl' THEN 'pearl' WHEN code_id % 9 = 0 THEN 'gold' WHEN code_id % 4 = 0 THEN 'white' ELSE 'color' END AS material, phys_mm FROM catalog WHERE shape = 'round') GROUP BY material),
fitted AS (SELECT v.*, c.sizes, w.sizes AS white, [x FOR x IN c.sizes IF x + {d(_R.gap)} <= pitch_mm * {d(_R.pitch_slack)}] AS fit, [x FOR x IN w.sizes IF x + {d(_R.gap)} <= pitch_mm * {d(_R.pitch_slack)}] AS fit_white FROM verdicts v LEFT JOIN codes c USING (material) LEFT JOIN (SELECT sizes FROM codes WHERE material = 'white') w ON TRUE)
SELECT design_id, region, material, CASE WHEN swap THEN 'white' ELSE material END AS "with", beads, drawn_mm, lab_l, lab_a, lab_b, {half_up('"inner"', 6)} AS "inner", cv, {half_up('frag', 6)} AS frag, {half_up('sub', 6)} AS sub, verdict, {half_up('pitch_mm', 6)} AS pitch_mm,
  CASE WHEN swap THEN COALESCE(list_max(fit_white), white[1]) ELSE COALESCE(list_max(fit), sizes[1]) END AS phys_mm FROM (SELECT *, material = 'pearl' AND COALESCE(len(fit), 0) = 0 AND COALESCE(len(white), 0) > 0 AS swap FROM fitted)"""


@query("stones", "beads", "catalog", sql=_REGIONS)
def fill_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of dense beads: what speaks for filling them, and the size of stone that does."""
    code = F.col("code_id")
    material = F.when(F.col("kind") == "pearl", "pearl").when(code % 9 == 0, "gold").when(code % 4 == 0, "white").otherwise("color")
    sizes = T.catalog(spark, sf).where("shape = 'round'").select(material.alias("material"), "phys_mm").distinct().groupBy("material").agg(F.array_sort(F.collect_list("phys_mm")).alias("sizes"))
    rows = fill.filling(filled.regions(_beads(spark, sf), KEY, _smallest(), SPARSE), sizes, SPARSE)
    return rows.select("design_id", "region", "material", "with", "beads", "drawn_mm", "lab_l", "lab_a", "lab_b", *(rounded(F.col(c), 6).alias(c) for c in ("inner", "cv", "frag", "sub")), "verdict", rounded(F.col("pitch_mm"), 6).alias("pitch_mm"), "phys_mm")


query.oracles["fill_regions"] = query.oracles["fill_regions"].replace("WITH ", "WITH RECURSIVE ", 1)


def _grown(beads: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    """Designs too large for a task: their cells as a table, their regions by turns."""
    at = {"px": F.floor(F.col("x_mm") / CELL_MM), "py": F.floor(F.col("y_mm") / CELL_MM)}
    detail = (F.col("shape") != "round") | (F.col("d_mm") > SPARSE.largest)
    cells = beads.withColumns(at).groupBy("design_id", "px", "py").agg(*(F.avg(f"lab_{c}").alias(f"lab_{c}") for c in "lab"), F.max(F.when(detail, "detail")).alias("big"), F.count_distinct("material").alias("kinds"), F.first("material").alias("one"))
    # a cell of several materials belongs to none of them
    cells = cells.withColumn("held", F.when(F.col("big").isNotNull() | (F.col("kinds") > 1), "detail").otherwise(F.col("one")))
    turns = found.where("verdict = 'fill'").withColumn("turn", F.row_number().over(Window.partitionBy("design_id").orderBy(F.desc("beads"), "region")))
    seeds = members.join(turns.select("design_id", "region", "turn", "material"), ["design_id", "region"]).join(beads.select("design_id", "stone_id", "x_mm", "y_mm"), ["design_id", "stone_id"]).withColumns(at)
    grown = fill.grow(cells, seeds, KEY, SPARSE.de, SPARSE.l_weight)[1]
    return grown.join(turns.select("design_id", "turn", "region"), ["design_id", "turn"])


@query()
def grown_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Filled regions grown over a design's 5 mm cells, the one of most beads first; large beads stand in the way."""
    grown = filled.grown(_beads(spark, sf), KEY, _smallest(), CELL_MM, _grown, SPARSE)
    return grown.select("design_id", "region", "turn", "material", *(rounded(F.col(f"lab_{c}"), 6).alias(f"lab_{c}") for c in "lab"), "cells", "merged")


@query()
def whole_beads(spark: SparkSession, sf: str) -> DataFrame:
    """Beads left after clusters, parts of larger beads and second masks of the same bead are taken away, with what became of each."""
    rows = T.beads(spark, sf).where(F.expr(B.bead_like())).select("design_id", "stone_id", "x_mm", "y_mm", "d_mm", "score")
    return O.absorb(rows, KEY)
