"""Queries on a design as a picture: its axis of symmetry, spots within larger spots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.functions.color import d
from lapidary.functions.numeric import half_up, rounded
from lapidary.operators import spatial as S
from lapidary.operators import symmetry
from lapidary.plans.registry import Registry
from lapidary.sources import tables as T

query = Registry()
KEY = ["design_id"]
CELLS, CELL_MM, FIRST, LAST, SLACK = 60, 5.0, 30, 88, 0.01
_CURVE = f""", cells AS MATERIALIZED (SELECT design_id, CAST(FLOOR(x_mm / {d(CELL_MM)}) AS INTEGER) AS px, CAST(FLOOR(y_mm / {d(CELL_MM)}) AS INTEGER) AS py, AVG(lab_l) AS l, AVG(lab_a) AS a, AVG(lab_b) AS b FROM beads GROUP BY ALL),
met AS (SELECT p.design_id, p.px + q.px AS axis, COUNT(*) AS "both", SUM(LEAST(SQRT((p.l - q.l) * (p.l - q.l) + (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)), {d(symmetry.MOST_DE)})) / COUNT(*) AS cost FROM cells p JOIN cells q ON p.design_id = q.design_id AND p.py = q.py
  WHERE p.px + q.px BETWEEN {FIRST} AND {LAST} GROUP BY ALL),
sums AS (SELECT range AS axis FROM range({FIRST}, {LAST + 1})),
united AS (SELECT c.design_id, s.axis, COUNT(*) + COUNT(*) FILTER (WHERE s.axis - px BETWEEN 0 AND {CELLS - 1}) AS two, COUNT(*) AS area FROM cells c CROSS JOIN sums s GROUP BY ALL),
curve AS MATERIALIZED (SELECT design_id, axis, "both", two - "both" AS "any", CAST("both" AS DOUBLE) / (two - "both") AS iou, CAST("both" AS DOUBLE) / area AS overlap, cost FROM met JOIN united USING (design_id, axis))
"""


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / CELL_MM).cast("int")
    cells = T.beads(spark, sf).groupBy("design_id", at("x_mm").alias("px"), at("y_mm").alias("py")).agg(*(F.avg(f"lab_{c}").alias(f"lab_{c}") for c in "lab"))
    return symmetry.axis_curve(S.stored(cells, "cells"), KEY, CELLS, FIRST, LAST)


@query("stones", "beads", sql=_CURVE + f"""SELECT design_id, CAST(axis AS INTEGER) AS axis, "both", "any", {half_up('iou', 6)} AS iou, {half_up('cost', 6)} AS cost FROM curve""")
def symmetry_curve(spark: SparkSession, sf: str) -> DataFrame:
    """For every upright axis of a design's 5 mm cells how much meets and how far it differs."""
    return _curve(spark, sf).select("design_id", "axis", "both", "any", rounded(F.col("iou"), 6).alias("iou"), rounded(F.col("cost"), 6).alias("cost"))


@query("stones", "beads", sql=_CURVE.rstrip() + f""", judged AS (SELECT *, CASE WHEN iou >= MAX(iou) FILTER (WHERE overlap >= {d(0.1)}) OVER (PARTITION BY design_id) - {d(SLACK)} THEN cost END AS k FROM curve),
shifted AS (SELECT *, LAG(k) OVER o AS before, LEAD(k) OVER o AS behind, ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY overlap >= {d(0.1)} AND k IS NOT NULL DESC, k, axis) AS place FROM judged WINDOW o AS (PARTITION BY design_id ORDER BY axis))
SELECT design_id, CAST(axis AS INTEGER) AS axis, {half_up(f'(axis + CASE WHEN before - 2 * k + behind > 0 THEN GREATEST({d(-0.5)}, LEAST({d(0.5)}, {d(0.5)} * (before - behind) / (before - 2 * k + behind))) ELSE 0 END + 1) / 2 * {d(CELL_MM)}', 4)} AS axis_mm, {half_up('iou', 6)} AS iou, {half_up('cost', 6)} AS cost FROM shifted WHERE place = 1 AND k IS NOT NULL""")
def symmetry_axis(spark: SparkSession, sf: str) -> DataFrame:
    """The axis about which each design is most like its mirror image; sparse designs, so a tenth of the cells has to meet."""
    rows = symmetry.best_axis(_curve(spark, sf), KEY, CELL_MM, least_overlap=0.1, slack=SLACK)
    return rows.select("design_id", "axis", rounded(F.col("axis_mm"), 4).alias("axis_mm"), rounded(F.col("iou"), 6).alias("iou"), rounded(F.col("cost"), 6).alias("cost"))


_IN = "SQRT((t.x_mm - c.x_mm) * (t.x_mm - c.x_mm) + (t.y_mm - c.y_mm) * (t.y_mm - c.y_mm))"


@query("stones", "beads", sql=f""" SELECT t.design_id, t.stone_id, {half_up('GREATEST(t.score, COALESCE(MAX(c.score), t.score))', 6)} AS priority, COUNT(c.stone_id) AS highlights FROM beads t LEFT JOIN beads c ON c.design_id = t.design_id AND c.stone_id <> t.stone_id AND abs(c.x_mm - t.x_mm) < 6 AND abs(c.y_mm - t.y_mm) < 6
  AND t.d_mm >= {d(1.6)} * c.d_mm AND {_IN} < {d(0.85)} * t.d_mm / 2 AND t.score >= {d(0.5)} * c.score GROUP BY t.design_id, t.stone_id, t.score""")
def highlight_priority(spark: SparkSession, sf: str) -> DataFrame:
    """What a spot is worth: a small bright spot within one 1.6 times as large is its highlight, and lends it its score."""
    rows = S.stored(T.beads(spark, sf).select("design_id", "stone_id", "x_mm", "y_mm", "d_mm", "score"), "spots")
    near = S.close_pairs(rows.withColumn("_body", F.col("d_mm") * 0.85), 1e-9, KEY, size="_body")
    # of a pair only the larger one can be the spot, so one pass over the pairs is enough
    turned = F.col("b_d_mm") > F.col("a_d_mm")
    end = lambda p, q, c: F.when(turned, F.col(f"{q}_{c}")).otherwise(F.col(f"{p}_{c}")).alias(f"{p}_{c}")
    pairs = near.select("design_id", "distance", *(end(p, q, c) for p, q in ("ab", "ba") for c in ("stone_id", "d_mm", "score")))
    lent = pairs.where((F.col("a_d_mm") >= F.lit(1.6) * F.col("b_d_mm")) & (F.col("distance") < F.lit(0.85) * F.col("a_d_mm") / 2) & (F.col("a_score") >= F.lit(0.5) * F.col("b_score")))
    most = lent.groupBy("design_id", F.col("a_stone_id").alias("stone_id")).agg(F.max("b_score").alias("_lent"), F.count("*").alias("n"))
    return rows.join(most, ["design_id", "stone_id"], "left").select("design_id", "stone_id", rounded(F.greatest("score", F.coalesce("_lent", "score")), 6).alias("priority"), F.coalesce("n", F.lit(0)).alias("highlights"))
