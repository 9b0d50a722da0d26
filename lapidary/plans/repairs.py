"""Queries of passes in order: collisions repaired, chains of beads, labels that follow their neighbours, errors passed on, stray colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapidary.functions import beads as B
from lapidary.functions import color
from lapidary.functions.color import d
from lapidary.functions.numeric import half_up, rounded
from lapidary.operators import ordered as O
from lapidary.operators import passes as P
from lapidary.operators import spatial as S
from lapidary.plans.registry import Registry
from lapidary.sources import tables as T

query = Registry()
KEY = ["design_id"]
_D = "SQRT((a.x_mm - b.x_mm) * (a.x_mm - b.x_mm) + (a.y_mm - b.y_mm) * (a.y_mm - b.y_mm))"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return T.beads(spark, sf).select("design_id", "stone_id", "x_mm", "y_mm", "phys_mm", "score")


@query()
def collision_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Stones 0.15 mm apart, larger and surer ones first: kept, nudged by up to 0.2 mm, one size smaller, or dropped."""
    rows = P.repair(_scored(spark, sf), KEY, list(T.SIZES))
    return rows.select("design_id", "stone_id", "fate", rounded(F.col("x_mm"), 6).alias("x_mm"), rounded(F.col("y_mm"), 6).alias("y_mm"), "phys_mm")


@query()
def collision_rescue(spark: SparkSession, sf: str) -> DataFrame:
    """As ``collision_repair``, but large stones start smaller where this frees more large ones than it costs."""
    kinds = _judged(spark, sf).select("design_id", "stone_id", "x_mm", "y_mm", "phys_mm", "score", F.col("material").alias("kind"))
    rows = P.rescue(kinds, KEY, list(T.SIZES))
    return rows.select("design_id", "stone_id", "fate", rounded(F.col("x_mm"), 6).alias("x_mm"), rounded(F.col("y_mm"), 6).alias("y_mm"), "phys_mm", "forced")


@query()
def overlap_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Stones that keep clear of those before, small ones at the smallest size until all have a place."""
    return P.resolve_overlap(_scored(spark, sf), KEY)


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Beads with material and confidence."""
    return T.beads(spark, sf).withColumn("material", F.expr(B.material())).withColumn("conf", F.expr(B.confidence()))


_BEADS = f""", judged AS MATERIALIZED (SELECT *, {B.confidence()} AS conf FROM (SELECT *, {B.material()} AS material FROM beads))"""
_EDGES = f"""{_BEADS}, round AS (SELECT * FROM judged WHERE shape = 'round' AND d_mm >= {d(O.LEAST_SIZE)}),
near AS MATERIALIZED (SELECT a.design_id, a.stone_id AS a, b.stone_id AS b, b.x_mm - a.x_mm AS dx, b.y_mm - a.y_mm AS dy, {_D} AS d, (a.d_mm + b.d_mm) / 2 AS mean, GREATEST(a.d_mm, b.d_mm) / LEAST(a.d_mm, b.d_mm) AS ratio
  FROM round a JOIN round b ON a.design_id = b.design_id AND a.stone_id < b.stone_id AND abs(a.x_mm - b.x_mm) < 18 AND abs(a.y_mm - b.y_mm) < 18
  WHERE a.material = b.material OR SQRT((a.lab_l - b.lab_l) * (a.lab_l - b.lab_l) + (a.lab_a - b.lab_a) * (a.lab_a - b.lab_a) + (a.lab_b - b.lab_b) * (a.lab_b - b.lab_b)) <= {d(O.CHAIN_DE)}),
edges AS MATERIALIZED (SELECT *, abs(d - mean) / mean + CASE WHEN ratio > {d(O.SAME_SIZE)} THEN {d(O.TAPER_COST)} ELSE {d(0.0)} END AS even FROM near WHERE ratio <= {d(O.TAPER)} AND d >= {d(O.NEAREST)} * mean AND d <= {d(O.FARTHEST)} * mean),
ways AS MATERIALIZED (SELECT design_id, a AS s, b AS e, dx, dy, d FROM edges UNION ALL SELECT design_id, b, a, -dx, -dy, d FROM edges),
onward AS MATERIALIZED (SELECT w.design_id, w.s, w.e, GREATEST(MAX((w.dx * v.dx + w.dy * v.dy) / w.d / v.d), {d(0.0)}) AS goes FROM ways w JOIN ways v ON v.design_id = w.design_id AND v.s = w.e AND v.e <> w.s AND GREATEST(w.d, v.d) / LEAST(w.d, v.d) <= {d(O.PITCH)} GROUP BY ALL)
SELECT e.design_id, e.a, e.b, {half_up('e.d', 6)} AS d, {half_up(half_up(f'(even + (2 - COALESCE(x.goes, {d(0.0)}) - COALESCE(y.goes, {d(0.0)})) / 2)', 9), 6)} AS q FROM edges e
LEFT JOIN onward x ON x.design_id = e.design_id AND x.s = e.a AND x.e = e.b LEFT JOIN onward y ON y.design_id = e.design_id AND y.s = e.b AND y.e = e.a"""


def _round_beads(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).where("shape = 'round'").select("design_id", "stone_id", "x_mm", "y_mm", "d_mm", "material", "lab_l", "lab_a", "lab_b")


@query("stones", "beads", sql=_EDGES)
def chain_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of round beads that a chain may join, and how well."""
    return O.chain_candidates(_round_beads(spark, sf), KEY).select("design_id", "a", "b", rounded(F.col("d"), 6).alias("d"), rounded(F.col("q"), 6).alias("q"))


@query()
def bead_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of three beads or more: how many, the upper medians of their steps and sizes."""
    # one without a size is in no chain; left in, it needs no place in its design to be counted
    beads = _judged(spark, sf).withColumn("d_mm", F.when(F.col("shape") == "round", F.col("d_mm")))
    edges = S.stored(P.chains(beads, KEY), "chains")
    ends = F.array(*(F.struct(F.col(n).alias("stone_id"), F.col(f"{n}_mm").alias("d_mm")) for n in "ab"))
    sizes = edges.select("design_id", "chain", F.explode(ends).alias("e")).distinct().select("design_id", "chain", "e.*")

    def middle(rows: DataFrame, value: str) -> DataFrame:
        own = Window.partitionBy("design_id", "chain")
        ranked = rows.withColumns({"_k": F.row_number().over(own.orderBy(value)), "n": F.count("*").over(own)})
        return ranked.where(F.col("_k") == F.floor(F.col("n") / 2) + 1).select("design_id", "chain", "n", rounded(F.col(value), 6).alias(value))

    return middle(sizes, "d_mm").where("n >= 3").join(middle(edges, "d").drop("n").withColumnRenamed("d", "pitch"), ["design_id", "chain"])


@query("stones", "beads", sql=f"""{_BEADS}, near AS (SELECT a.design_id, a.stone_id AS item, b.stone_id AS other, {_D} AS d FROM beads a JOIN beads b ON a.design_id = b.design_id AND a.stone_id <> b.stone_id AND abs(a.x_mm - b.x_mm) < 17 AND abs(a.y_mm - b.y_mm) < 17
  WHERE GREATEST(a.d_mm, b.d_mm) / LEAST(a.d_mm, b.d_mm) <= {d(1.4)} AND {_D} <= {d(1.35)} * (a.d_mm + b.d_mm) / 2 + {d(0.5)}),
usual AS (SELECT design_id, item, list(d ORDER BY d)[COUNT(*) // 2 + 1] AS usual FROM near GROUP BY ALL)
SELECT design_id, item, other, {half_up(half_up(f'(1 / (1 + abs(d - usual) / GREATEST({d(0.3)}, {d(0.15)} * usual)))', 9), 6)} AS weight FROM near JOIN usual USING (design_id, item)""")
def label_votes(spark: SparkSession, sf: str) -> DataFrame:
    """What each neighbour's label counts for a bead."""
    return O.label_votes(T.beads(spark, sf), KEY).withColumn("weight", rounded(F.col("weight"), 6))


@query()
def label_propagation(spark: SparkSession, sf: str) -> DataFrame:
    """Materials of unsure round beads that follow their neighbours', three passes in place: those that changed."""
    rows = _judged(spark, sf).select("design_id", "stone_id", "x_mm", "y_mm", "d_mm", F.col("material").alias("label"), "conf", (F.col("shape") != "round").alias("fixed"))
    found = P.propagate(rows, KEY)
    return found.where("label <> was").select("design_id", F.col("item").alias("stone_id"), "was", F.col("label").alias("material"))


def _coded(spark: SparkSession, sf: str) -> DataFrame:
    """Beads, and in the first row of each design its twelve commonest codes."""
    rows = T.beads(spark, sf).select("design_id", "stone_id", "x_mm", "y_mm", "phys_mm", "code_id", "shape", "lab_l", "lab_a", "lab_b")
    labs = color.add(T.catalog(spark, sf), color.lab_steps("r", "g", "b", "c"), ["c_l", "c_a", "c_b"]).select("code_id", "c_l", "c_a", "c_b")
    counts = rows.groupBy("design_id", "code_id").agg(F.count("*").alias("n"))
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("design_id").orderBy(F.desc("n"), "code_id"))).where("k <= 12").join(labs, "code_id")
    palettes = top.groupBy("design_id").agg(F.array_sort(F.collect_list(F.struct("code_id", "c_l", "c_a", "c_b"))).alias("p"))
    kept = [F.when(F.col("stone_id") == 1, F.col(f"p.{c}")).alias(name) for c, name in zip(("code_id", "c_l", "c_a", "c_b"), P.PALETTE)]
    # all rows of a design or none
    return rows.drop("code_id").join(palettes.hint("merge"), "design_id").select(*(c for c in rows.columns if c != "code_id"), *kept)


def _read(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of designs too large for a task: beads with ``item``, their place in reading order; links up to 1 mm apart; palettes."""
    rows = S.stored(rows, "beads")
    codes = F.explode(F.arrays_zip(*P.PALETTE)).alias("c")
    top = rows.where("codes is not null").select("design_id", codes).select("design_id", F.col("c.codes").alias("code"), *(F.col(f"c.code_{c}").alias(c) for c in "lab"))
    # the place in reading order: by design, a window no larger than what one design holds
    read = S.stored(rows.drop(*P.PALETTE).withColumn("item", F.row_number().over(Window.partitionBy("design_id").orderBy("y_mm", "x_mm", "stone_id")).cast("long")), "read")
    near = S.close_pairs(read.select("design_id", "item", "x_mm", "y_mm", "phys_mm"), 1.0, KEY, order="item").select("design_id", F.col("a_item").alias("a"), F.col("b_item").alias("b"))
    return read, near, top


def _diffused(rows: DataFrame) -> DataFrame:
    read, near, top = _read(rows)
    palettes = top.groupBy("design_id").agg(F.array_sort(F.collect_list(F.struct("code", "l", "a", "b"))).alias("palette"))
    found = O.diffuse(read.select("design_id", "item", "lab_l", "lab_a", "lab_b").join(palettes, "design_id"), near, KEY)
    return found.join(read.select("design_id", "item", "stone_id"), ["design_id", "item"]).select("design_id", "stone_id", "code")


@query()
def diffused_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of a design's beads out of its twelve commonest, with errors passed on to neighbours up to 1 mm apart, in reading order."""
    return P.diffuse(_coded(spark, sf).drop("shape"), KEY, _diffused).select("design_id", "stone_id", F.col("code").alias("code_id"))


#: How near to the edge of a shaped stone, the accent of a design, beads keep their codes, in mm.
PROTECTED = 1.5


def _despeckled(rows: DataFrame) -> DataFrame:
    read, near, top = _read(rows)
    met = read.where("shape = 'round'").join(top.select("design_id", "code", *(F.col(c).alias(f"q_{c}") for c in "lab")), "design_id").withColumns({f"p_{c}": F.col(f"lab_{c}") for c in "lab"})
    nearest = color.add(met, color.de2000_steps("p", "q"), ["de"]).groupBy("design_id", "item", "stone_id", "lab_l", "lab_a", "lab_b").agg(F.min(F.struct(F.round("de", 9).alias("de"), "code")).alias("m"))
    shaped = S.close_pairs(read.select("design_id", "item", "x_mm", "y_mm", "phys_mm", "shape"), PROTECTED, KEY, order="item").where("(a_shape = 'round') <> (b_shape = 'round')")
    guarded = shaped.select("design_id", F.when(F.col("a_shape") == "round", F.col("a_item")).otherwise(F.col("b_item")).alias("item")).distinct().withColumn("fixed", F.lit(True))
    items = S.stored(nearest.join(guarded, ["design_id", "item"], "left").select("design_id", "item", "stone_id", F.col("m.code").alias("code"), F.coalesce("fixed", F.lit(False)).alias("fixed"), "lab_l", "lab_a", "lab_b"), "items")
    codes = top.groupBy("code").agg(*(F.min(c).alias(f"lab_{c}") for c in "lab"))
    found = O.despeckle(items, near, codes, KEY)
    return found.join(items.select("design_id", "item", "stone_id"), ["design_id", "item"]).select("design_id", "stone_id", "code", "was")


@query()
def despeckled_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Round beads in the nearest of their design's twelve commonest codes, and what single ones among others change to.

    Shaped stones take no part, and beads near them keep their code.
    """
    found = P.despeckle(_coded(spark, sf), KEY, _despeckled, guard=PROTECTED)
    return found.select("design_id", "stone_id", F.col("was").alias("nearest_code"), F.col("code").alias("code_id"))
