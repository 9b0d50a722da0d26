"""Queries that match layouts: greedy pairs and their scores, mirror pairs, edges of bead graphs, remapping, crops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapidary.functions import beads as B
from lapidary.functions import color
from lapidary.functions.numeric import half_up, rounded
from lapidary.operators import images
from lapidary.operators import matching as M
from lapidary.operators import spatial as S
from lapidary.plans.distances import lab_catalog
from lapidary.plans.registry import Registry
from lapidary.sources import tables as T

query = Registry()
KEY = ["design_id"]
_D = "SQRT((a.x_mm - b.x_mm) * (a.x_mm - b.x_mm) + (a.y_mm - b.y_mm) * (a.y_mm - b.y_mm))"
_SHARE = "CASE WHEN {1} > 0 THEN FLOOR(1000 * CAST({0} AS DOUBLE) / {1} + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE) END"


def _layouts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A predicted layout, moved, thinned and partly relabelled, and the true one."""
    truth = S.stored(T.stones(spark, sf).select("design_id", "stone_id", "x_mm", "y_mm", "phys_mm", "code_id", "size_class"), "stones")
    i = F.col("stone_id")
    shift = {"x_mm": F.col("x_mm") + (i % 5 - 2) * F.lit(0.4), "y_mm": F.col("y_mm") + (i % 7 - 3) * F.lit(0.3)}
    return truth.where(i % 10 != 0).withColumns({**shift, "code_id": F.when(i % 6 == 0, F.col("code_id") + 1).otherwise(F.col("code_id")), "size_class": F.when(i % 4 == 0, 0).otherwise(F.col("size_class"))}), truth


_LAYOUTS = """predicted AS MATERIALIZED (SELECT design_id, stone_id, x_mm + (stone_id % 5 - 2) * CAST(0.4 AS DOUBLE) AS x_mm, y_mm + (stone_id % 7 - 3) * CAST(0.3 AS DOUBLE) AS y_mm, phys_mm, CASE WHEN stone_id % 6 = 0 THEN code_id + 1 ELSE code_id END AS code_id,
  CASE WHEN stone_id % 4 = 0 THEN 0 ELSE size_class END AS size_class FROM stones WHERE stone_id % 10 <> 0)"""


def _greedy_sql(candidates: str) -> str:
    """``taken``: candidates (design_id, a, b, d, ...) taken cheapest first; each step of the recursion strikes ends out."""
    return f"""candidates AS MATERIALIZED ({candidates}),
steps AS (SELECT *, false AS m FROM candidates UNION ALL
  SELECT * EXCLUDE (ka, kb, m, ua, ub, hit), hit AS m FROM (SELECT *, max(hit) OVER (PARTITION BY design_id, a) AS ua, max(hit) OVER (PARTITION BY design_id, b) AS ub FROM (
    SELECT *, ka = 1 AND kb = 1 AS hit FROM (SELECT *, row_number() OVER (PARTITION BY design_id, a ORDER BY d, a, b) AS ka, row_number() OVER (PARTITION BY design_id, b ORDER BY d, a, b) AS kb FROM steps WHERE NOT m))) WHERE hit OR NOT (ua OR ub)),
taken AS (SELECT * FROM steps WHERE m)"""


_MATCH_SQL = _greedy_sql(f"SELECT a.design_id, a.stone_id AS a, b.stone_id AS b, {_D} AS d, a.code_id AS ca, b.code_id AS cb, a.size_class AS sa, b.size_class AS sb, b.phys_mm AS pb, b.x_mm AS xb, b.y_mm AS yb FROM predicted a JOIN stones b ON a.design_id = b.design_id AND abs(a.x_mm - b.x_mm) < 5 AND abs(a.y_mm - b.y_mm) < 5 WHERE {_D} < CAST(0.5 AS DOUBLE) * b.phys_mm")


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _matched(layouts: tuple[DataFrame, DataFrame], *columns: str | Column, reach=lambda size: 0.5 * size, most: float = 5.0) -> DataFrame:
    """Pairs a, b taken, their distance d, and ``columns`` of either side, which go through all rounds."""
    predicted, truth = layouts
    near = S.within(predicted, truth, most, KEY).where(F.col("distance") < reach(F.col("b_phys_mm")))
    return M.greedy(near.select("design_id", F.col("a_stone_id").alias("a"), F.col("b_stone_id").alias("b"), F.col("distance").alias("d"), *columns), KEY, "a", "b", "d")


#: What scores look at in a matched pair.
_JUDGED = {"size_ok": "a_size_class = b_size_class", "code_ok": "a_code_id = b_code_id"}


@query("stones", sql=f", {_LAYOUTS}, {_MATCH_SQL} SELECT design_id, a, b, {half_up('d', 6)} AS distance FROM taken")
def greedy_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted and true stones, nearest pairs first, each once, within half the true size."""
    return _matched(_layouts(spark, sf)).select("design_id", "a", "b", rounded(F.col("d"), 6).alias("distance"))


_SCORED = """SELECT p.design_id, predicted, truth, COALESCE(matched, 0) AS matched, {precision} AS precision, {recall} AS recall, {f1} AS f1, {size} AS size_ok, {code} AS code_ok, {majority} AS majority_ok
FROM (SELECT design_id, COUNT(*) AS predicted FROM predicted {of_p} GROUP BY ALL) p JOIN (SELECT design_id, COUNT(*) AS truth FROM stones {of_t} GROUP BY ALL) USING (design_id) LEFT JOIN (SELECT design_id, COUNT(*) AS matched, COUNT(*) FILTER (WHERE sa = sb) AS ns, COUNT(*) FILTER (WHERE ca = cb) AS nc FROM taken {of_m} GROUP BY ALL) USING (design_id)
LEFT JOIN (SELECT design_id, SUM(n) AS nm FROM (SELECT design_id, ca, MAX(n) AS n FROM (SELECT design_id, ca, cb, COUNT(*) AS n FROM taken {of_m} GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) USING (design_id)"""


def _scored(**zones: str) -> str:
    zones = {k: zones.get(k, "") for k in ("of_p", "of_t", "of_m")}
    of = lambda x, y: _SHARE.format(f"COALESCE({x}, 0)", y)
    return _SCORED.format(precision=of("matched", "predicted"), recall=of("matched", "truth"), f1=of("2 * matched", "(predicted + truth)"), size=_SHARE.format("ns", "matched"), code=_SHARE.format("nc", "matched"), majority=_SHARE.format("nm", "matched"), **zones)


@query("stones", sql=f", {_LAYOUTS}, {_MATCH_SQL} {_scored()}")
def centre_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall, F1, right sizes and codes, and the bound that renaming clusters could reach."""
    predicted, truth = _layouts(spark, sf)
    matched = _matched((predicted, truth), "a_code_id", "b_code_id", F.expr(_JUDGED["size_ok"]).alias("size_ok"))
    found = M.scores(matched, predicted, truth, KEY, {"size_ok": F.col("size_ok"), "code_ok": F.expr(_JUDGED["code_ok"])})
    best = M.majority(matched, KEY, "a_code_id", "b_code_id")
    share = F.when(F.col("matched") > 0, F.floor(1000 * F.col("majority") / F.col("matched") + F.lit(0.5)) / 10.0)
    return found.join(best, KEY, "left").withColumn("majority_ok", share).drop("majority")


_ZONE = "({x} >= 60 AND {x} < 180 AND {y} >= 60 AND {y} < 210)"


@query("stones", sql=f""", {_LAYOUTS}, {_MATCH_SQL}, zoned AS (
  SELECT design_id, {_ZONE.format(x='x_mm', y='y_mm')} AS inside, 1 AS p, 0 AS t, 0 AS m, 0 AS s, 0 AS c FROM predicted UNION ALL SELECT design_id, {_ZONE.format(x='x_mm', y='y_mm')}, 0, 1, 0, 0, 0 FROM stones UNION ALL
  SELECT design_id, {_ZONE.format(x='xb', y='yb')}, 0, 0, 1, CASE WHEN sa = sb THEN 1 ELSE 0 END, CASE WHEN ca = cb THEN 1 ELSE 0 END FROM taken)
SELECT design_id, inside, CAST(SUM(p) AS BIGINT) AS predicted, CAST(SUM(t) AS BIGINT) AS truth, CAST(SUM(m) AS BIGINT) AS matched, {_SHARE.format('SUM(m)', 'SUM(p)')} AS precision, {_SHARE.format('SUM(m)', 'SUM(t)')} AS recall, {_SHARE.format('2 * SUM(m)', '(SUM(p) + SUM(t))')} AS f1,
  {_SHARE.format('SUM(s)', 'SUM(m)')} AS size_ok, {_SHARE.format('SUM(c)', 'SUM(m)')} AS code_ok FROM zoned GROUP BY ALL""")
def zone_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The same inside and outside a region; a match counts where its true stone lies."""
    predicted, truth = _layouts(spark, sf)
    zone = lambda x, y: F.expr(_ZONE.format(x=x, y=y)).alias("inside")
    matched = _matched((predicted, truth), zone("b_x_mm", "b_y_mm"), *(F.expr(x).alias(c) for c, x in _JUDGED.items()))
    each = [df.select("design_id", zone("x_mm", "y_mm")) for df in (predicted, truth)]
    return M.scores(matched, *each, ["design_id", "inside"], {c: F.col(c) for c in _JUDGED})


@query("stones", "catalog", sql=f""", {_LAYOUTS}, {_MATCH_SQL} SELECT design_id, series, COUNT(*) AS n, COUNT(a) AS hit, {_SHARE.format('COUNT(a)', 'COUNT(*)')} AS recall FROM (SELECT s.design_id, c.series, t.a FROM stones s JOIN catalog c USING (code_id) LEFT JOIN taken t ON t.design_id = s.design_id AND t.b = s.stone_id) GROUP BY GROUPING SETS ((design_id, series), (design_id))""")
def series_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many true stones were found, by series and in all (a null series)."""
    layouts = _layouts(spark, sf)
    truth = layouts[1].select("design_id", F.col("stone_id").alias("b"), "code_id").join(T.catalog(spark, sf).select("code_id", "series"), "code_id")
    rows = truth.join(_matched(layouts).select("design_id", "b", "a"), ["design_id", "b"], "left")
    sums = rows.groupingSets([(F.col("design_id"), F.col("series")), (F.col("design_id"),)], "design_id", "series").agg(F.count("*").alias("n"), F.count("a").alias("hit"))
    return sums.withColumn("recall", F.floor(1000 * F.col("hit") / F.col("n") + F.lit(0.5)) / 10.0)


for _name in ("greedy_matches", "centre_scores", "zone_scores", "series_recall"):
    query.oracles[_name] = _recursive(query.oracles[_name])


@query("stones", sql=f""", halves AS (SELECT design_id, stone_id, x_mm, y_mm, size_class FROM stones WHERE abs(x_mm - 150) >= 2), {_greedy_sql(f"SELECT a.design_id, a.stone_id AS a, b.stone_id AS b, {_D} AS d FROM (SELECT * FROM halves WHERE x_mm < 150) a JOIN (SELECT design_id, stone_id, CAST(300 AS DOUBLE) - x_mm AS x_mm, y_mm, size_class FROM halves WHERE x_mm >= 150) b ON a.design_id = b.design_id AND a.size_class = b.size_class AND abs(a.x_mm - b.x_mm) < 5 AND abs(a.y_mm - b.y_mm) < 5 WHERE {_D} < 5")}
SELECT design_id, a, b, {half_up('d', 6)} AS off_mm FROM taken""")
def mirror_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Stones of one size left and right of the middle, nearest mirror images first, each once."""
    rows = T.stones(spark, sf).select("design_id", "stone_id", "x_mm", "y_mm", "size_class")
    near = M.mirror_candidates(rows, 150.0, 5.0, ["design_id", "size_class"], 2.0)
    near = near.select("design_id", F.col("a_stone_id").alias("a"), F.col("b_stone_id").alias("b"), F.col("distance").alias("d"))
    return M.greedy(near, KEY, "a", "b", "d").select("design_id", "a", "b", rounded(F.col("d"), 6).alias("off_mm"))


query.oracles["mirror_pairs"] = _recursive(query.oracles["mirror_pairs"])


@query("stones", "catalog", sql=f""", kinds AS (SELECT s.*, family_name FROM stones s JOIN catalog USING (code_id)) SELECT design_id, x_mm < 150 AS left_half, COUNT(*) AS n, COUNT(*) FILTER (WHERE EXISTS (SELECT 1 FROM kinds b WHERE b.design_id = a.design_id AND b.family_name = a.family_name AND SQRT((b.x_mm - (300 - a.x_mm)) * (b.x_mm - (300 - a.x_mm)) + (b.y_mm - a.y_mm) * (b.y_mm - a.y_mm)) < 4)) AS paired FROM kinds a GROUP BY ALL""")
def mirror_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Stones with one of the same family within 4 mm of their mirror image, by half."""
    rows = T.stones(spark, sf).select("design_id", "stone_id", "x_mm", "y_mm", "code_id").join(T.catalog(spark, sf).select("code_id", "family_name"), "code_id").drop("code_id")
    image = rows.withColumn("x_mm", F.lit(T.CANVAS) - F.col("x_mm"))
    hit = S.within(image, rows, 4.0, ["design_id", "family_name"]).select("design_id", F.col("a_stone_id").alias("stone_id")).distinct().withColumn("hit", F.lit(1))
    return rows.join(hit, ["design_id", "stone_id"], "left").groupBy("design_id", (F.col("x_mm") < 150).alias("left_half")).agg(F.count("*").alias("n"), F.count("hit").alias("paired"))


_TWINNED = {"x_mm": "CAST(300 AS DOUBLE) + 4 * FLOOR(y_mm / 100) - x_mm + CAST(stone_id % 5 - 2 AS DOUBLE) / 10", "y_mm": "y_mm + CAST(stone_id % 7 - 3 AS DOUBLE) / 10"}
_BEAD = ["d_mm", "lab_l", "lab_a", "lab_b"]
_DIFFER = "SQRT((a.lab_l - b.lab_l) * (a.lab_l - b.lab_l) + (a.lab_a - b.lab_a) * (a.lab_a - b.lab_a) + (a.lab_b - b.lab_b) * (a.lab_b - b.lab_b))"
_LARGER, _UNLIKE = "GREATEST(a.d_mm, b.d_mm)", "GREATEST(a.d_mm, b.d_mm) / LEAST(a.d_mm, b.d_mm)"
_IMAGE_SQL = f"""SELECT a.design_id, a.stone_id AS me, b.stone_id AS you, a.axis, SQRT((b.x_mm - (2 * a.axis - a.x_mm)) * (b.x_mm - (2 * a.axis - a.x_mm)) + (b.y_mm - a.y_mm) * (b.y_mm - a.y_mm)) AS off FROM {{0}} a JOIN big b ON a.design_id = b.design_id AND a.stone_id <> b.stone_id
  WHERE {{1}} AND off <= CAST(0.35 AS DOUBLE) * {_LARGER} + CAST(0.8 AS DOUBLE) AND {_UNLIKE} <= CAST(1.8 AS DOUBLE) AND {_DIFFER} <= 30 QUALIFY ROW_NUMBER() OVER (PARTITION BY a.design_id, a.stone_id ORDER BY off, b.stone_id) = 1"""


def _twinned(spark: SparkSession, sf: str) -> DataFrame:
    """The left part of each design and a copy of nine in ten of its stones, mirrored about an axis that moves with the height."""
    left = T.beads(spark, sf).where("x_mm < 145").select("design_id", "stone_id", "x_mm", "y_mm", *_BEAD)
    # a stone and its copy in one pass, since each read of the stones would number them anew
    own = F.struct("stone_id", "x_mm", "y_mm", *_BEAD)
    copy = F.struct((F.col("stone_id") + 1000000).alias("stone_id"), *(F.expr(x).alias(c) for c, x in _TWINNED.items()), *_BEAD)
    return left.select("design_id", F.explode(F.when(F.col("stone_id") % 10 != 0, F.array(own, copy)).otherwise(F.array(own))).alias("_i")).select("design_id", "_i.*")


@query("stones", "beads", sql=f""", own AS MATERIALIZED (SELECT design_id, stone_id, x_mm, y_mm, {', '.join(_BEAD)} FROM beads WHERE x_mm < 145),
items AS MATERIALIZED (SELECT * FROM own UNION ALL SELECT design_id, stone_id + 1000000, {', '.join(_TWINNED.values())}, {', '.join(_BEAD)} FROM own WHERE stone_id % 10 <> 0),
votes AS MATERIALIZED (SELECT a.design_id, (a.y_mm + b.y_mm) / 2 AS y, (a.x_mm + b.x_mm) / 2 AS mid, EXP(-(mid - 150) * (mid - 150) / 72) AS w FROM items a JOIN items b ON a.design_id = b.design_id AND (a.y_mm < b.y_mm OR (a.y_mm = b.y_mm AND a.stone_id < b.stone_id)) AND b.y_mm - a.y_mm <= CAST(1.2 AS DOUBLE)
  WHERE a.d_mm >= 3 AND b.d_mm >= 3 AND abs((a.x_mm + b.x_mm) / 2 - 150) <= 30 AND abs(a.x_mm - b.x_mm) >= a.d_mm AND {_UNLIKE} <= CAST(1.25 AS DOUBLE) AND {_DIFFER} <= 15),
banded AS MATERIALIZED (SELECT *, CAST(FLOOR(mid / CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS bin FROM (SELECT *, unnest(range(CAST(CEIL((y - 15) / 2) AS BIGINT), CAST(FLOOR((y + 15) / 2) AS BIGINT) + 1)) AS k FROM votes)),
heights AS (SELECT design_id, k, bin + s.i AS bin, FLOOR(SUM(w * s.f) * 1000000000 + CAST(0.5 AS DOUBLE)) AS n FROM banded CROSS JOIN (VALUES (-1, CAST(0.5 AS DOUBLE)), (0, CAST(1 AS DOUBLE)), (1, CAST(0.5 AS DOUBLE))) s(i, f) GROUP BY ALL),
peaks AS (SELECT * FROM heights QUALIFY ROW_NUMBER() OVER (PARTITION BY design_id, k ORDER BY n DESC, bin) = 1 AND n >= 2000000000),
found AS MATERIALIZED (SELECT design_id, k, FLOOR(AVG(mid) * 1000000000 + CAST(0.5 AS DOUBLE)) / CAST(1000000000 AS DOUBLE) AS axis FROM banded v JOIN peaks p USING (design_id, k) WHERE abs(mid - p.bin * CAST(0.5 AS DOUBLE)) <= CAST(0.75 AS DOUBLE) GROUP BY ALL),
axes AS MATERIALIZED (SELECT design_id, k + d.i AS k, axis FROM found CROSS JOIN (SELECT unnest(range(-5, 6)) AS i) d QUALIFY ROW_NUMBER() OVER (PARTITION BY design_id, k + d.i ORDER BY abs(d.i), found.k) = 1),
big AS MATERIALIZED (SELECT * FROM items WHERE d_mm >= CAST(4.5 AS DOUBLE)), placed AS MATERIALIZED (SELECT b.*, axis FROM big b JOIN axes x ON x.design_id = b.design_id AND x.k = CAST(FLOOR(y_mm / 2 + CAST(0.5 AS DOUBLE)) AS BIGINT)),
there AS ({_IMAGE_SQL.format('placed', 'a.x_mm < a.axis - CAST(0.5 AS DOUBLE) AND b.x_mm > a.axis')}), back AS ({_IMAGE_SQL.format('placed', 'b.x_mm < a.axis')})
SELECT t.design_id, t.me AS a, t.you AS b, {half_up('t.off', 2)} AS off_mm, {half_up('t.axis', 2)} AS axis FROM there t JOIN back r ON r.design_id = t.design_id AND r.me = t.you AND r.you = t.me""")
def twin_stones(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of stones that are each other's image about an axis found by height, with how far they are off."""
    pairs = images.twins(S.stored(_twinned(spark, sf), "items"), KEY, T.CANVAS / 2, 12.0)
    return pairs.select("design_id", "a", "b", rounded(F.col("off"), 2).alias("off_mm"), rounded(F.col("axis"), 2).alias("axis"))


# Graphs of beads ------------------------------------------------------------------------------------------------------

_DE76 = "SQRT((a_lab_l - b_lab_l) * (a_lab_l - b_lab_l) + (a_lab_a - b_lab_a) * (a_lab_a - b_lab_a) + (a_lab_b - b_lab_b) * (a_lab_b - b_lab_b))"
_RATIO = "(GREATEST(a_d_mm, b_d_mm) / LEAST(a_d_mm, b_d_mm))"
_SAME_SIZE = f"CASE WHEN {_RATIO} <= CAST(1.2 AS DOUBLE) THEN CAST(1 AS DOUBLE) WHEN {_RATIO} >= CAST(1.25 AS DOUBLE) THEN CAST(0 AS DOUBLE) ELSE (CAST(1.25 AS DOUBLE) - {_RATIO}) / CAST(0.05 AS DOUBLE) END"
_PALE = "({0} IN ('pearl', 'white'))"
_SAME_MATERIAL = f"CASE WHEN a_material = b_material THEN CAST(1 AS DOUBLE) WHEN {_PALE.format('a_material')} = {_PALE.format('b_material')} THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END"
_FIELDS = ["d_mm", "lab_l", "lab_a", "lab_b", "material"]
_BEAD_PAIRS = f""", judged AS MATERIALIZED (SELECT *, {B.material()} AS material FROM beads),
near AS (SELECT a.design_id, a.stone_id AS a, b.stone_id AS b, {', '.join(f'a.{c} AS a_{c}, b.{c} AS b_{c}' for c in _FIELDS)}, {_D} AS d FROM judged a JOIN judged b ON a.design_id = b.design_id AND a.stone_id < b.stone_id AND abs(a.x_mm - b.x_mm) < 18 AND abs(a.y_mm - b.y_mm) < 18)
"""


def _bead_pairs(spark: SparkSession, sf: str, reach: float) -> DataFrame:
    rows = T.beads(spark, sf).withColumn("material", F.expr(B.material())).select("design_id", "stone_id", "x_mm", "y_mm", *_FIELDS)
    return S.neighbour_pairs(rows, reach, KEY).withColumns({"a": F.col("a_stone_id"), "b": F.col("b_stone_id"), "d": F.col("distance")})


_MRF = f"({_SAME_SIZE}) * ({_SAME_MATERIAL}) * EXP(-({_DE76}) * ({_DE76}) / CAST(800 AS DOUBLE))"


@query("stones", "beads", sql=_BEAD_PAIRS + f"SELECT design_id, a, b, {half_up(_MRF, 6)} AS weight FROM near WHERE d <= CAST(0.75 AS DOUBLE) * (a_d_mm + b_d_mm) AND {_MRF} > CAST(0.000001 AS DOUBLE)")
def label_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between beads that lie close, weighted by how alike size, material and colour are."""
    rows = _bead_pairs(spark, sf, 17.5).where(F.col("d") <= F.lit(0.75) * (F.col("a_d_mm") + F.col("b_d_mm"))).withColumn("w", F.expr(_MRF)).where(F.col("w") > 0.000001)
    return rows.select("design_id", "a", "b", rounded(F.col("w"), 6).alias("weight"))


_CHAIN = f"d >= CAST(0.3 AS DOUBLE) * (a_d_mm + b_d_mm) AND d <= CAST(0.75 AS DOUBLE) * (a_d_mm + b_d_mm) AND {_RATIO} <= CAST(1.3 AS DOUBLE) AND (a_material = b_material OR {_DE76} <= 20)"
_UNEVEN = f"ABS(d - (a_d_mm + b_d_mm) / 2) / ((a_d_mm + b_d_mm) / 2) + CASE WHEN {_RATIO} > CAST(1.15 AS DOUBLE) THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


@query("stones", "beads", sql=_BEAD_PAIRS + f"SELECT design_id, a, b, {half_up(_UNEVEN, 6)} AS uneven FROM near WHERE {_CHAIN}")
def chain_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that may stand next to each other in a chain, by how uneven their step is."""
    return _bead_pairs(spark, sf, 17.5).where(F.expr(_CHAIN)).select("design_id", "a", "b", rounded(F.expr(_UNEVEN), 6).alias("uneven"))


_ALIKE = f"EXP(-({_DE76}) * ({_DE76}) / CAST(128 AS DOUBLE))"


@query("stones", "beads", sql=_BEAD_PAIRS + f""", alike AS (SELECT * FROM near WHERE d <= CAST(0.6 AS DOUBLE) * (a_d_mm + b_d_mm) + CAST(0.6 AS DOUBLE) AND {_ALIKE} > CAST(0.5 AS DOUBLE))
SELECT design_id, stone_id, {half_up('MIN(d)', 6)} AS nearest, COUNT(*) AS n FROM (SELECT design_id, a AS stone_id, d FROM alike UNION ALL SELECT design_id, b, d FROM alike) GROUP BY ALL""")
def crowding(spark: SparkSession, sf: str) -> DataFrame:
    """How near the next bead of like colour is: a larger size would run into it."""
    rows = _bead_pairs(spark, sf, 17.5).where(F.col("d") <= F.lit(0.6) * (F.col("a_d_mm") + F.col("b_d_mm")) + F.lit(0.6)).where(F.expr(_ALIKE) > 0.5)
    return S.both_ends(rows, KEY, ["d"]).groupBy("design_id", "stone_id").agg(rounded(F.min("d"), 6).alias("nearest"), F.count("*").alias("n"))


@query("stones", sql=f"""SELECT design_id, layer, COUNT(*) AS n, COUNT(*) FILTER (WHERE hit) AS over_background FROM (SELECT a.design_id, a.layer, EXISTS (SELECT 1 FROM stones b WHERE b.design_id = a.design_id AND b.layer_rank = 0 AND abs(a.x_mm - b.x_mm) < 10 AND abs(a.y_mm - b.y_mm) < 10 AND {_D} < (a.phys_mm + b.phys_mm) / 2) AS hit FROM stones a WHERE a.layer_rank > 0) GROUP BY ALL""")
def over_background(spark: SparkSession, sf: str) -> DataFrame:
    """Stones of the upper layers that overlap one of the background."""
    rows = T.stones(spark, sf).select("design_id", "stone_id", "x_mm", "y_mm", "phys_mm", "layer", "layer_rank")
    upper = rows.where("layer_rank > 0")
    met = S.close_pairs(rows.drop("layer"), 0.0, KEY)
    # both ends in one pass, since each read of the pairs would join them anew
    met = met.where((F.col("a_layer_rank") == 0) != (F.col("b_layer_rank") == 0))
    hit = met.select("design_id", F.when(F.col("a_layer_rank") > 0, F.col("a_stone_id")).otherwise(F.col("b_stone_id")).alias("stone_id")).distinct().withColumn("hit", F.lit(1))
    return upper.join(hit, ["design_id", "stone_id"], "left").groupBy("design_id", "layer").agg(F.count("*").alias("n"), F.count("hit").alias("over_background"))


_CROP = "(x_mm >= 30 + 60 * {i} AND x_mm < 90 + 60 * {i} AND y_mm >= 40 AND y_mm < 200)"


@query("stones", "beads", sql=f""", judged AS (SELECT design_id, stone_id, x_mm, y_mm, score, {B.material()} AS material FROM beads WHERE phys_mm < 5), crops AS (SELECT i AS crop FROM range(4) r(i)),
inside AS (SELECT design_id, crop, material, stone_id, ROW_NUMBER() OVER (PARTITION BY design_id, crop, material ORDER BY score, stone_id) AS k, COUNT(*) OVER (PARTITION BY design_id, crop, material) AS n FROM judged JOIN crops ON {_CROP.format(i='crop')})
SELECT design_id, CAST(crop AS INTEGER) AS crop, material, n AS before, LEAST(n, 3) AS after, CAST(SUM(CASE WHEN k <= n - 3 THEN stone_id ELSE 0 END) AS BIGINT) AS removed_ids FROM inside GROUP BY ALL""")
def count_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Small beads of each crop and material against a hinted count of three: the lowest scores above it go."""
    rows = T.beads(spark, sf).where("phys_mm < 5").withColumn("material", F.expr(B.material()))
    # crops lie side by side, so a bead's crop follows from its place
    rows = rows.where("y_mm >= 40 AND y_mm < 200 AND x_mm >= 30 AND x_mm < 270").withColumn("crop", F.floor((F.col("x_mm") - 30) / 60).cast("int"))
    group = ["design_id", "crop", "material"]
    rows = rows.withColumns({"k": F.row_number().over(Window.partitionBy(*group).orderBy("score", "stone_id")), "n": F.count("*").over(Window.partitionBy(*group))})
    return rows.groupBy(*group).agg(F.max("n").alias("before"), F.least(F.max("n"), F.lit(3).cast("long")).alias("after"), F.sum(F.when(F.col("k") <= F.col("n") - 3, F.col("stone_id")).otherwise(0)).alias("removed_ids"))


@query("stones", sql="SELECT design_id, x, y, code_id, n, share FROM (SELECT *, n / CAST(SUM(n) OVER (PARTITION BY design_id, x, y) AS DOUBLE) AS share, ROW_NUMBER() OVER (PARTITION BY design_id, x, y ORDER BY n DESC, f) AS k FROM (SELECT design_id, CAST(FLOOR(x_mm / 100) AS BIGINT) AS x, CAST(FLOOR(y_mm / 100) AS BIGINT) AS y, code_id, COUNT(*) AS n, MIN(stone_id) AS f FROM stones GROUP BY ALL)) WHERE k = 1")
def region_codes(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest code of each region: what a ring or a border takes as a whole; ties to the code seen first."""
    at = lambda c: F.floor(F.col(c) / 100)
    return M.commonest(T.stones(spark, sf).withColumns({"x": at("x_mm"), "y": at("y_mm")}), ["design_id", "x", "y"], "code_id", "stone_id")


@query("stones", sql=""", shifts AS (SELECT (i - 3) * CAST(2 AS DOUBLE) AS dx, (j - 3) * CAST(2 AS DOUBLE) AS dy, CAST(i * 7 + j AS INTEGER) AS shift FROM range(7) a(i), range(7) b(j)), big AS (SELECT design_id, stone_id, x_mm, y_mm, layer_rank FROM stones WHERE phys_mm >= 8),
hits AS (SELECT a.design_id, shift, COUNT(DISTINCT a.stone_id) AS hits FROM big a CROSS JOIN shifts JOIN big b ON a.design_id = b.design_id AND a.layer_rank = 0 AND b.layer_rank > 0 AND abs(a.x_mm + dx - b.x_mm) < CAST(1.5 AS DOUBLE) AND abs(a.y_mm + dy - b.y_mm) < CAST(1.5 AS DOUBLE) GROUP BY ALL)
SELECT design_id, shift, hits FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY hits DESC, shift) AS k FROM hits) WHERE k = 1""")
def best_shift(spark: SparkSession, sf: str) -> DataFrame:
    """The shift, of a grid of 49, that lays most large background stones on ones of the upper layers."""
    big = T.stones(spark, sf).where("phys_mm >= 8").select("design_id", "stone_id", "x_mm", "y_mm", "layer_rank")
    shifts = spark.range(49).select(F.col("id").cast("int").alias("shift"), ((F.floor(F.col("id") / 7) - 3) * F.lit(2.0)).alias("dx"), ((F.col("id") % 7 - 3) * F.lit(2.0)).alias("dy"))
    hits = M.alignment(big.where("layer_rank = 0").drop("layer_rank"), big.where("layer_rank > 0").drop("layer_rank"), shifts, 1.5, KEY)
    return hits.groupBy("design_id").agg(F.min(F.struct((-F.col("hits")).alias("n"), "shift")).alias("m")).select("design_id", "m.shift", (-F.col("m.n")).alias("hits"))


_LABS = color.nest("catalog", color.lab_steps("r", "g", "b", "c"))
_USED = f"chosen AS (SELECT design_id, code_id, c_l, c_a, c_b, phys_mm AS code_mm, kind FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY n DESC, code_id) AS k FROM (SELECT design_id, code_id, COUNT(*) AS n FROM stones GROUP BY ALL)) JOIN {_LABS} USING (code_id) WHERE k <= 13)"
_REMAP_DE = "SQRT((lab_l - c_l) * (lab_l - c_l) + (lab_a - c_a) * (lab_a - c_a) + (lab_b - c_b) * (lab_b - c_b))"


@query("stones", "beads", "catalog", sql=f""", {_USED}, uncovered AS (SELECT s.design_id, s.stone_id, s.phys_mm, lab_l, lab_a, lab_b FROM beads s WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.design_id = s.design_id AND c.code_id = s.code_id)),
priced AS (SELECT design_id, stone_id, code_id, {_REMAP_DE} + 25 * ABS(LN(code_mm / phys_mm)) AS price FROM uncovered JOIN chosen USING (design_id) WHERE kind <> 'pearl' AND code_mm <= phys_mm + CAST(0.000001 AS DOUBLE))
SELECT design_id, stone_id, code_id AS to_code, {half_up('price', 6)} AS price FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id, stone_id ORDER BY price, code_id) AS k FROM priced) WHERE k = 1""")
def remap_uncovered(spark: SparkSession, sf: str) -> DataFrame:
    """Stones whose code is not among their design's thirteen take the cheapest of these that is not larger."""
    from lapidary.operators import design as D

    chosen = D.commonest(T.stones(spark, sf), 13).select("design_id", "code_id")
    dims = lab_catalog(spark, sf).select("code_id", "c_l", "c_a", "c_b", F.col("phys_mm").alias("code_mm"), "kind")
    # at most thirteen codes a design, beside its stones: no row a pair
    codes = chosen.join(dims, "code_id", "left").groupBy("design_id").agg(F.collect_list("code_id").alias("_own"), F.collect_list(F.when(F.col("kind") != "pearl", F.struct("code_id", "c_l", "c_a", "c_b", "code_mm"))).alias("_pool"))
    rows = T.beads(spark, sf).select("design_id", "stone_id", "code_id", "phys_mm", "lab_l", "lab_a", "lab_b").join(codes.hint("merge"), "design_id")
    rows = rows.where(~F.coalesce(F.array_contains("_own", F.col("code_id")), F.lit(False)))
    apart = lambda p: F.sqrt(sum(((F.col(f"lab_{c}") - p[f"c_{c}"]) * (F.col(f"lab_{c}") - p[f"c_{c}"]) for c in "ab"), (F.col("lab_l") - p["c_l"]) * (F.col("lab_l") - p["c_l"])))
    price = lambda p: F.struct((apart(p) + 25 * F.abs(F.log(p["code_mm"] / F.col("phys_mm")))).alias("price"), p["code_id"].alias("code_id"))
    fits = F.filter("_pool", lambda p: p["code_mm"] <= F.col("phys_mm") + F.lit(0.000001))
    # a filter on the least would be pushed down and work it out twice
    least = F.filter(F.array(F.array_min(F.transform(fits, price))), lambda m: m.isNotNull())
    priced = rows.select("design_id", "stone_id", F.explode(least).alias("m"))
    return priced.select("design_id", "stone_id", F.col("m.code_id").alias("to_code"), rounded(F.col("m.price"), 6).alias("price"))
