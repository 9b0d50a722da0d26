"""Queries on designs: relational rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.functions.numeric import quantile_inner, quantile_outer, rounded, sorted_values, upper_median
from lapidary.operators import compose as C
from lapidary.operators import design as D
from lapidary.operators import qc as Q
from lapidary.operators.spatial import stored
from lapidary.sources import tables as T

QUERIES, ORACLES = {}, {}
_D = "SQRT((a.x_mm - b.x_mm) * (a.x_mm - b.x_mm) + (a.y_mm - b.y_mm) * (a.y_mm - b.y_mm))"
_PAIRS = f""", pairs AS (SELECT a.design_id, a.stone_id AS a, b.stone_id AS b, {_D} AS d, {_D} - (a.phys_mm + b.phys_mm) / 2 AS gap FROM stones a JOIN stones b ON a.design_id = b.design_id AND a.stone_id < b.stone_id WHERE abs(a.x_mm - b.x_mm) < 13 AND abs(a.y_mm - b.y_mm) < 13)
"""


def query(sql: str | None, *views: str):
    """Registers a query under its function's name, with its SQL over the named views."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH " + ", ".join(T.SQL[v] for v in views) + "\n" if views else "") + sql
        return f

    return register


@query(
    """SELECT code_id, code, series, kind, shape, hex, phys_mm, design_id, bg, costume, pet, total, CAST(CEIL(total * CAST(1.1 AS DOUBLE)) AS BIGINT) AS with_spare
FROM (SELECT design_id, code_id, COUNT(*) FILTER (WHERE layer = 'bg') AS bg, COUNT(*) FILTER (WHERE layer = 'costume') AS costume, COUNT(*) FILTER (WHERE layer = 'pet') AS pet, COUNT(*) AS total
  FROM stones GROUP BY design_id, code_id) LEFT JOIN (SELECT code_id, code, series, kind, shape, hex, phys_mm FROM catalog) USING (code_id)""",
    "stones",
    "catalog",
)
def bom_by_layer(spark: SparkSession, sf: str) -> DataFrame:
    return D.bill(T.stones(spark, sf), T.catalog(spark, sf))


@query(
    """SELECT design_id, layer, code_id, COUNT(*) AS n, CASE GROUPING(layer, code_id) WHEN 0 THEN 'layer_code' WHEN 1 THEN 'layer' WHEN 2 THEN 'code' ELSE 'design' END AS level
FROM stones GROUP BY GROUPING SETS ((design_id, layer, code_id), (design_id, layer), (design_id, code_id), (design_id))""",
    "stones",
)
def design_counts(spark: SparkSession, sf: str) -> DataFrame:
    return D.counts(T.stones(spark, sf))


@query(
    """SELECT design_id, COUNT(*) AS n_stones, COUNT(DISTINCT code_id) AS n_codes,
  FLOOR(SUM(CAST(3.141592653589793 AS DOUBLE) * (phys_mm / 2) * (phys_mm / 2)) / CAST(90000 AS DOUBLE) * CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS coverage
FROM stones GROUP BY design_id""",
    "stones",
)
def coverage_by_product(spark: SparkSession, sf: str) -> DataFrame:
    return D.coverage(T.stones(spark, sf), T.CANVAS * T.CANVAS).withColumn("coverage", rounded(F.col("coverage"), 6))


_SYMBOLS = """, numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id, kind ORDER BY n DESC, code_id) - 1 AS place
  FROM (SELECT design_id, code_id, COUNT(*) AS n FROM stones GROUP BY design_id, code_id) JOIN (SELECT code_id, kind, phys_mm FROM catalog) USING (code_id)),
symbols AS (SELECT design_id, code_id, n, kind, CASE WHEN kind = 'pearl' THEN regexp_replace(CAST(phys_mm AS VARCHAR), '\\.0$', '')
  WHEN place < 15 THEN substr('ABCEFGJKNPRTUVY', CAST(place + 1 AS INTEGER), 1)
  WHEN place < 240 THEN substr('ABCEFGJKNPRTUVY', CAST((place - 15) // 15 + 1 AS INTEGER), 1) || substr('ABCEFGJKNPRTUVY', CAST((place - 15) % 15 + 1 AS INTEGER), 1) END AS symbol FROM numbered)
""".replace("\\\\", "\\")


@query("__symbols__", "stones", "catalog")
def symbol_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return D.symbols(T.stones(spark, sf), T.catalog(spark, sf))


ORACLES["symbol_assignment"] = ORACLES["symbol_assignment"].replace("\n__symbols__", _SYMBOLS + "SELECT * FROM symbols")


@query("__symbols__", "stones", "catalog")
def symbols_check(spark: SparkSession, sf: str) -> DataFrame:
    return D.symbol_faults(D.symbols(T.stones(spark, sf), T.catalog(spark, sf)))


ORACLES["symbols_check"] = ORACLES["symbols_check"].replace(
    "\n__symbols__",
    _SYMBOLS
    + """SELECT design_id, code_id, n, kind, symbol, fault FROM (SELECT *, CASE WHEN symbol IS NULL THEN 'missing' WHEN COUNT(symbol) OVER (PARTITION BY design_id, symbol) > 1 THEN 'repeated'
  WHEN kind = 'stone' AND length(symbol) > 1 THEN 'not_one_letter' WHEN kind = 'stone' AND strpos('ABCEFGJKNPRTUVY', symbol) = 0 THEN 'outside_set' END AS fault FROM symbols) WHERE fault IS NOT NULL""",
)


def _faulty(spark: SparkSession, sf: str) -> DataFrame:
    """Stones with planted faults: layers renamed, sizes zeroed, ids repeated, places moved out."""
    s, i = T.stones(spark, sf), F.col("stone_id")
    return s.withColumns(
        {
            "layer": F.when(i % 97 == 0, "trim").otherwise(F.col("layer")),
            "phys_mm": F.when(i % 89 == 0, 0.0).otherwise(F.col("phys_mm")),
            "x_mm": F.when(i % 83 == 0, F.col("x_mm") + T.CANVAS).otherwise(F.col("x_mm")),
            "stone_id": F.when(i % 101 == 0, i - 1).otherwise(i),
        }
    )


@query(
    """, faulty AS (SELECT design_id, CASE WHEN stone_id % 97 = 0 THEN 'trim' ELSE layer END AS layer, CASE WHEN stone_id % 89 = 0 THEN 0 ELSE phys_mm END AS phys_mm,
  CASE WHEN stone_id % 83 = 0 THEN x_mm + 300 ELSE x_mm END AS x_mm, y_mm, CASE WHEN stone_id % 101 = 0 THEN stone_id - 1 ELSE stone_id END AS stone_id FROM stones)
SELECT design_id, rule, COUNT(*) AS n, MIN(stone_id) AS first_id FROM (
  SELECT design_id, stone_id, 'unknown_layer' AS rule FROM faulty WHERE layer = 'trim' UNION ALL
  SELECT design_id, stone_id, 'size' FROM faulty WHERE NOT phys_mm > 0 UNION ALL
  SELECT design_id, stone_id, 'outside' FROM faulty WHERE x_mm > 300 UNION ALL
  SELECT design_id, stone_id, 'repeated_id' FROM (SELECT *, COUNT(*) OVER (PARTITION BY design_id, stone_id) AS k FROM faulty) WHERE k > 1)
GROUP BY design_id, rule""",
    "stones",
)
def design_validate(spark: SparkSession, sf: str) -> DataFrame:
    return D.validate(_faulty(spark, sf), T.CANVAS, T.CANVAS)


ORACLES["design_validate"] = ORACLES["design_validate"].replace("\n, faulty", ", faulty")


@query(
    """, other AS (SELECT design_id, CASE WHEN stone_id % 11 = 0 THEN stone_id + 1000000 ELSE stone_id END AS stone_id, CASE WHEN stone_id % 7 = 0 THEN x_mm + CAST(0.5 AS DOUBLE) ELSE x_mm + CAST(0.001 AS DOUBLE) END AS x_mm, y_mm, phys_mm,
  code_id, CASE WHEN stone_id % 13 = 0 THEN 'pet' ELSE layer END AS layer FROM stones)
SELECT design_id, stone_id, state, changed FROM (SELECT design_id, stone_id, CASE WHEN o.y_mm IS NULL THEN 'missing' WHEN s.y_mm IS NULL THEN 'extra' WHEN abs(s.x_mm - o.x_mm) > CAST(0.01 AS DOUBLE) OR s.layer <> o.layer THEN 'changed' END AS state,
  CASE WHEN o.y_mm IS NOT NULL AND s.y_mm IS NOT NULL THEN concat_ws(',', CASE WHEN abs(s.x_mm - o.x_mm) > CAST(0.01 AS DOUBLE) THEN 'x_mm' END, CASE WHEN s.layer <> o.layer THEN 'layer' END) END AS changed
  FROM stones s FULL JOIN other o USING (design_id, stone_id)) WHERE state IS NOT NULL""",
    "stones",
)
def design_diff(spark: SparkSession, sf: str) -> DataFrame:
    a, i = T.stones(spark, sf), F.col("stone_id")
    b = a.withColumns({"x_mm": F.col("x_mm") + F.when(i % 7 == 0, 0.5).otherwise(0.001), "layer": F.when(i % 13 == 0, "pet").otherwise(F.col("layer")), "stone_id": F.when(i % 11 == 0, i + 1000000).otherwise(i)})
    return D.diff(a, b, 0.01, ["x_mm", "y_mm", "phys_mm"], ["code_id", "layer"], ["design_id", "stone_id"])


ORACLES["design_diff"] = ORACLES["design_diff"].replace("\n, other", ", other")


@query(
    """SELECT design_id, code_id, COALESCE(placed, 0) AS placed, COALESCE(expected, 0) AS expected FROM
  (SELECT design_id, code_id, COUNT(*) AS placed FROM stones GROUP BY ALL) FULL JOIN
  (SELECT l_suppkey AS design_id, l_partkey AS code_id, COUNT(*) AS expected FROM lineitem WHERE l_discount < 0.09 GROUP BY ALL) USING (design_id, code_id)
WHERE COALESCE(placed, 0) <> COALESCE(expected, 0)""",
    "stones",
)
def layer_total_check(spark: SparkSession, sf: str) -> DataFrame:
    expected = T.read(spark, sf, "lineitem").where("l_discount < 0.09D").groupBy(F.col("l_suppkey").alias("design_id"), F.col("l_partkey").alias("code_id")).agg(F.count("*").alias("expected"))
    return D.against_bill(T.stones(spark, sf), expected)


@query(
    """SELECT design_id, code_id, fault, COUNT(*) AS n FROM (
  SELECT design_id, code_id, unnest(CASE WHEN active IS NULL THEN ['unknown'] WHEN NOT active AND abs(c.phys_mm - s.phys_mm) >= 0.000001 THEN ['inactive', 'size'] WHEN NOT active THEN ['inactive']
    WHEN abs(c.phys_mm - s.phys_mm) >= 0.000001 THEN ['size'] ELSE [] END) AS fault FROM stones s LEFT JOIN catalog c USING (code_id)) GROUP BY ALL""",
    "stones",
    "catalog",
)
def catalog_check(spark: SparkSession, sf: str) -> DataFrame:
    return D.catalog_faults(T.stones(spark, sf), T.catalog(spark, sf))


@query("SELECT design_id, codes, CASE WHEN codes > 15 THEN 'error' WHEN codes > 13 THEN 'warn' ELSE 'pass' END AS level FROM (SELECT design_id, COUNT(DISTINCT code_id) AS codes FROM stones GROUP BY design_id)", "stones")
def code_count_check(spark: SparkSession, sf: str) -> DataFrame:
    return D.code_count(T.stones(spark, sf))


@query("SELECT design_id, code_id, n, place FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY n DESC, code_id) AS INTEGER) AS place FROM (SELECT design_id, code_id, COUNT(*) AS n FROM stones GROUP BY ALL)) WHERE place <= 13", "stones")
def limit_codes(spark: SparkSession, sf: str) -> DataFrame:
    return D.commonest(T.stones(spark, sf), 13)


@query("SELECT design_id, stone_id, printf('P%05d', ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY phys_mm DESC, FLOOR(y_mm / CAST(2.95 AS DOUBLE) + CAST(0.5 AS DOUBLE)), x_mm, stone_id)) AS label FROM stones", "stones")
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return D.reading_order(T.stones(spark, sf), 2.95)


@query(
    """SELECT design_id, layer, size_class, n, share FROM (SELECT *, n / CAST(SUM(n) OVER (PARTITION BY design_id, layer) AS DOUBLE) AS share, ROW_NUMBER() OVER (PARTITION BY design_id, layer ORDER BY n DESC, size_class) AS k
  FROM (SELECT design_id, layer, size_class, COUNT(*) AS n FROM stones GROUP BY ALL)) WHERE k = 1""",
    "stones",
)
def mode_by_layer(spark: SparkSession, sf: str) -> DataFrame:
    return D.mode_share(T.stones(spark, sf), ["design_id", "layer"], "size_class")


@query(
    """SELECT design_id, q[CAST(FLOOR(CAST(0.9 AS DOUBLE) * (len(q) - 1)) AS BIGINT) + 1] AS inner_90, q[LEAST(len(q) - 1, CAST(FLOOR(CAST(0.9 AS DOUBLE) * len(q)) AS BIGINT)) + 1] AS outer_90,
  q[len(q) // 2 + 1] AS upper_median, list_quantile_cont AS linear_90
FROM (SELECT design_id, list(x_mm ORDER BY x_mm) AS q, FLOOR(quantile_cont(x_mm, 0.9) * CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS list_quantile_cont FROM stones GROUP BY design_id)""",
    "stones",
)
def quantile_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.stones(spark, sf).groupBy("design_id").agg(sorted_values(F.col("x_mm")).alias("q"), F.percentile("x_mm", F.lit(0.9)).alias("linear"))
    q = F.col("q")
    return rows.select("design_id", quantile_inner(q, 0.9).alias("inner_90"), quantile_outer(q, 0.9).alias("outer_90"), upper_median(q).alias("upper_median"), rounded(F.col("linear"), 6).alias("linear_90"))


_CSV = """, bill AS (SELECT design_id, code_id, code, series, kind, shape, hex, bg, costume, pet, total, CAST(CEIL(total * CAST(1.1 AS DOUBLE)) AS BIGINT) AS with_spare
  FROM (SELECT design_id, code_id, COUNT(*) FILTER (WHERE layer = 'bg') AS bg, COUNT(*) FILTER (WHERE layer = 'costume') AS costume, COUNT(*) FILTER (WHERE layer = 'pet') AS pet, COUNT(*) AS total FROM stones GROUP BY ALL)
  LEFT JOIN (SELECT code_id, code, series, kind, shape, hex FROM catalog) USING (code_id))
SELECT design_id, CAST(ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY part, code_id) AS INTEGER) AS row, line FROM (
  SELECT design_id, 0 AS part, NULL AS code_id, 'code,series,kind,shape,hex,bg,costume,pet,total,with_spare' AS line FROM bill GROUP BY design_id UNION ALL
  SELECT design_id, 1, code_id, concat_ws(',', COALESCE(code, ''), COALESCE(series, ''), COALESCE(kind, ''), COALESCE(shape, ''), COALESCE(hex, ''), bg, costume, pet, total, with_spare) FROM bill UNION ALL
  SELECT design_id, 2, NULL, concat_ws(',', 'TOTAL', COUNT(*) || ' codes', '', '', '', CAST(SUM(bg) AS BIGINT), CAST(SUM(costume) AS BIGINT), CAST(SUM(pet) AS BIGINT), CAST(SUM(total) AS BIGINT), CAST(SUM(with_spare) AS BIGINT)) FROM bill GROUP BY design_id)"""


@query("__csv__", "stones", "catalog")
def bom_csv(spark: SparkSession, sf: str) -> DataFrame:
    return D.bill_csv(bom_by_layer(spark, sf))


ORACLES["bom_csv"] = ORACLES["bom_csv"].replace("\n__csv__", _CSV)


@query(None)
def compose(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each layer's stones when layers are laid over each other."""
    rows = C.layered(T.stones(spark, sf).select("design_id", "stone_id", "layer", "layer_rank", "x_mm", "y_mm", "phys_mm", "locked"))
    return rows.groupBy("design_id", "layer", "fate").agg(F.count("*").alias("n"))


_REPORT = (
    _PAIRS.rstrip()
    + _SYMBOLS.rstrip()
    + """, ends AS (SELECT design_id, a AS stone_id, gap FROM pairs WHERE d < CAST(11.5 AS DOUBLE) UNION ALL SELECT design_id, b, gap FROM pairs WHERE d < CAST(11.5 AS DOUBLE)), nearest AS (SELECT design_id, stone_id, MIN(gap) AS gap FROM ends GROUP BY ALL),
faults AS (SELECT design_id, unnest(CASE WHEN active IS NULL THEN ['unknown'] WHEN NOT active AND abs(c.phys_mm - s.phys_mm) >= 0.000001 THEN ['inactive', 'size'] WHEN NOT active THEN ['inactive'] WHEN abs(c.phys_mm - s.phys_mm) >= 0.000001 THEN ['size'] ELSE [] END) AS fault FROM stones s LEFT JOIN catalog c USING (code_id)),
signs AS (SELECT design_id, CASE WHEN symbol IS NULL THEN 'missing' WHEN COUNT(symbol) OVER (PARTITION BY design_id, symbol) > 1 THEN 'repeated' WHEN kind = 'stone' AND length(symbol) > 1 THEN 'not_one_letter' WHEN kind = 'stone' AND strpos('ABCEFGJKNPRTUVY', symbol) = 0 THEN 'outside_set' END AS fault FROM symbols),
codes AS (SELECT design_id, COUNT(DISTINCT code_id) AS n, COUNT(*) AS placed FROM stones GROUP BY ALL)
SELECT design_id, 'code-count' AS check_id, CASE WHEN n > 15 THEN 'error' WHEN n > 13 THEN 'warn' ELSE 'pass' END AS level, 'codes in use' AS message, n FROM codes UNION ALL
SELECT design_id, 'catalog', CASE WHEN fault = 'inactive' THEN 'warn' ELSE 'error' END, 'code ' || fault, COUNT(*) FROM faults GROUP BY design_id, fault UNION ALL
SELECT design_id, 'symbols', CASE WHEN fault = 'outside_set' THEN 'warn' ELSE 'error' END, 'symbol ' || fault, COUNT(*) FROM signs WHERE fault IS NOT NULL GROUP BY design_id, fault UNION ALL
SELECT design_id, 'layer-total', 'info', 'no bill to compare with', placed FROM codes UNION ALL
SELECT design_id, 'overlap', 'error', 'overlapping pairs', COUNT(*) FROM pairs WHERE d < 10 AND gap < CAST(-0.05 AS DOUBLE) GROUP BY design_id UNION ALL
SELECT design_id, 'gap', 'warn', 'stones too close', COUNT(*) FROM nearest WHERE gap >= CAST(-0.05 AS DOUBLE) AND gap < CAST(0.15 AS DOUBLE) GROUP BY design_id UNION ALL
SELECT design_id, 'outside-region', 'error', 'stones over the edge', COUNT(*) FROM stones WHERE GREATEST(phys_mm / 2 - x_mm, phys_mm / 2 - y_mm, x_mm + phys_mm / 2 - 300, y_mm + phys_mm / 2 - 300) > CAST(0.05 AS DOUBLE) GROUP BY design_id UNION ALL
SELECT design_id, 'holes', 'info', 'no mask of what to cover', placed FROM codes UNION ALL SELECT design_id, 'delta-e', 'info', 'no images to compare', placed FROM codes UNION ALL SELECT design_id, 'merge-warnings', 'pass', 'no merged codes', 0 FROM codes"""
)


@query("__report__", "stones", "catalog")
def qc_report(spark: SparkSession, sf: str) -> DataFrame:
    context = {"catalog": T.catalog(spark, sf), "width": T.CANVAS, "height": T.CANVAS}
    # written once, since each check is a table of its own
    return Q.run(stored(T.stones(spark, sf), "stones"), context).select("design_id", "check_id", "level", "message", "n")


ORACLES["qc_report"] = ORACLES["qc_report"].replace("\n__report__", _REPORT)
