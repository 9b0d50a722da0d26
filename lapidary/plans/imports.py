"""Queries that bring products and maps in: symbol maps as SVG, product imports, first-row bills, locked stones, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.functions.numeric import half_up, rounded
from lapidary.operators import spatial as S
from lapidary.plans.registry import Registry
from lapidary.sources import kit as K
from lapidary.sources import markup as M
from lapidary.sources import tables as T

query = Registry()
KEY = ["design_id"]
# Drawn size of each physical size; others are drawn 0.8 mm smaller.
DRAWN = {2.8: 2.2, 4.0: 3.2, 5.0: 4.2, 6.0: 5.2, 8.0: 7.2}
DRAWN_GAP = 0.8


def drawn_size(size: Column) -> Column:
    """From the table of sizes, within a millionth, else by the usual gap."""
    out = rounded(size - F.lit(DRAWN_GAP), 6)
    for physical, drawn in DRAWN.items():
        out = F.when(F.abs(size - F.lit(physical)) < 1e-6, F.lit(drawn)).otherwise(out)
    return out


_DRAWN_SQL = "CASE " + " ".join(f"WHEN abs({{0}} - CAST({p} AS DOUBLE)) < CAST(0.000001 AS DOUBLE) THEN CAST({d} AS DOUBLE)" for p, d in DRAWN.items()) + f" ELSE {half_up('{0} - CAST(0.8 AS DOUBLE)', 6)} END"


@query("stones", sql=f"""SELECT design_id, stone_id, layer, 'round' AS shape, {half_up('x_mm * CAST(1.00003 AS DOUBLE)', 4)} AS x_mm, {half_up('y_mm * CAST(1.00003 AS DOUBLE)', 4)} AS y_mm, phys_mm, {_DRAWN_SQL.format('phys_mm')} AS ref_mm, CAST(0 AS DOUBLE) AS rot_deg, true AS locked, 'db:' || design_id AS source FROM stones""")
def import_product(spark: SparkSession, sf: str) -> DataFrame:
    """A product's stones as one locked layer, to a tenth of a micrometre, with drawn sizes."""
    rows = T.stones(spark, sf)
    at = lambda c: rounded(F.col(c) * F.lit(1.00003), 4).alias(c)
    return rows.select("design_id", "stone_id", "layer", F.lit("round").alias("shape"), at("x_mm"), at("y_mm"), "phys_mm", drawn_size(F.col("phys_mm")).alias("ref_mm"), F.lit(0.0).alias("rot_deg"), F.lit(True).alias("locked"), F.concat(F.lit("db:"), F.col("design_id").cast("string")).alias("source"))


@query("stones", sql=f"""SELECT design_id, 'kind ' || design_id % 3 AS kind, design_id % 4 <> 0 AS compliant, COUNT(*) AS n_stones, COUNT(DISTINCT code_id) AS n_codes, {half_up('SUM(CAST(3.141592653589793 AS DOUBLE) * (phys_mm / 2) * (phys_mm / 2)) / (CASE WHEN design_id % 3 = 1 THEN CAST(90000 AS DOUBLE) * CAST(0.7853981633974483 AS DOUBLE) ELSE CAST(90000 AS DOUBLE) END)', 6)} AS coverage
FROM stones WHERE design_id % 4 <> 0 GROUP BY design_id""")
def compliant_products(spark: SparkSession, sf: str) -> DataFrame:
    """The list of compliant products, with covered shares of a round (kind 1) or square canvas."""
    rows = T.stones(spark, sf).where("design_id % 4 <> 0")
    area = F.when(F.col("design_id") % 3 == 1, F.lit(90000.0) * F.lit(0.7853981633974483)).otherwise(F.lit(90000.0))
    half = F.col("phys_mm") / 2
    sums = rows.groupBy("design_id").agg(F.count("*").alias("n_stones"), F.count_distinct("code_id").alias("n_codes"), F.sum(F.lit(3.141592653589793) * half * half).alias("covered"))
    return sums.select("design_id", F.concat(F.lit("kind "), (F.col("design_id") % 3).cast("string")).alias("kind"), F.lit(True).alias("compliant"), "n_stones", "n_codes", rounded(F.col("covered") / area, 6).alias("coverage"))


_SYMBOL = "CASE WHEN kind = 'pearl' THEN CASE WHEN code_id % 20 = 0 THEN code ELSE 'P' END WHEN code_id % 11 = 0 THEN '7' WHEN code_id % 6 = 0 THEN 'ab' ELSE substr('ABCEFGJKNPRTUVY', CAST(code_id % 15 + 1 AS INTEGER), 1) END"


@query("stones", "catalog", sql=f""", marked AS (SELECT design_id, stone_id, code_id, code, kind, s.phys_mm, {_SYMBOL} AS symbol FROM stones s JOIN (SELECT code_id, code, kind FROM catalog) USING (code_id)),
firsts AS (SELECT *, COUNT(*) OVER (PARTITION BY design_id, code_id) AS n, ROW_NUMBER() OVER (PARTITION BY design_id, code_id ORDER BY stone_id) AS k, CASE WHEN regexp_matches(symbol, '^[0-9]+$') THEN 'digit' WHEN regexp_matches(symbol, '^[A-Z]+$') THEN 'letter' ELSE 'other' END AS symbol_kind FROM marked)
SELECT design_id, code_id, n, phys_mm, symbol, symbol_kind, CASE WHEN kind = 'pearl' THEN symbol = code ELSE symbol_kind = 'letter' END AS spec_symbol_ok FROM firsts WHERE k = 1""")
def product_bill(spark: SparkSession, sf: str) -> DataFrame:
    """A product's bill with the size and symbol of each code's first stone, and whether the symbol keeps the rule."""
    dims = T.catalog(spark, sf).select("code_id", "code", "kind")
    rows = T.stones(spark, sf).select("design_id", "stone_id", "code_id", "phys_mm").join(dims, "code_id").withColumn("symbol", F.expr(_SYMBOL))
    bill = rows.groupBy("design_id", "code_id").agg(F.count("*").alias("n"), F.min(F.struct("stone_id", "phys_mm", "symbol", "code", "kind")).alias("f")).select("design_id", "code_id", "n", "f.*")
    kind = symbol_kind(F.col("symbol"))
    return bill.select("design_id", "code_id", "n", "phys_mm", "symbol", kind.alias("symbol_kind"), F.when(F.col("kind") == "pearl", F.col("symbol") == F.col("code")).otherwise(kind == "letter").alias("spec_symbol_ok"))


def symbol_kind(symbol: Column) -> Column:
    return F.when(symbol.rlike("^[0-9]+$"), "digit").when(symbol.rlike("^[A-Z]+$"), "letter").otherwise("other")


def _maps(spark: SparkSession, sf: str) -> DataFrame:
    """Each design as a symbol map: its stones by layer, with planted faults."""
    rows = T.stones(spark, sf).select("design_id", "stone_id", "layer", "layer_rank", "code_id", "x_mm", "y_mm", "phys_mm").join(T.catalog(spark, sf).select("code_id", "code", "hex"), "code_id")
    # dealt out by design as numbers, so that no text is ever moved
    rows = rows.repartition("design_id")
    i, x, y = F.col("stone_id"), F.col("x_mm") * F.lit(K.PX_PER_MM), F.col("y_mm") * F.lit(K.PX_PER_MM)
    shape = F.when(i % 61 == 0, "heart").otherwise("round")
    symbol = F.substring(F.lit("ABCEFGJKNPRTUVY"), (F.col("code_id") % 15 + 1).cast("int"), F.lit(1))
    size = F.regexp_replace(F.col("phys_mm").cast("string"), r"\.0$", "")
    group = F.concat(F.lit("K_"), F.col("code"), F.lit("_S"), size, F.when(i % 5 == 0, F.concat(F.lit("x"), size)).otherwise(""))
    text = K.stone_text(F.concat(F.lit("P"), i.cast("string")), symbol, F.col("code"), x, y, F.col("phys_mm"), group, F.col("hex"), shape)
    text = F.when(i % 53 == 0, F.regexp_replace(text, "</text>", "!</text>")).otherwise(text)
    layers = rows.select("design_id", "layer_rank", "layer", F.struct("stone_id", text.alias("text")).alias("s")).groupBy("design_id", "layer_rank", "layer").agg(F.array_sort(F.collect_list("s")).alias("all"))
    body = F.concat(F.lit('<g data-layer="'), F.col("layer"), F.lit('">\n'), F.array_join(F.transform("all", lambda s: s["text"]), ""), F.lit("</g>\n"))
    files = layers.select("design_id", F.struct("layer_rank", body.alias("body")).alias("l")).groupBy("design_id").agg(F.array_sort(F.collect_list("l")).alias("all"))
    return files.select("design_id", K.file_text(F.array_join(F.transform("all", lambda x: x["body"]), "")).alias("svg"))


@query("stones", "catalog", sql=f"""SELECT design_id, 'P' || stone_id AS id, layer, code, substr('ABCEFGJKNPRTUVY', CAST(code_id % 15 + 1 AS INTEGER), 1) AS symbol, {half_up('x_mm * CAST(11.81 AS DOUBLE)', 4)} AS x, {half_up('y_mm * CAST(11.81 AS DOUBLE)', 4)} AS y, s.phys_mm AS d_mm, s.phys_mm AS size_mm,
  CASE WHEN stone_id % 61 = 0 THEN 'not_round' WHEN stone_id % 53 = 0 THEN 'text_differs' END AS fault FROM stones s JOIN (SELECT code_id, code FROM catalog) USING (code_id)""")
def symbol_map_read(spark: SparkSession, sf: str) -> DataFrame:
    """Maps written as SVG and read again: places, layers by the mark before, sizes from group names, broken rules."""
    rows = K.read(_maps(spark, sf), KEY)
    return rows.select("design_id", "id", "layer", "code", "symbol", rounded(F.col("x"), 4).alias("x"), rounded(F.col("y"), 4).alias("y"), "d_mm", rounded(F.col("size_mm"), 6).alias("size_mm"), "fault")


@query("stones", sql="SELECT design_id, CASE WHEN design_id % 3 = 0 THEN 'canvas' ELSE 'unread_stones' END AS fault FROM (SELECT DISTINCT design_id FROM stones) WHERE design_id % 3 < 2")
def symbol_map_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Whole files with another canvas, or with stones that the reader's pattern misses."""
    files = _maps(spark, sf)
    broken = F.when(F.col("design_id") % 3 == 0, F.replace("svg", F.lit("0 0 3543 3543"), F.lit("0 0 2894 2894"))).when(F.col("design_id") % 3 == 1, F.replace("svg", F.lit("</svg>"), F.lit('<ellipse data-position-id="P0"/></svg>'))).otherwise(F.col("svg"))
    return K.file_faults(files.withColumn("svg", broken), KEY)


@query("stones", "catalog", sql=f"""SELECT design_id, stone_id, {half_up('x_mm * CAST(11.81 AS DOUBLE) / CAST(11.81 AS DOUBLE)', 4)} AS x_mm, {half_up('y_mm * CAST(11.81 AS DOUBLE) / CAST(11.81 AS DOUBLE)', 4)} AS y_mm, COALESCE(c.phys_mm, {half_up('d_mm + CAST(0.8 AS DOUBLE)', 4)}) AS phys_mm, {half_up('d_mm', 4)} AS ref_mm
FROM (SELECT *, {_DRAWN_SQL.format('phys_mm')} AS d_mm, CASE WHEN stone_id % 10 = 0 THEN -code_id ELSE code_id END AS drawn_code FROM stones) s LEFT JOIN catalog c ON c.code_id = s.drawn_code""")
def import_map(spark: SparkSession, sf: str) -> DataFrame:
    """A map's stones in millimetres, sizes from the catalogue, or 0.8 mm over the drawn size where the code is unknown."""
    rows = T.stones(spark, sf).select("design_id", "stone_id", F.when(F.col("stone_id") % 10 == 0, -F.col("code_id")).otherwise(F.col("code_id")).alias("code_id"), (F.col("x_mm") * F.lit(K.PX_PER_MM)).alias("x"), (F.col("y_mm") * F.lit(K.PX_PER_MM)).alias("y"), drawn_size(F.col("phys_mm")).alias("d_mm"))
    met = rows.join(T.catalog(spark, sf).select("code_id", "phys_mm"), "code_id", "left")
    return met.select("design_id", "stone_id", rounded(F.col("x") / F.lit(K.PX_PER_MM), 4).alias("x_mm"), rounded(F.col("y") / F.lit(K.PX_PER_MM), 4).alias("y_mm"), F.coalesce("phys_mm", rounded(F.col("d_mm") + F.lit(DRAWN_GAP), 4)).alias("phys_mm"), rounded(F.col("d_mm"), 4).alias("ref_mm"))


# Approved large stones: those of 8 mm and more, some recoded, some dropped, moved a little.
_APPROVED = {"code": "CASE WHEN stone_id % 5 = 0 THEN NULL WHEN stone_id % 3 = 0 THEN code_id + 1 ELSE code_id END", "x": "x_mm + CAST(stone_id % 8 AS DOUBLE) / CAST(10 AS DOUBLE)"}


@query("stones", sql=f""", approved AS (SELECT design_id, stone_id, {_APPROVED['code']} AS code_id, {_APPROVED['x']} AS x_mm, y_mm FROM stones WHERE phys_mm >= 8)
SELECT design_id, stone_id FROM stones s WHERE EXISTS (SELECT 1 FROM approved b WHERE b.design_id = s.design_id AND b.code_id = s.code_id AND SQRT((s.x_mm - b.x_mm) * (s.x_mm - b.x_mm) + (s.y_mm - b.y_mm) * (s.y_mm - b.y_mm)) < CAST(0.5 AS DOUBLE))""")
def locked_stones(spark: SparkSession, sf: str) -> DataFrame:
    """Stones that are an approved one: of its code, after recoding, and within half a millimetre."""
    rows = T.stones(spark, sf).select("design_id", "stone_id", "code_id", "x_mm", "y_mm", "phys_mm")
    approved = rows.where("phys_mm >= 8").select("design_id", "stone_id", F.expr(_APPROVED["code"]).alias("code_id"), F.expr(_APPROVED["x"]).alias("x_mm"), "y_mm").where("code_id IS NOT NULL")
    return S.within(rows.drop("phys_mm"), approved, 0.5, ["design_id", "code_id"]).select("design_id", F.col("a_stone_id").alias("stone_id")).distinct()


# A coloured mask of 40 x 40 pixels a design, and its legend.
_PIXEL = {"r": "(px * 7 + py * 3 + design_id) % 256", "g": "(px * 5 + py * 11 + design_id * 3) % 256", "b": "(px * 13 + py * 2 + design_id * 7) % 256"}
LEGEND = {"background": (250, 60, 40), "costume": (40, 240, 90), "petFace": (60, 70, 230)}
_NEAR = [f"abs(r - {c[0]}) + abs(g - {c[1]}) + abs(b - {c[2]})" for c in LEGEND.values()]
_REGION = f"CASE WHEN {_NEAR[0]} <= {_NEAR[1]} AND {_NEAR[0]} <= {_NEAR[2]} THEN 'background' WHEN {_NEAR[1]} <= {_NEAR[2]} THEN 'costume' ELSE 'petFace' END"


def mask(spark: SparkSession, sf: str) -> DataFrame:
    """(design_id, px, py, r, g, b); 1,600 rows a design, which no estimate sees, so never to be broadcast."""
    ids = T.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("design_id"))
    cells = ids.withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(39))))
    return cells.withColumns({c: F.expr(x) for c, x in _PIXEL.items()}).hint("merge")


_MASK = f"mask AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in _PIXEL.items())} FROM (SELECT s_suppkey AS design_id, i AS px, j AS py FROM supplier, range(40) a(i), range(40) b(j)))"


def at_pixel(v: str) -> Column:
    """The pixel of a mask of 40 that a millimetre falls into, the last one for the edge."""
    return F.greatest(F.least(F.floor(F.col(v) / F.lit(300.0) * 40), F.lit(39)), F.lit(0))


@query("stones", sql=f""", {_MASK} SELECT design_id, layer, {_REGION} AS region, COUNT(*) AS n, COUNT(*) FILTER (WHERE {_REGION} = CASE layer WHEN 'bg' THEN 'background' WHEN 'costume' THEN 'costume' ELSE 'petFace' END) AS own
FROM (SELECT design_id, layer, CAST(GREATEST(LEAST(FLOOR(x_mm / CAST(300 AS DOUBLE) * 40), 39), 0) AS BIGINT) AS px, CAST(GREATEST(LEAST(FLOOR(y_mm / CAST(300 AS DOUBLE) * 40), 39), 0) AS BIGINT) AS py FROM stones) JOIN mask USING (design_id, px, py) GROUP BY ALL""")
def layer_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Which region of the mask, by its legend's nearest colour, each stone's centre lies in, and whether it is its layer's."""
    rows = T.stones(spark, sf).select("design_id", "layer", at_pixel("x_mm").alias("px"), at_pixel("y_mm").alias("py"))
    met = rows.join(mask(spark, sf), ["design_id", "px", "py"]).withColumn("region", F.expr(_REGION))
    own = F.element_at(F.create_map(*(F.lit(x) for p in zip(("bg", "costume", "pet"), LEGEND) for x in p)), F.col("layer"))
    return met.groupBy("design_id", "layer", "region").agg(F.count("*").alias("n"), F.count_if(F.col("region") == own).alias("own"))


@query("stones", sql="""SELECT design_id, code_id, COUNT(DISTINCT layer) AS layers, COUNT(DISTINCT size_class) AS sizes, COUNT(*) AS n, COUNT(DISTINCT size_class) > 1 AS conflict FROM stones GROUP BY ALL""")
def palette_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """A map's palette: how many layers use each code, and whether its stones agree in size."""
    return T.stones(spark, sf).groupBy("design_id", "code_id").agg(F.count_distinct("layer").alias("layers"), F.count_distinct("size_class").alias("sizes"), F.count("*").alias("n"), (F.count_distinct("size_class") > 1).alias("conflict"))


@query("stones", sql="SELECT design_id, symbol, COUNT(*) AS codes FROM (SELECT DISTINCT design_id, code_id, substr('ABCEFGJKNPRTUVY', CAST(code_id % 15 + 1 AS INTEGER), 1) AS symbol FROM stones) GROUP BY ALL HAVING COUNT(*) > 1")
def symbol_clashes(spark: SparkSession, sf: str) -> DataFrame:
    symbol = F.substring(F.lit("ABCEFGJKNPRTUVY"), (F.col("code_id") % 15 + 1).cast("int"), F.lit(1))
    return T.stones(spark, sf).select("design_id", "code_id", symbol.alias("symbol")).distinct().groupBy("design_id", "symbol").agg(F.count("*").alias("codes")).where("codes > 1")


@query("stones", sql="""SELECT design_id, stone_id, '{"id":"P' || stone_id || '","layer":"' || layer || '","x":' || CAST(CAST(FLOOR(x_mm * 10 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS VARCHAR) || ',"locked":' || CASE WHEN locked THEN 'true' ELSE 'false' END || '}' AS line FROM stones""")
def map_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A map as JSON lines, a stone a line; places in tenths of a millimetre."""
    rows = T.stones(spark, sf)
    line = F.to_json(F.struct(F.concat(F.lit("P"), F.col("stone_id").cast("string")).alias("id"), "layer", F.floor(F.col("x_mm") * 10 + F.lit(0.5)).alias("x"), "locked"))
    return rows.select("design_id", "stone_id", line.alias("line"))


@query("stones", "catalog", sql=f"""SELECT design_id, stone_id, s.layer, code, c.shape, {half_up('x_mm', 5)} AS x_mm, {half_up('y_mm', 5)} AS y_mm, s.phys_mm, {_DRAWN_SQL.format('s.phys_mm')} AS ref_mm, locked, stone_id % 4 + 2 AS level
FROM stones s JOIN (SELECT code_id, code, shape FROM catalog) c USING (code_id)""")
def nested_svg(spark: SparkSession, sf: str) -> DataFrame:
    """Designs written as editable SVG and read again: layers, sheets within them, and turned rows within those.

    A stone stands directly in its layer or up to three groups deeper, each of which moves, turns or scales what it holds;
    what is written is the stone's place before that.
    """
    rows = T.stones(spark, sf).select("design_id", "stone_id", "layer", "layer_rank", "code_id", "x_mm", "y_mm", "phys_mm", "locked").join(T.catalog(spark, sf).select("code_id", "code", "shape"), "code_id")
    # dealt out by design as numbers, so that no text is ever moved
    rows = rows.repartition("design_id")
    depth = F.col("stone_id") % 4
    # the groups, outermost first, and the way back through them
    moves = ["translate(10 -20)", "rotate(90 150 150)", "scale(2)"]
    x1, y1 = F.col("x_mm") - 10, F.col("y_mm") + 20
    x2, y2 = y1, 300 - x1  # a quarter turn back about (150, 150)
    x = F.when(depth == 0, F.col("x_mm")).when(depth == 1, x1).when(depth == 2, x2).otherwise(x2 / 2)
    y = F.when(depth == 0, F.col("y_mm")).when(depth == 1, y1).when(depth == 2, y2).otherwise(y2 / 2)
    text = M.stone_group(F.col("stone_id").cast("string"), F.col("code"), F.col("shape"), x, y, F.when(depth >= 2, -90.0).otherwise(0.0), F.col("phys_mm"), drawn_size(F.col("phys_mm")), F.col("locked"))
    lists = rows.groupBy("design_id", "layer_rank", "layer").agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(depth == d, F.struct("stone_id", text.alias("text"))))), lambda s: s["text"]), "").alias(f"_{d}") for d in range(4)))
    body = F.col("_3")
    for d in (2, 1, 0):
        body = F.concat(F.col(f"_{d}"), M.group_text("class", F.lit(f"sheet {d}"), F.lit(moves[d]), body))
    layers = lists.groupBy("design_id").agg(F.array_sort(F.collect_list(F.struct("layer_rank", M.group_text("data-layer", F.col("layer"), None, body).alias("body")))).alias("all"))
    files = layers.select("design_id", F.concat(F.lit('<svg viewBox="0 0 300 300">\n'), F.array_join(F.transform("all", lambda g: g["body"]), ""), F.lit("</svg>\n")).alias("svg"))
    read = M.read_groups(files, KEY).where("fault is null and abs(rot_deg) < 0.001")
    return read.select("design_id", F.col("id").cast("long").alias("stone_id"), "layer", "code", "shape", rounded(F.col("x_mm"), 5).alias("x_mm"), rounded(F.col("y_mm"), 5).alias("y_mm"), "phys_mm", "ref_mm", "locked", "level")
