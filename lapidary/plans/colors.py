"""Queries on colours and palettes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapidary.functions import beads as B
from lapidary.functions import color
from lapidary.functions.numeric import half_up, rounded
from lapidary.operators import fit
from lapidary.operators import learn as L
from lapidary.operators import palette as P
from lapidary.plans.registry import Registry
from lapidary.sources import tables as T

query = Registry()
_C = color.lab_steps("r", "g", "b", "c")
_CODE_SQL = f"(SELECT code_id, kind, active, phys_mm AS code_mm, c_l AS q_l, c_a AS q_a, c_b AS q_b FROM {color.nest('catalog', _C)})"
_TARGET_SQL = f"(SELECT target_id, layer, weight, phys_mm AS want_mm, c_l AS p_l, c_a AS p_a, c_b AS p_b FROM {color.nest('targets', _C)})"
_PAIR_SQL = color.nest(f"(SELECT * FROM {_TARGET_SQL} t CROSS JOIN {_CODE_SQL} c)", color.de2000_steps("p", "q"))
_COST = """CASE WHEN kind <> 'pearl' AND abs(want_mm - code_mm) < CAST(0.000001 AS DOUBLE) THEN de WHEN kind <> 'pearl' AND want_mm - code_mm > CAST(0.000001 AS DOUBLE) THEN de + 20 + 2 * (want_mm - code_mm)
  WHEN kind = 'pearl' AND want_mm >= 4 AND want_mm - code_mm >= CAST(-0.000001 AS DOUBLE) AND p_l >= 70 AND SQRT(p_a * p_a + p_b * p_b) <= 15 THEN de + 12 END"""


@query("catalog", sql=f"SELECT code_id, {half_up('c_l', 6)} AS l, {half_up('c_a', 6)} AS a, {half_up('c_b', 6)} AS b FROM {color.nest('catalog', _C)}")
def lab_colors(spark: SparkSession, sf: str) -> DataFrame:
    rows = color.add(T.catalog(spark, sf), _C)
    return rows.select("code_id", *(rounded(F.col(f"c_{x}"), 6).alias(x) for x in "lab"))


@query("catalog", sql=f"SELECT code_id, family FROM {color.nest('catalog', color.family_steps('r', 'g', 'b'))}")
def color_family(spark: SparkSession, sf: str) -> DataFrame:
    return color.add(T.catalog(spark, sf), color.family_steps("r", "g", "b")).select("code_id", "family")


@query("catalog", sql="""SELECT code_id, hex, CASE WHEN CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b > 145 THEN '#111111' ELSE '#FFFFFF' END AS text_hex,
  '#' || printf('%02X%02X%02X', CAST(FLOOR(r * CAST(0.42 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INTEGER), CAST(FLOOR(g * CAST(0.42 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INTEGER), CAST(FLOOR(b * CAST(0.42 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INTEGER)) AS edge_hex,
  CASE WHEN kind = 'pearl' THEN 'pearl' WHEN series ILIKE '%brass%' OR series ILIKE '%copper%' THEN 'gold' WHEN code_id % 9 = 0 THEN 'facet' ELSE 'base' END AS material FROM catalog""")
def swatches(spark: SparkSession, sf: str) -> DataFrame:
    """Text colour by luma, edge colour, and material by kind and name."""
    luma = F.col("r") * F.lit(0.299) + F.col("g") * F.lit(0.587) + F.col("b") * F.lit(0.114)
    edge = lambda c: F.lpad(F.hex(F.floor(F.col(c) * F.lit(0.42) + F.lit(0.5)).cast("int")), 2, "0")
    material = F.when(F.col("kind") == "pearl", "pearl").when(F.col("series").rlike("(?i)brass|copper"), "gold").when(F.col("code_id") % 9 == 0, "facet").otherwise("base")
    return T.catalog(spark, sf).select("code_id", "hex", F.when(luma > 145, "#111111").otherwise("#FFFFFF").alias("text_hex"), F.concat(F.lit("#"), edge("r"), edge("g"), edge("b")).alias("edge_hex"), material.alias("material"))


@query("catalog", "targets", sql=f"SELECT target_id, code_id, {half_up('de', 6)} AS de FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY target_id ORDER BY de, code_id) AS k FROM {_PAIR_SQL} WHERE active) WHERE k = 1")
def nearest_code(spark: SparkSession, sf: str) -> DataFrame:
    return P.nearest(T.targets(spark, sf), T.catalog(spark, sf).where("active")).withColumn("de", rounded(F.col("de"), 6))


@query("catalog", "targets", sql=f"SELECT target_id, COUNT(cost) AS usable, {half_up('MIN(cost)', 6)} AS least FROM (SELECT target_id, {_COST} AS cost FROM {_PAIR_SQL}) GROUP BY target_id")
def stone_cost(spark: SparkSession, sf: str) -> DataFrame:
    return P.usable(T.targets(spark, sf), T.catalog(spark, sf)).withColumn("least", rounded(F.col("least"), 6))


def _costs(spark: SparkSession, sf: str) -> DataFrame:
    return P.costs(T.targets(spark, sf), P.looks(T.catalog(spark, sf)))


@query("catalog", "targets", sql=f""", codes AS (SELECT p_partkey AS code_id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 11), costs AS (SELECT target_id, code_id, {_COST} AS cost FROM {_PAIR_SQL}),
best AS (SELECT target_id, MIN(cost) AS cost FROM costs WHERE code_id IN (SELECT code_id FROM codes) GROUP BY target_id)
SELECT layer, CAST(SUM(weight) AS BIGINT) AS stones, CAST(COALESCE(SUM(weight) FILTER (WHERE cost IS NULL), 0) AS BIGINT) AS uncovered, {half_up('SUM(COALESCE(cost, 1000) * weight)', 4)} AS cost FROM targets LEFT JOIN best USING (target_id) GROUP BY layer""")
def palette_eval(spark: SparkSession, sf: str) -> DataFrame:
    """What the eleven dearest codes cost as a palette (a top-k report)."""
    codes = T.read(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(11).select(F.col("p_partkey").alias("code_id"))
    costs = P.costs(T.targets(spark, sf), T.catalog(spark, sf).join(codes, "code_id", "left_semi"))
    return P.evaluate(costs, T.targets(spark, sf), codes).withColumn("cost", rounded(F.col("cost"), 4))


def _greedy_steps(rounds: int) -> list[str]:
    """Greedy choice, a pair of tables a round: the code that saves most, and what each target pays from then on."""
    steps = [f"costs AS MATERIALIZED (SELECT * FROM (SELECT target_id, weight, code_id, {_COST} AS cost FROM {_PAIR_SQL}) WHERE cost IS NOT NULL)", "now0 AS MATERIALIZED (SELECT target_id, CAST(1000 AS DOUBLE) AS now FROM targets)"]
    for i in range(1, rounds + 1):
        steps.append(f"pick{i} AS MATERIALIZED (SELECT code_id, SUM(GREATEST(now - cost, 0) * weight) AS gain FROM costs JOIN now{i - 1} USING (target_id) GROUP BY code_id ORDER BY ROUND(gain, 6) DESC, code_id LIMIT 1)")
        steps.append(f"now{i} AS MATERIALIZED (SELECT target_id, LEAST(now, COALESCE(cost, now)) AS now FROM now{i - 1} LEFT JOIN (SELECT target_id, cost FROM costs WHERE code_id = (SELECT code_id FROM pick{i})) USING (target_id))")
    return steps


def _greedy_sql(rounds: int) -> str:
    picks = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS place, code_id, {half_up('gain', 4)} AS gain FROM pick{i} WHERE gain > 0" for i in range(1, rounds + 1))
    return f", {', '.join(_greedy_steps(rounds))} {picks}"


@query("catalog", "targets", sql=_greedy_sql(P.MAX_CODES))
def palette_greedy(spark: SparkSession, sf: str) -> DataFrame:
    found = P.greedy(_costs(spark, sf), T.targets(spark, sf), P.MAX_CODES)
    return spark.createDataFrame([(i + 1, c, float(g)) for i, (c, g) in enumerate(found)], "place int, code_id long, gain double").withColumn("gain", rounded(F.col("gain"), 4))


@query()
def palette_swaps(spark: SparkSession, sf: str) -> DataFrame:
    costs, targets = _costs(spark, sf), T.targets(spark, sf)
    codes = P.swapped(costs, targets, [c for c, _ in P.greedy(costs, targets, P.MAX_CODES)])
    return spark.createDataFrame([(c,) for c in sorted(codes)], "code_id long")


@query()
def palette_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Cheapest merges, from each target's best code, of its own size where there is one, down to eleven codes."""
    _, history = P.merge(_costs(spark, sf), T.targets(spark, sf), P.MAX_CODES, catalog=T.catalog(spark, sf))
    return spark.createDataFrame([(i + 1, a, b, float(p)) for i, (a, b, p) in enumerate(history)], "step int, from_code long, to_code long, price double")


_MERGES = f"""SELECT code_id, to_code, {half_up('de', 6)} AS de, CASE WHEN de > 20 THEN 'warn' ELSE 'info' END AS level FROM {color.nest(f"(SELECT a.code_id, b.code_id AS to_code, a.q_l AS p_l, a.q_a AS p_a, a.q_b AS p_b, b.q_l, b.q_a, b.q_b FROM {_CODE_SQL} a JOIN {_CODE_SQL} b ON b.code_id = a.code_id + 1)", color.de2000_steps("p", "q"))}"""


@query("catalog", sql=_MERGES)
def merge_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Codes merged into their successor: a difference over 20 needs a look."""
    labs = color.add(T.catalog(spark, sf), _C)
    a = labs.select("code_id", (F.col("code_id") + 1).alias("to_code"), *(F.col(f"c_{x}").alias(f"p_{x}") for x in "lab"))
    b = labs.select(F.col("code_id").alias("to_code"), *(F.col(f"c_{x}").alias(f"q_{x}") for x in "lab"))
    rows = color.add(a.join(b, "to_code"), color.de2000_steps("p", "q"), ["de"])
    return rows.select("code_id", "to_code", rounded(F.col("de"), 6).alias("de"), F.when(F.col("de") > 20, "warn").otherwise("info").alias("level"))


_KNN = f""", pairs AS (SELECT target_id, code_id, p_l, p_a, p_b, q_l, q_a, q_b, kind, (p_l - q_l) * (p_l - q_l) + (p_a - q_a) * (p_a - q_a) + (p_b - q_b) * (p_b - q_b) + 36 * (want_mm - code_mm) * (want_mm - code_mm) AS dd FROM {_TARGET_SQL} CROSS JOIN {_CODE_SQL}),
near AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY target_id ORDER BY dd, code_id) AS k, 1 / (SQRT(dd) + 1) AS w FROM pairs) WHERE k <= 15)
"""


def _near(spark: SparkSession, sf: str) -> DataFrame:
    targets = color.add(T.targets(spark, sf).withColumnRenamed("phys_mm", "want_mm"), color.lab_steps("r", "g", "b", "p"), ["p_l", "p_a", "p_b"]).select("target_id", "want_mm", "p_l", "p_a", "p_b")
    model = color.add(T.catalog(spark, sf).withColumnRenamed("phys_mm", "code_mm"), color.lab_steps("r", "g", "b", "q"), ["q_l", "q_a", "q_b"]).select("code_id", "kind", "code_mm", "q_l", "q_a", "q_b")
    gaps = [F.col(f"p_{x}") - F.col(f"q_{x}") for x in "lab"]
    size = F.col("want_mm") - F.col("code_mm")
    targets, model = targets.withColumn("p_s", 6 * F.col("want_mm")), model.withColumn("q_s", 6 * F.col("code_mm"))
    near = L.nearest_in_space(targets, model, sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) + 36 * size * size, [(f"p_{x}", f"q_{x}") for x in "labs"], 15, "target_id", "code_id")
    return near.withColumn("w", L.closeness(F.col("distance")))


@query("catalog", "targets", sql=_KNN + f"SELECT target_id, {', '.join(half_up(f'ANY_VALUE(p_{x}) + SUM(w * (q_{x} - p_{x})) / SUM(w)', 6) + f' AS {x}' for x in 'lab')} FROM near GROUP BY target_id")
def knn_residual(spark: SparkSession, sf: str) -> DataFrame:
    """Each target moved by the weighted mean residual of its 15 nearest codes."""
    w = F.col("w")
    moved = [rounded(F.first(f"p_{x}") + F.sum(w * (F.col(f"q_{x}") - F.col(f"p_{x}"))) / F.sum(w), 6).alias(x) for x in "lab"]
    return _near(spark, sf).groupBy("target_id").agg(*moved)


@query("catalog", "targets", sql=_KNN + """SELECT target_id, kind, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY target_id ORDER BY v DESC, kind) AS j FROM (SELECT target_id, kind, COUNT(*) AS n, SUM(w) AS v FROM near GROUP BY ALL)) WHERE j = 1""")
def knn_vote(spark: SparkSession, sf: str) -> DataFrame:
    """The kind with the heaviest vote among the 15 nearest codes."""
    votes = _near(spark, sf).groupBy("target_id", "kind").agg(F.count("*").alias("n"), F.sum("w").alias("v"))
    return votes.groupBy("target_id").agg(F.min(F.struct((-F.col("v")).alias("_v"), "kind", "n")).alias("m")).select("target_id", "m.kind", "m.n")


# The measured colour of each code: its catalogue colour, off by a little that depends on the code.
_SEEN = {"r": "(r + code_id % 23) % 256", "g": "(g + code_id % 17) % 256", "b": "(b + code_id % 31) % 256"}
_SEEN_SQL = f"(SELECT code_id, m_l, m_a, m_b, c_l, c_a, c_b FROM {color.nest(color.nest('catalog', _C), color.lab_steps(*(f'({x})' for x in _SEEN.values()), 'm'))})"


@query("catalog", sql=f""", seen AS MATERIALIZED {_SEEN_SQL}, near AS (SELECT * FROM (SELECT p.code_id, p.m_l AS p_l, p.m_a AS p_a, p.m_b AS p_b, p.c_l, p.c_a, p.c_b, q.c_l - q.m_l AS r_l, q.c_a - q.m_a AS r_a, q.c_b - q.m_b AS r_b,
    (p.m_l - q.m_l) * (p.m_l - q.m_l) + (p.m_a - q.m_a) * (p.m_a - q.m_a) + (p.m_b - q.m_b) * (p.m_b - q.m_b) AS dd, ROW_NUMBER() OVER (PARTITION BY p.code_id ORDER BY dd, q.code_id) AS k FROM seen p JOIN seen q ON p.code_id <> q.code_id WHERE p.code_id % 5 = 1) WHERE k <= 12),
fitted AS (SELECT code_id, ANY_VALUE(c_l) AS c_l, ANY_VALUE(c_a) AS c_a, ANY_VALUE(c_b) AS c_b, {', '.join(f'ANY_VALUE(p_{x}) AS p_{x}, ANY_VALUE(p_{x}) + SUM(EXP(-dd / 100) * r_{x}) / (SUM(EXP(-dd / 100)) + 1) AS f_{x}' for x in 'lab')} FROM near GROUP BY code_id)
SELECT COUNT(*) AS n, {half_up('AVG(SQRT((p_l - c_l) * (p_l - c_l) + (p_a - c_a) * (p_a - c_a) + (p_b - c_b) * (p_b - c_b)))', 6)} AS as_seen, {half_up('AVG(SQRT((f_l - c_l) * (f_l - c_l) + (f_a - c_a) * (f_a - c_a) + (f_b - c_b) * (f_b - c_b)))', 6)} AS fitted FROM fitted""")
def colour_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue colours predicted from the measured one and the residuals of its twelve nearest, each fifth code left out.

    The mean difference of the measured colours themselves and of the predicted ones (a stated test set: every fifth row).
    """
    seen = color.add(color.add(T.catalog(spark, sf), _C, ["c_l", "c_a", "c_b"]), color.lab_steps(*(f"({x})" for x in _SEEN.values()), "m"), ["m_l", "m_a", "m_b"])
    asked = seen.where("code_id % 5 = 1").select("code_id", *(F.col(f"c_{x}") for x in "lab"), *(F.col(f"m_{x}").alias(f"p_{x}") for x in "lab"))
    model = seen.select(F.col("code_id").alias("model_id"), *(F.col(f"m_{x}").alias(f"q_{x}") for x in "lab"), *((F.col(f"c_{x}") - F.col(f"m_{x}")).alias(f"r_{x}") for x in "lab"))
    gaps = [F.col(f"p_{x}") - F.col(f"q_{x}") for x in "lab"]
    # one more than wanted, since each finds itself
    near = L.nearest_in_space(asked, model, gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2], [(f"p_{x}", f"q_{x}") for x in "lab"], 13, "code_id", "model_id").where("code_id <> model_id")
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("code_id").orderBy("distance", "model_id"))).where("k <= 12").withColumn("w", F.exp(-F.col("distance") / 100))
    fitted = near.groupBy("code_id").agg(*(F.first(f"{s}_{x}").alias(f"{s}_{x}") for s in "cp" for x in "lab"), *((F.first(f"p_{x}") + F.sum(F.col("w") * F.col(f"r_{x}")) / (F.sum("w") + 1)).alias(f"f_{x}") for x in "lab"))
    off = lambda s: F.sqrt(sum(((F.col(f"{s}_{x}") - F.col(f"c_{x}")) * (F.col(f"{s}_{x}") - F.col(f"c_{x}")) for x in "ab"), (F.col(f"{s}_l") - F.col("c_l")) * (F.col(f"{s}_l") - F.col("c_l"))))
    return fitted.agg(F.count("*").alias("n"), rounded(F.avg(off("p")), 6).alias("as_seen"), rounded(F.avg(off("f")), 6).alias("fitted"))


_START, _LEFT = 20, 11
_DROPS = [
    f"""ranked_{k} AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY target_id ORDER BY cost, code_id) AS j FROM cost WHERE code_id IN (SELECT code_id FROM set_{k})),
price_{k} AS MATERIALIZED (SELECT s.code_id, COALESCE(SUM(a.records), 0) AS records, COALESCE(SUM(a.weight * CASE WHEN b.code_id IS NULL THEN CAST(10000 AS DOUBLE) ELSE b.de * b.de - a.de * a.de + CASE WHEN b.code_mm < a.code_mm - CAST(0.000001 AS DOUBLE) THEN 625 ELSE 0 END END), 0) AS price
  FROM set_{k} s LEFT JOIN ranked_{k} a ON a.j = 1 AND a.code_id = s.code_id LEFT JOIN ranked_{k} b ON b.j = 2 AND b.target_id = a.target_id GROUP BY s.code_id),
gone_{k} AS MATERIALIZED (SELECT * FROM price_{k} WHERE (SELECT COUNT(*) FROM set_{k}) > {_LEFT} ORDER BY price, code_id LIMIT 1),
set_{k + 1} AS MATERIALIZED (SELECT code_id FROM set_{k} WHERE code_id NOT IN (SELECT code_id FROM gone_{k}))"""
    for k in range(_START - _LEFT)
]
_ALIKE = ["layer", "want_mm", "FLOOR(p_l + CAST(0.5 AS DOUBLE))", "FLOOR(p_a + CAST(0.5 AS DOUBLE))", "FLOOR(p_b + CAST(0.5 AS DOUBLE))"]


@query("catalog", "targets", sql=f""", {', '.join(_greedy_steps(_START))}, set_0 AS MATERIALIZED ({' UNION ALL '.join(f'SELECT code_id FROM pick{i} WHERE gain > 0' for i in range(1, _START + 1))}), kinds AS MATERIALIZED (SELECT MIN(target_id) AS target_id, SUM(weight) AS weight, COUNT(*) AS records FROM {_TARGET_SQL} GROUP BY {', '.join(_ALIKE)}),
cost AS MATERIALIZED (SELECT * FROM (SELECT target_id, code_id, code_mm, de, {_COST} AS cost FROM {_PAIR_SQL.replace('CROSS JOIN', 'SEMI JOIN kinds USING (target_id) CROSS JOIN')} WHERE code_id IN (SELECT code_id FROM set_0)) JOIN kinds k USING (target_id) WHERE cost IS NOT NULL), {', '.join(_DROPS)}
{' UNION ALL '.join(f"SELECT CAST({k + 1} AS INTEGER) AS step, code_id AS removed, CAST(records AS BIGINT) AS records, {half_up('price', 4)} AS price FROM gone_{k}" for k in range(_START - _LEFT))}""")
def palette_drops(spark: SparkSession, sf: str) -> DataFrame:
    """A palette of 20 codes, chosen one by one as each saves most, brought down to 11: each step with the code dropped and the records it moves."""
    targets = color.add(T.targets(spark, sf).withColumn("want_mm", F.col("phys_mm")), color.lab_steps("r", "g", "b", "p"), ["p_l", "p_a", "p_b"])
    kinds = P.alike(targets.select("target_id", "layer", "weight", "want_mm", *(F.floor(F.col(f"p_{x}") + F.lit(0.5)).alias(x) for x in "lab")), ["layer", "want_mm", "l", "a", "b"])
    chosen = [c for c, _ in P.greedy(_costs(spark, sf), T.targets(spark, sf), _START)]
    start = T.catalog(spark, sf).where(F.col("code_id").isin(chosen))
    costs = P.costs(T.targets(spark, sf).join(kinds, "target_id", "left_semi"), start.select("code_id", "r", "g", "b", "kind", "phys_mm"))
    _, history = P.merge_down(costs, kinds, start, _LEFT)
    return spark.createDataFrame([(i + 1, *h) for i, h in enumerate(history)], "step int, removed long, records long, price double").withColumn("price", rounded(F.col("price"), 4))


_DRAWN = {c: f"({c} + target_id % {n}) % 256" for c, n in zip("rgb", (19, 29, 13))}
#: Codes of the product that a palette starts from, and codes that may be added.
_BASE, _MORE = 5, 3


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Targets with the colour wanted and, off by a little that depends on the target, the one drawn."""
    rows = color.add(T.targets(spark, sf), color.lab_steps("r", "g", "b", "t"), ["t_l", "t_a", "t_b"])
    rows = color.add(rows, color.lab_steps(*(f"({x})" for x in _DRAWN.values()), "i"), ["i_l", "i_a", "i_b"])
    return rows.select(F.col("target_id").alias("item"), F.col("phys_mm").alias("mm"), F.col("weight").cast("double").alias("weight"), *(f"{p}_{x}" for p in "ti" for x in "lab"))


def _offered(spark: SparkSession, sf: str) -> tuple[DataFrame, list[int]]:
    """Active codes with their colours, and the dearest ones among them."""
    codes = color.add(T.catalog(spark, sf).where("active"), _C, ["c_l", "c_a", "c_b"]).select("code_id", F.col("phys_mm").alias("mm"), "c_l", "c_a", "c_b")
    dear = codes.join(T.read(spark, sf, "part").select(F.col("p_partkey").alias("code_id"), "p_retailprice"), "code_id").orderBy(F.desc("p_retailprice"), "code_id").limit(_BASE)
    return codes, [r["code_id"] for r in dear.select("code_id").collect()]


_FIT_SQL = f""", codes AS MATERIALIZED (SELECT code_id, phys_mm AS code_mm, c_l, c_a, c_b FROM {color.nest('catalog', _C)} WHERE active),
items AS MATERIALIZED (SELECT target_id AS item, phys_mm AS mm, weight, t_l, t_a, t_b, i_l, i_a, i_b FROM {color.nest(color.nest('targets', color.lab_steps('r', 'g', 'b', 't')), color.lab_steps(*(f'({x})' for x in _DRAWN.values()), 'i'))}),
base AS MATERIALIZED (SELECT c.code_id, ROW_NUMBER() OVER (ORDER BY p_retailprice DESC, c.code_id) AS place FROM codes c JOIN part ON p_partkey = c.code_id QUALIFY place <= {_BASE}),
"""
_FITS_SQL = f"code_mm <= mm + {color.d(1e-6)}"


def _target_sql() -> str:
    steps = [
        f"pairs AS MATERIALIZED (SELECT item, code_id, {color.de76('t', 'c')} AS de, {_FITS_SQL} AS fits, {color.de76('t', 'c')} + 2 * (mm - code_mm) AS cost FROM items CROSS JOIN codes)",
        "now0 AS MATERIALIZED (SELECT item, LEAST(COALESCE(MIN(cost) FILTER (WHERE fits AND code_id IN (SELECT code_id FROM base)), 1000), 1000) AS now FROM pairs GROUP BY item)",
        "palette0 AS MATERIALIZED (SELECT * FROM base)",
    ]
    for i in range(1, _MORE + 1):
        steps += [
            f"pick{i} AS MATERIALIZED (SELECT code_id, SUM(now - cost) AS gain FROM pairs JOIN now{i - 1} USING (item) WHERE fits AND cost < now GROUP BY code_id ORDER BY {half_up('gain', 9)} DESC, code_id LIMIT 1)",
            f"now{i} AS MATERIALIZED (SELECT item, LEAST(now, COALESCE(cost, now)) AS now FROM now{i - 1} LEFT JOIN (SELECT item, cost FROM pairs SEMI JOIN pick{i} USING (code_id) WHERE fits) USING (item))",
            f"palette{i} AS MATERIALIZED (SELECT * FROM palette{i - 1} UNION ALL SELECT code_id, {_BASE + i} FROM pick{i})",
        ]
    picked = f"(SELECT item, code_id, CASE WHEN fits THEN cost ELSE de END AS price, ROW_NUMBER() OVER (PARTITION BY item ORDER BY fits DESC, price, place) AS k FROM pairs JOIN palette{_MORE} USING (code_id))"
    return _FIT_SQL + ", ".join(steps) + f" SELECT item AS target_id, code_id, {half_up('price', 6)} AS price FROM {picked} WHERE k = 1"


@query("catalog", "targets", sql=_target_sql())
def fitted_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of targets out of a palette of five that was given three more, whatever saves most on the colours wanted."""
    (codes, base), items = _offered(spark, sf), _items(spark, sf)
    found = fit.fit_targets(items, codes, base, _MORE)[1].join(items, "item").join(codes.select("code_id", F.struct("mm", "c_l", "c_a", "c_b").alias("c")), "code_id")
    price = F.when(F.expr(fit.FITS), F.expr(fit.COST)).otherwise(F.expr(fit.WANTED))
    return found.select(F.col("item").alias("target_id"), "code_id", rounded(price, 6).alias("price"))


def _image_sql() -> str:
    dark = f"i_l < {color.d(fit.DARK)}"
    steps = [
        f"pairs AS MATERIALIZED (SELECT item, code_id, i_l, weight * CASE WHEN {dark} THEN 3 ELSE 1 END AS w, {color.de76('i', 'c')} AS apart, {color.de76('t', 'c')} + 2 * (mm - code_mm) AS cost, {_FITS_SQL} AS fits, {B.hue_fits('i', 'c')} AS hue FROM items CROSS JOIN codes)",
        "nearest AS MATERIALIZED (SELECT item, MIN(apart) AS nearest FROM pairs WHERE fits GROUP BY item)",
        f"suited AS MATERIALIZED (SELECT p.item, code_id, w, apart, cost FROM pairs p JOIN nearest USING (item) WHERE fits AND hue AND apart <= nearest + {color.d(fit.GATE)})",
        f"total AS MATERIALIZED (SELECT SUM(weight * CASE WHEN {dark} THEN 3 ELSE 1 END) AS total FROM items)",
        f"support AS MATERIALIZED (SELECT code_id FROM suited GROUP BY code_id HAVING SUM(w) / (SELECT CAST(total AS DOUBLE) FROM total) >= {color.d(fit.SUPPORT)})",
        "palette0 AS MATERIALIZED (SELECT * FROM base)",
    ]
    for i in range(_MORE + 1):
        if i:
            only = f"(NOT (SELECT reserve FROM dark_ones) OR {dark})" if i == 1 else "TRUE"
            steps += [
                f"pick{i} AS MATERIALIZED (SELECT code_id, SUM(CASE WHEN apart < now AND {only} THEN w * (now - apart) ELSE 0 END) AS gain FROM suited JOIN now{i - 1} USING (item) SEMI JOIN support USING (code_id) ANTI JOIN palette{i - 1} USING (code_id) GROUP BY code_id HAVING gain > 0 ORDER BY {half_up('gain', 9)} DESC, code_id LIMIT 1)",
                f"palette{i} AS MATERIALIZED (SELECT * FROM palette{i - 1} UNION ALL SELECT code_id, {_BASE + i} FROM pick{i})",
            ]
        steps.append(f"now{i} AS MATERIALIZED (SELECT item, i_l, LEAST(COALESCE(MIN(s.apart), 100), 100) AS now FROM items LEFT JOIN (SELECT item, apart FROM suited SEMI JOIN palette{i} USING (code_id)) s USING (item) GROUP BY ALL)")
        if not i:
            steps.append(f"dark_ones AS MATERIALIZED (SELECT COUNT(*) FILTER (WHERE {dark} AND now >= 100) >= {fit.DARK_ITEMS} AS reserve FROM now0)")
    steps += [
        f"pool AS (SELECT item, ARG_MIN(code_id, (cost, place)) AS code_id FROM suited JOIN palette{_MORE} USING (code_id) JOIN (SELECT item, now FROM now{_MORE}) USING (item) WHERE apart <= now + {color.d(fit.GATE)} GROUP BY item)",
        f"others AS (SELECT item, ARG_MIN(code_id, (NOT fits, cost, place)) AS free, ARG_MIN(code_id, (NOT fits, apart, place)) AS near FROM pairs JOIN palette{_MORE} USING (code_id) GROUP BY item)",
    ]
    return _FIT_SQL + ", ".join(steps) + " SELECT item AS target_id, COALESCE(p.code_id, near) AS code_id, CASE WHEN p.code_id IS NULL THEN 'unsuited' WHEN p.code_id <> free THEN 'gated' ELSE 'suited' END AS how FROM others LEFT JOIN pool p USING (item)"


@query("catalog", "targets", sql=_image_sql())
def fitted_image(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the colours drawn: codes have to suit in hue and size, dark items count more and may call for one of their own."""
    codes, base = _offered(spark, sf)
    return fit.fit_image(_items(spark, sf), codes, base, _MORE)[1].withColumnRenamed("item", "target_id")


# Stones that a task counts at a time, about (a design is not split).
_DEALT = 1 << 18
# A code's material, and the sides of its outline by shape.
_WIDTH = "phys_mm * CASE shape WHEN 'marquise' THEN CAST(0.5 AS DOUBLE) WHEN 'teardrop' THEN CAST(0.75 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END"
_MATERIAL = "CASE WHEN kind = 'pearl' THEN 'pearl' WHEN lower(series) LIKE '%brass%' OR lower(series) LIKE '%copper%' THEN 'gold' WHEN code_id % 9 = 0 THEN 'facet' ELSE 'base' END"
_MET = color.nest("(SELECT w.design_id, w.code_id, w.shape AS ws, w.mm AS wm, w.w_mm AS ww, w.material AS wk, w.l AS p_l, w.a AS p_a, w.b AS p_b, c.code_id AS to_code, c.shape AS cs, c.mm AS cm, c.w_mm AS cw, c.material AS ck, c.l AS q_l, c.a AS q_a, c.b AS q_b FROM asked w JOIN pool c USING (design_id) WHERE NOT w.inside)", color.de2000_steps("p", "q"))


@query("catalog", "stones", sql=f""", entry AS MATERIALIZED (SELECT code_id, shape, phys_mm AS mm, {_WIDTH} AS w_mm, {_MATERIAL} AS material, c_l AS l, c_a AS a, c_b AS b FROM {color.nest('catalog', _C)}),
used AS MATERIALIZED (SELECT design_id, code_id, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY COUNT(*) DESC, code_id) AS k FROM stones GROUP BY design_id, code_id),
pool AS MATERIALIZED (SELECT design_id, e.* FROM used JOIN entry e USING (code_id) WHERE k <= 12),
asked AS MATERIALIZED (SELECT design_id, n, k <= 12 AS inside, e.* FROM used JOIN entry e USING (code_id) WHERE e.mm >= 4),
priced AS (SELECT *, CASE WHEN ws = 'round' THEN CASE WHEN cs <> 'round' THEN NULL WHEN cm = wm AND ck = wk THEN de WHEN cm < wm AND (ck = 'pearl') = (wk = 'pearl') THEN de + 20 + 2 * (wm - cm)
    WHEN ck = 'pearl' AND wk <> 'gold' AND cm <= wm AND p_l >= 70 AND p_a * p_a + p_b * p_b <= 225 THEN de + 12 END
  WHEN cs = 'round' THEN CASE WHEN wm <= 8 AND cm >= 4 AND cm <= ww + 1 AND (ck = 'pearl') = (wk = 'pearl') THEN de + 40 END
  WHEN cs = ws AND cm <= wm THEN de + 100 * ABS(LN(cm / wm)) END AS cost FROM {_MET}),
best AS (SELECT design_id, code_id, to_code, cost FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id, code_id ORDER BY cost, to_code) AS j FROM priced WHERE cost IS NOT NULL AND de <= 20 AND (cs <> 'round' OR cm >= 4)) WHERE j = 1)
SELECT a.design_id, a.code_id, a.n AS stones, CASE WHEN inside THEN a.code_id ELSE to_code END AS to_code, CASE WHEN inside THEN 'kept' WHEN to_code IS NULL THEN 'no-class' WHEN shape = 'round' THEN 'smaller' ELSE 'shape-size' END AS why,
  CASE WHEN inside THEN 0 ELSE {half_up('cost', 6)} END AS cost FROM asked a LEFT JOIN best USING (design_id, code_id)""")
def remapped_large(spark: SparkSession, sf: str) -> DataFrame:
    """The codes of a design's large stones brought into its twelve commonest codes: kept, replaced or without one of their class."""
    entry = color.add(T.catalog(spark, sf), _C, ["c_l", "c_a", "c_b"]).select("code_id", "shape", F.col("phys_mm").alias("mm"), F.expr(_WIDTH).alias("w_mm"), F.col("phys_mm").alias("h_mm"), F.expr(_MATERIAL).alias("material"), *(F.col(f"c_{c}").alias(f"lab_{c}") for c in "lab"))
    # few codes occur twice in a design, so stones are dealt before they are counted: a task counts and ranks _DEALT of them, however many there are
    stones = T.stones(spark, sf).select("design_id", "code_id")
    dealt = stones.repartition(-(-stones.count() // _DEALT) or 1, "design_id")
    used = dealt.groupBy("design_id", "code_id").agg(F.count("*").alias("stones"))
    used = used.withColumn("k", F.row_number().over(Window.partitionBy("design_id").orderBy(F.desc("stones"), "code_id"))).join(entry.hint("shuffle_hash"), "code_id")
    found = P.remap(used.where("mm >= 4").drop("k"), used.where("k <= 12").drop("k", "stones"), ["design_id"])
    return found.select("design_id", "code_id", "to_code", "why", rounded(F.col("cost"), 6).alias("cost"), "stones")
