"""Queries on records beside designs: scores, runs, ledgers, markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapidary.functions.numeric import half_up, rounded
from lapidary.operators import learn as L
from lapidary.plans.registry import Registry
from lapidary.sources import markup as M
from lapidary.sources import tables as T
from lapidary.streaming import ledger

query = Registry()


@query(sql=f"""WITH ranked AS (SELECT lang, quality, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS k FROM documents JOIN labels USING (doc_id)),
sums AS (SELECT lang, SUM(k) FILTER (WHERE quality = 1) AS s, COUNT(*) FILTER (WHERE quality = 1) AS pos, COUNT(*) FILTER (WHERE quality = 0) AS neg FROM ranked GROUP BY lang)
SELECT lang, pos, neg, CASE WHEN pos > 0 AND neg > 0 THEN {half_up('(s - CAST(pos * (pos + 1) AS DOUBLE) / 2) / (CAST(pos AS DOUBLE) * neg)', 9)} END AS auc FROM sums""")
def rank_auc(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.read(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(T.read(spark, sf, "labels"), "doc_id")
    return L.rank_auc(rows, "n_chars", "quality", "doc_id", ["lang"]).withColumn("auc", rounded(F.col("auc"), 9))


@query(sql=f"""SELECT lang, n_both AS both, {half_up('CASE WHEN a + b - n_both > 0 THEN n_both / CAST(a + b - n_both AS DOUBLE) END', 9)} AS iou, {half_up('CASE WHEN a > 0 THEN n_both / CAST(a AS DOUBLE) END', 9)} AS precision, {half_up('CASE WHEN b > 0 THEN n_both / CAST(b AS DOUBLE) END', 9)} AS recall
FROM (SELECT lang, COUNT(*) FILTER (WHERE n_chars >= 1500 AND quality = 1) AS n_both, COUNT(*) FILTER (WHERE n_chars >= 1500) AS a, COUNT(*) FILTER (WHERE quality = 1) AS b FROM documents JOIN labels USING (doc_id) GROUP BY lang)""")
def mask_iou(spark: SparkSession, sf: str) -> DataFrame:
    """Long texts as a prediction of good ones."""
    rows = T.read(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(T.read(spark, sf, "labels"), "doc_id")
    found = L.overlap_scores(rows, F.col("n_chars") >= 1500, F.col("quality") == 1, ["lang"])
    return found.select("lang", "both", *(rounded(F.col(c), 9).alias(c) for c in ("iou", "precision", "recall")))


@query(sql="""SELECT lang, source, quality, COUNT(*) AS n, CAST(GROUPING(lang, source, quality) AS INTEGER) AS level FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), (quality), (lang, quality))""")
def label_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.read(spark, sf, "documents").select("doc_id", "lang", "source").join(T.read(spark, sf, "labels"), "doc_id")
    sets = rows.groupingSets([("lang",), ("source",), ("quality",), ("lang", "quality")], "lang", "source", "quality")
    return sets.agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


@query("stones", sql=f"""SELECT size_class, layer, n, {half_up('(n + 1) / CAST(SUM(n) OVER (PARTITION BY size_class) + 3 AS DOUBLE)', 9)} AS prior FROM (SELECT size_class, layer, COUNT(*) AS n FROM stones GROUP BY ALL)""")
def size_bin_prior(spark: SparkSession, sf: str) -> DataFrame:
    """How likely a layer is for a size, with one pseudo-stone a layer."""
    n = T.stones(spark, sf).groupBy("size_class", "layer").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("size_class"))
    return n.withColumn("prior", rounded((F.col("n") + 1) / (whole + 3), 9))


@query(sql="""WITH marked AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new_run FROM events),
runs AS (SELECT *, SUM(new_run) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, COUNT(*) AS length FROM runs GROUP BY user_id, run, event_type""")
def rle_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of equal event types of each user, in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = T.read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    rows = rows.withColumn("_new", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(order)) | (F.row_number().over(order) == 1)).cast("long"))
    return rows.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "run", "event_type").agg(F.count("*").alias("length"))


@query(sql=r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS place, links[i] AS href FROM (SELECT page_id, links, unnest(range(1, len(links) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages))""")
def html_attr_extract(spark: SparkSession, sf: str) -> DataFrame:
    return M.attributes(T.read(spark, sf, "pages"), "html", "href").select("page_id", "place", F.col("value").alias("href"))


@query(sql=f"""WITH spent AS (SELECT user_id, event_id, ts, value, SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase')
SELECT user_id, event_id, CAST(n AS INTEGER) AS n, {half_up('total', 4)} AS spent, total > 200 AS over_cap FROM spent""")
def ledger_spend(spark: SparkSession, sf: str) -> DataFrame:
    """Running spend of each user and where it passes a cap."""
    return ledger.running(T.read(spark, sf, "events").where("event_type = 'purchase'"), "user_id", ["ts", "event_id"], "value", 200.0).select("user_id", "event_id", "n", rounded(F.col("spent"), 4).alias("spent"), "over_cap")


@query(sql=f"""SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'click') AS sent, COUNT(*) FILTER (WHERE event_type = 'purchase') AS done, COUNT(*) FILTER (WHERE event_type = 'error') AS failed, {half_up("COALESCE(SUM(value) FILTER (WHERE event_type = 'purchase'), 0)", 4)} AS usd FROM events GROUP BY user_id""")
def ledger_usage(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.usage(T.read(spark, sf, "events"), "user_id", "event_type", "value").withColumn("usd", rounded(F.col("usd"), 4))


@query("stones", sql="""SELECT design_id, stone_id, 'K_' || CAST(code_id AS VARCHAR) || '_S' || regexp_replace(CAST(phys_mm AS VARCHAR), '\\.0$', '') AS grp, phys_mm AS size_back FROM stones""".replace("\\\\", "\\"))
def group_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Group names of stones, and the size read back from them."""
    name = M.group_name(F.col("code_id").cast("string"), "phys_mm")
    return T.stones(spark, sf).select("design_id", "stone_id", name.alias("grp")).withColumn("size_back", M.group_size(F.col("grp")))


@query("stones", sql="SELECT design_id, COUNT(*) AS n, COUNT(*) AS same FROM stones GROUP BY design_id")
def svg_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Stones written as SVG and read again: how many come back unchanged."""
    rows = T.stones(spark, sf).select("design_id", "stone_id", "layer", "code_id", "x_mm", "y_mm", "phys_mm")
    back = M.read_svg(M.write_svg(rows, "design_id", T.CANVAS, T.CANVAS), "design_id")
    keys = ["design_id", "stone_id"]
    met = rows.join(back.withColumnsRenamed({c: f"_{c}" for c in back.columns if c not in keys}), keys, "left")
    same = (F.col("layer") == F.col("_layer")) & (F.col("code_id").cast("string") == F.col("_code")) & (F.col("x_mm") == F.col("_x_mm")) & (F.col("y_mm") == F.col("_y_mm")) & (F.col("phys_mm") == F.col("_phys_mm"))
    return met.groupBy("design_id").agg(F.count("*").alias("n"), F.count_if(same).alias("same"))
