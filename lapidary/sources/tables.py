"""Domain views of the star-schema tables: designs of placed stones, a catalogue, target colours.

One design per supplier, on a canvas of ``CANVAS`` mm; a line item is a stone, a part is a catalogue entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CANVAS = 300.0
LAYERS = ("bg", "costume", "pet")
#: Physical sizes in mm, by size class.
SIZES = (2.8, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0)
SHAPES = ("round", "marquise", "teardrop", "heart")
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """design_id, stone_id, layer, layer_rank, code_id, x_mm, y_mm, size_class, phys_mm, locked."""
    rows = read(spark, sf_dir, "lineitem")
    k, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber").cast("long")
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    size = F.pmod(F.col("l_quantity").cast("long"), F.lit(7)).cast("int")
    return rows.select(
        F.col("l_suppkey").alias("design_id"),
        F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*_LINE)).cast("long").alias("stone_id"),
        F.element_at(F.array(*map(F.lit, LAYERS)), rank + 1).alias("layer"),
        rank.alias("layer_rank"),
        p.alias("code_id"),
        (((k * 7919 + p * 104729 + n * 1299709) % 3000).cast("double") / 10.0).alias("x_mm"),
        (((k * 15485863 + p * 32452843 + n * 49979687) % 3000).cast("double") / 10.0).alias("y_mm"),
        size.alias("size_class"),
        F.element_at(F.array(*map(F.lit, SIZES)), size + 1).alias("phys_mm"),
        (F.col("l_linestatus") == "O").alias("locked"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code_id, code, series, family_name, kind, shape, active, r, g, b, hex, size_class, phys_mm."""
    p = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(
        p.alias("code_id"),
        F.col("p_type").alias("series"),
        F.col("p_brand").alias("family_name"),
        F.when(p % 10 == 0, "pearl").otherwise("stone").alias("kind"),
        F.element_at(F.array(*map(F.lit, SHAPES)), F.when(p % 5 == 0, (p / 5).cast("long") % 4).otherwise(0).cast("int") + 1).alias("shape"),
        (p % 7 != 3).alias("active"),
        ((p * 73 + 11) % 256).cast("int").alias("r"),
        ((p * 151 + 47) % 256).cast("int").alias("g"),
        ((p * 199 + 101) % 256).cast("int").alias("b"),
        (F.col("p_size") % 7).cast("int").alias("size_class"),
    )
    return rows.select(
        "*",
        F.concat(F.when(F.col("kind") == "pearl", "P").otherwise("S"), F.col("code_id").cast("string")).alias("code"),
        F.concat(F.lit("#"), *(F.lpad(F.hex(c), 2, "0") for c in "rgb")).alias("hex"),
        F.element_at(F.array(*map(F.lit, SIZES)), F.col("size_class") + 1).alias("phys_mm"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target_id, layer, r, g, b, phys_mm, weight: colours to be met, one per supplier."""
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        s.alias("target_id"),
        F.element_at(F.array(*map(F.lit, LAYERS)), (s % 3).cast("int") + 1).alias("layer"),
        ((s * 37 + 5) % 256).cast("int").alias("r"),
        ((s * 91 + 13) % 256).cast("int").alias("g"),
        ((s * 157 + 29) % 256).cast("int").alias("b"),
        F.element_at(F.array(*map(F.lit, SIZES)), (F.col("s_nationkey") % 7).cast("int") + 1).alias("phys_mm"),
        (s % 4 + 1).cast("long").alias("weight"),
    )


#: What a segmenter would measure of each stone, over the columns of ``stones``.
BEAD = {
    "d_mm": "phys_mm * (CAST(85 + stone_id % 31 AS DOUBLE) / CAST(100 AS DOUBLE))",
    "lab_l": "CAST((code_id * 37 + stone_id * 11) % 101 AS DOUBLE)",
    "lab_a": "CAST((code_id * 53 + stone_id * 3) % 121 - 60 AS DOUBLE)",
    "lab_b": "CAST((code_id * 71 + stone_id * 5) % 121 - 60 AS DOUBLE)",
    "sat": "CAST((code_id * 13 + stone_id * 7) % 256 AS DOUBLE)",
    "edge": "CAST(stone_id % 11 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "solidity": "CAST(80 + stone_id % 20 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "ell_iou": "CAST(70 + stone_id % 30 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "filled": "CAST(80 + stone_id % 21 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "score": "CAST((stone_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)",
    "shape": "CASE WHEN stone_id % 13 = 0 THEN 'heart' WHEN stone_id % 17 = 0 THEN 'marquise' WHEN stone_id % 7 = 0 THEN 'oval' ELSE 'round' END",
}


def beads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stones`` with what is measured of each."""
    return stones(spark, sf_dir).withColumns({c: F.expr(x) for c, x in BEAD.items()})


_SIZE_SQL = "CASE {0} WHEN 0 THEN CAST(2.8 AS DOUBLE) WHEN 1 THEN CAST(4 AS DOUBLE) WHEN 2 THEN CAST(5 AS DOUBLE) WHEN 3 THEN CAST(6 AS DOUBLE) WHEN 4 THEN CAST(7 AS DOUBLE) WHEN 5 THEN CAST(8 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END"
_LAYER_SQL = "CASE {0} WHEN 0 THEN 'bg' WHEN 1 THEN 'costume' ELSE 'pet' END"

#: The same views for a SQL engine that has the tables: common table expressions.
SQL = {
    "stones": f"""stones AS (SELECT *, {_LAYER_SQL.format("layer_rank")} AS layer, {_SIZE_SQL.format("size_class")} AS phys_mm FROM (
  SELECT l_suppkey AS design_id,
    CAST(ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(_LINE)}) AS BIGINT) AS stone_id,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS layer_rank, l_partkey AS code_id,
    CAST((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709) % 3000 AS DOUBLE) / CAST(10 AS DOUBLE) AS x_mm,
    CAST((l_orderkey * 15485863 + l_partkey * 32452843 + l_linenumber * 49979687) % 3000 AS DOUBLE) / CAST(10 AS DOUBLE) AS y_mm,
    CAST(CAST(l_quantity AS BIGINT) % 7 AS INTEGER) AS size_class, l_linestatus = 'O' AS locked FROM lineitem))""",
    "catalog": f"""catalog AS (SELECT *, CASE WHEN kind = 'pearl' THEN 'P' ELSE 'S' END || CAST(code_id AS VARCHAR) AS code,
  {_SIZE_SQL.format("size_class")} AS phys_mm,
  '#' || printf('%02X%02X%02X', r, g, b) AS hex FROM (
  SELECT p_partkey AS code_id, p_type AS series, p_brand AS family_name, CASE WHEN p_partkey % 10 = 0 THEN 'pearl' ELSE 'stone' END AS kind,
    CASE WHEN p_partkey % 5 = 0 THEN CASE (p_partkey // 5) % 4 WHEN 0 THEN 'round' WHEN 1 THEN 'marquise' WHEN 2 THEN 'teardrop' ELSE 'heart' END ELSE 'round' END AS shape,
    p_partkey % 7 <> 3 AS active, CAST((p_partkey * 73 + 11) % 256 AS INTEGER) AS r, CAST((p_partkey * 151 + 47) % 256 AS INTEGER) AS g,
    CAST((p_partkey * 199 + 101) % 256 AS INTEGER) AS b, CAST(p_size % 7 AS INTEGER) AS size_class FROM part))""",
    "targets": f"""targets AS (SELECT s_suppkey AS target_id, {_LAYER_SQL.format("s_suppkey % 3")} AS layer,
  CAST((s_suppkey * 37 + 5) % 256 AS INTEGER) AS r, CAST((s_suppkey * 91 + 13) % 256 AS INTEGER) AS g, CAST((s_suppkey * 157 + 29) % 256 AS INTEGER) AS b,
  {_SIZE_SQL.format("s_nationkey % 7")} AS phys_mm, CAST(s_suppkey % 4 + 1 AS BIGINT) AS weight FROM supplier)""",
    "beads": f"""beads AS (SELECT *, {", ".join(f"{x} AS {c}" for c, x in BEAD.items())} FROM stones)""",
}
