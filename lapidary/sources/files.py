"""Reference files as sources and sinks, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE_MAP = "physical_mm double, reference_mm double, status string, rule string, notes string"
BILL = "product string, code string, symbol string, symbol_kind string, physical_mm double, reference_mm double, count int, in_catalog int, catalog_hex string, svg_fill_hex string, spec_symbol_ok int"
REGION = "format string, regions array<struct<id:string,polygon:array<struct<x:double,y:double>>,holes:array<array<struct<x:double,y:double>>>,material:string,physMm:double,code:string>>"
REF_GAP = 0.8


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header; a byte order mark at the start of the file is dropped."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True, encoding="UTF-8")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or object that may span lines."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """key, value rows of an object; text that is no JSON stays as it is."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    return rows.withColumn("value", F.coalesce(F.to_json(F.try_parse_json("value")), F.col("value")))


def checked(df: DataFrame, expected: str) -> DataFrame:
    """Fails on a document of another format."""
    message = F.concat(F.lit("unknown format: "), F.coalesce(F.col("format"), F.lit("none")))
    return df.withColumn("format", F.when(F.col("format") == expected, F.col("format")).otherwise(F.raise_error(message)))


def reference_size(stones: DataFrame, size_map: DataFrame, column: str = "phys_mm") -> DataFrame:
    """Adds ref_mm: the mapped size, else the size less ``REF_GAP``, to six digits. The map is a dimension of few rows."""
    micro = lambda c: F.floor(F.col(c) * 1e6 + 0.5)
    mapped = size_map.select(micro("physical_mm").alias("_micro"), F.col("reference_mm").alias("_ref")).dropDuplicates(["_micro"])
    return stones.withColumn("_micro", micro(column)).join(mapped, "_micro", "left").withColumn("ref_mm", F.coalesce("_ref", F.floor((F.col(column) - REF_GAP) * 1e6 + 0.5) / 1e6)).drop("_micro", "_ref")


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Insert-or-ignore: of rows with one key, the first in order."""
    best = df.groupBy(key).agg(F.min(F.struct(order, F.struct(*df.columns).alias("row"))).alias("_m"))
    return best.select("_m.row.*")


def content_version(df: DataFrame, order: str) -> Column:
    """An aggregate: a short hash of all rows in order."""
    return F.concat(F.lit("cat-"), F.substring(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.to_json(F.struct(*df.columns)).alias("j")))), lambda s: s["j"]), "\n")), 1, 12))


def write_tables(tables: dict[str, DataFrame], folder: str, partition: dict[str, str] | None = None) -> None:
    for name, df in tables.items():
        out = df.write.mode("overwrite")
        (out.partitionBy(partition[name]) if partition and name in partition else out).parquet(f"{folder}/{name}")
