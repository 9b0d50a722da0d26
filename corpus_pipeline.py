"""A corpus pipeline: language ID, line dedup, n-gram near-duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Rows with
null or repeated ids, empty and null texts pass through as the stages' operators define.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.llm import langid, linededup
from lapidary.llm.mixing import mix_sources
from lapidary.llm.ngramjoin import ngram_join, text_key
from lapidary.llm.packing import pack
from lapidary.llm.store import shared_folder

#: Row keys up to this many (16 MB) may be broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def _met(docs: DataFrame, key: Column, rows: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of the documents with rows (id, key), null ids included; ``key`` is of the document's row."""
    keyed = docs.withColumn("_row_key", key)
    rows = rows.select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_KEYS else rows.hint("merge")
    return keyed.join(rows, keyed["doc_id"].cast("long").eqNullSafe(rows["_id"]) & (keyed["_row_key"] == rows["_key"]), how).select(*docs.columns)


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the column ``lang`` counts as declaration, ``source`` as host."""
    found = langid.identify(langid.document_evidence(docs, langid.train(docs)))
    gone = _stored(found.where(~F.col("accepted")).select("id", "key").distinct(), "gone")
    return _met(docs, langid.row_key(F.col("text"), F.col("lang"), F.col("source")), gone, "left_anti")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand in an earlier one."""
    kept = linededup.dedup(docs, linededup.insert(linededup.empty_index(spark), docs), whole=True)
    sized = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return kept.withColumns(sized).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: one of the smallest id, a null id before all others."""
    found = ngram_join(docs, keep=True).groupBy(F.col("doc_id").alias("id"), F.col("row_key").alias("key")).agg(F.count("*").alias("rows"), F.first("kept").alias("kept"), F.first("worded").alias("worded"))
    found = _stored(found.where("not kept or (rows > 1 and worded)"), "verdicts")
    key = text_key(F.col("text"))
    repeated = found.where("kept").select("id", "key")
    # rows of the same id and text: one of them, where they stand for their group
    once = _met(docs, key, repeated, "left_semi").withColumn("_row_key", key).groupBy("doc_id", "_row_key").agg(F.first(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return _met(docs, key, found, "left_anti").unionByName(once)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, a part of a time by the hash of its row."""
    mix = mix_sources(docs)[0].where("size > 0").groupBy("doc_id", "key").agg(F.avg(F.col("taken") / F.col("size")).alias("times"))
    chance = F.pmod(F.xxhash64(F.lit("part"), "key"), F.lit(1 << 20)) / float(1 << 20)
    # as doubles, a whole number of times is exact
    mix = mix.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.floor(F.col("times") + chance).cast("int").alias("_copies")).where("_copies > 0")
    keyed = docs.withColumn("_row_key", F.xxhash64(F.lit(17), "doc_id", F.col("text").cast("string")))
    met = keyed.join(mix.hint("merge"), keyed["doc_id"].eqNullSafe(mix["_id"]) & (keyed["_row_key"] == mix["_key"]))
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a document that the mix repeats is packed as often."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Language models, MinHash and permutations have no form in SQL; the stages' operators are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
