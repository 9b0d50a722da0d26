"""Mixing sources to target weights, with built-in functions only.

Each source's words are packed into blocks of ``block`` words, documents laid end to end. The targets fix how many blocks
each source gives (its slots). First every output shard of ``shard_slots`` slots draws how many it takes of each source: all
slots are dealt to shards by a pseudorandom permutation, so that the counts are multinomial draws given the totals. Then
the shards' counts, laid end to end by source, number the slots: slot t of a source with n blocks takes block P(t mod n),
where P is a pseudorandom permutation of 0..n-1, another one for each pass over the source. Blocks and slots are joined by
(source, block).

Permutations are swap-or-not networks (Hoang, Morris and Rogaway, 2012): each round pairs x with key - x modulo n and
swaps the pair or not by one hash bit, a bijection of any range that needs no sort and no table. Everything follows from
the documents and ``seed``, so reruns agree.

Scale: a document's place in its source is a two-level sum, over twice as many buckets as the root of the rows and within
one bucket of a source, and so is a shard's place among a source's slots; a source with a third of all rows is never in one
task. Slots are made by many tasks and counted by (shard, source) and (source, block) before they meet anything. What one
task sorts whole is one row a source, and one row a source and bucket.

Results by definition: null texts have no words, take none and keep their row; sources are in code point order, a null
source last, and form one source; equal rows are separate documents; an empty table gives no rows; other columns are
ignored. A source's taken words differ from its target by a block at most.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.llm.store import shared_folder

SHARD_SPAN = 4096
BLOCK = 64
SHARD_SLOTS = 8192
ROUNDS = 20
WEIGHTS = (1.0, 2.0, 3.0)
MAX_PASSES = 3
WORD = r"[^\x20\x09-\x0D]+"


def permuted(x: Column, n: Column, *keys: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 at x, chosen by the keys."""

    def swap(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit("key"), r, *keys), n) - at, n)
        high = F.greatest(at, partner)
        return F.when(F.xxhash64(F.lit("bit"), r, high, *keys).bitwiseAND(F.lit(1)) == 1, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), swap)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = MAX_PASSES) -> DataFrame:
    """Adds rank, weight and target to one row per source (source, source_size), by rank in order of source.

    Targets share the sum of all sizes by weight and stop at ``limit`` times their source's size, the excess reshared by
    weight: target = min(limit * size, level * weight), with the level at which the targets make up the sum. Sources stop
    in order of size / weight, so the level follows from running sums.
    """
    order = Window.orderBy("source")
    given = F.array(*map(F.lit, weights))
    rows = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", F.element_at(given, (F.col("rank") % len(weights) + 1).cast("int")))
    stop = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    most = F.lit(limit) * F.col("source_size")
    rows = (
        rows.withColumn("sum_before", F.coalesce(F.sum(most).over(stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_from", F.sum("weight").over(stop.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all_words", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("all_words") - F.col("sum_before")) / F.col("weight_from"))
        # the first source that keeps below its stop fixes the level
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= most, F.struct(F.col("source_size") / F.col("weight"), F.col("rank"), F.col("level").alias("level")))).over(whole)["level"])
    )
    target = F.coalesce(F.least(most.cast("double"), F.col("level") * F.col("weight")), most.cast("double"))
    return rows.select("source", "source_size", "rank", "weight", target.alias("target"))


def _before(rows: DataFrame, keys: list[str], part: str, order: str, value: str, name: str) -> DataFrame:
    """Adds, per keys, the sum of ``value`` over the rows before each in (part, order): parts are summed first."""
    sums = rows.groupBy(*keys, part).agg(F.sum(value).alias("_part_sum"))
    parts = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, part, F.coalesce(F.sum("_part_sum").over(parts), F.lit(0)).alias("_part_start"))
    within = Window.partitionBy(*keys, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inner", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, [*keys, part])
    return placed.withColumn(name, F.col("_part_start") + F.col("_inner")).drop("_part_start", "_inner")


def _runs(first: Column, n: Column, span: int = 4096) -> Column:
    """0, span, 2 span ... below n, so that a long range is made by many tasks."""
    return F.explode(F.sequence(first, n - 1, F.lit(span).cast("long")))


def draw_counts(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 17, tasks: int = 8) -> DataFrame:
    """(shard, rank, n): how many slots each output shard takes of each source, multinomial given the sources' totals.

    ``sources``: rows (rank, slots, slots_before, all_slots).
    """
    span = 4096
    runs = sources.where("slots > 0").select("rank", "slots", "slots_before", "all_slots", _runs(F.lit(0).cast("long"), F.col("slots"), span).alias("first")).repartition(tasks, "rank", "first")
    slots = runs.select("rank", "slots_before", "all_slots", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + span, F.col("slots")) - 1)).alias("t"))
    dealt = permuted(F.col("slots_before") + F.col("t"), F.col("all_slots"), F.lit(seed))
    return slots.groupBy(F.floor(dealt / shard_slots).cast("long").alias("shard"), "rank").agg(F.count("*").alias("n"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(documents, mix). Writes one row a document, without its text, and the shards' counts under spark.checkpoint.dir.

    Documents: doc_id, source, size, source_size, target, taken (words that the mix takes, repeats counted), key (of the
    row). Mix: rows (shard, place, source, rank, block): output shard, place in it, and the block.
    """
    named = F.col(source_col).cast("string")
    # a name without nulls that sorts by code point, the null source last
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(named.isNull(), "1").otherwise(F.concat(F.lit("0"), named)).alias("source"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"))
    # sizes are counted once; what follows reads this small table
    spark, path = docs.sparkSession, shared_folder(docs.sparkSession, "mixing")
    rows.write.parquet(f"{path}/sizes")
    rows = spark.read.parquet(f"{path}/sizes")
    buckets = 1 + isqrt(4 * rows.count())  # so that neither the buckets nor the rows of one are many
    rows = rows.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    sources = targets(parts.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights)
    n = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    sources = sources.withColumn("blocks", n).withColumn("slots", F.when(n > 0, F.floor(F.col("target") * n / F.col("source_size") + 0.5)).otherwise(0).cast("long"))
    running = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("slots_before", F.coalesce(F.sum("slots").over(running), F.lit(0))).withColumn("all_slots", F.sum("slots").over(Window.partitionBy()))

    draw_counts(sources, shard_slots, seed, tasks).write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts").withColumn("span", F.floor(F.col("shard") / SHARD_SPAN))
    counts = _before(counts, ["rank"], "span", "shard", "n", "start").join(sources.select("rank", "source", "blocks"), "rank")
    inner = Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(inner), F.lit(0))).withColumn("held", F.sum("n").over(Window.partitionBy("shard")))
    slots = counts.repartition(tasks, "shard", "rank").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).withColumn("t", F.col("start") + F.col("i"))
    chosen = permuted(F.pmod("t", F.col("blocks")), F.col("blocks"), F.lit(seed), F.col("rank"), F.floor(F.col("t") / F.col("blocks")))
    place = permuted(F.col("ahead") + F.col("i"), F.col("held"), F.lit(seed), F.col("shard"))
    slots = slots.select("shard", place.alias("place"), "source", "rank", chosen.alias("block"))
    name = F.when(F.col("source") != "1", F.substring("source", 2, 2**31 - 1))
    mix = slots.select("shard", "place", name.alias("source"), "rank", "block")

    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner_start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    known = parts.join(sources, "source").select("source", "bucket", "bucket_start", "rank", "source_size", "target")
    placed = placed.join(known, ["source", "bucket"]).select("doc_id", "source", "rank", "size", "source_size", "target", "key", (F.col("bucket_start") + F.col("inner_start")).alias("start"))
    uses = slots.groupBy("rank", "block").agg(F.count("*").alias("times")).hint("merge")  # its size is underestimated
    ends = placed.withColumn("stop", F.col("start") + F.col("size"))
    pieces = ends.where("size > 0").select("rank", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))).alias("block"))
    words = F.least("stop", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    taken = pieces.join(uses, ["rank", "block"]).groupBy("rank", "start").agg(F.sum(words * F.col("times")).alias("taken"))
    # documents without words share their start with the next one, and take nothing
    out = placed.join(taken, ["rank", "start"], "left").select("doc_id", name.alias("source"), "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"), "key", "rank", "start")
    return out, mix
