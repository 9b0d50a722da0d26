"""Relational rules on designs: counts, bills of material, symbols, validation, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters for stones, in the order in which they are given out.
LETTERS = "ABCEFGJKNPRTUVY"
SPARE = 1.1
CODE_TARGET, CODE_LIMIT = 13, 15


def counts(stones: DataFrame, key: str = "design_id") -> DataFrame:
    """Totals by (layer, code), layer, code and design, as grouping sets; ``level`` names the set."""
    sets = stones.groupingSets([(F.col(key), F.col("layer"), F.col("code_id")), (F.col(key), F.col("layer")), (F.col(key), F.col("code_id")), (F.col(key),)], key, "layer", "code_id")
    level = F.grouping_id()
    return sets.agg(F.count("*").alias("n"), level.alias("_g")).select(key, "layer", "code_id", "n", F.element_at(F.array(*map(F.lit, ("layer_code", "layer", "code", "design"))), (F.col("_g") % 4 + 1).cast("int")).alias("level"))


def bill(stones: DataFrame, catalog: DataFrame, key: str = "design_id") -> DataFrame:
    """Stones of each code by layer, in all and with a tenth to spare, with the catalogue's colour and size."""
    rows = stones.groupBy(key, "code_id").pivot("layer", ["bg", "costume", "pet"]).count()
    rows = rows.select(key, "code_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("bg", "costume", "pet")))
    total = F.col("bg") + F.col("costume") + F.col("pet")
    rows = rows.withColumn("total", total).withColumn("with_spare", F.ceil(F.col("total") * F.lit(SPARE)).cast("long"))
    return rows.join(catalog.select("code_id", "code", "series", "kind", "shape", "hex", "phys_mm"), "code_id", "left")


def coverage(stones: DataFrame, area: float, key: str = "design_id") -> DataFrame:
    disc = F.lit(3.141592653589793) * (F.col("phys_mm") / 2) * (F.col("phys_mm") / 2)
    return stones.groupBy(key).agg(F.count("*").alias("n_stones"), F.count_distinct("code_id").alias("n_codes"), (F.sum(disc) / F.lit(area)).alias("coverage"))


def symbols(stones: DataFrame, catalog: DataFrame, key: str = "design_id") -> DataFrame:
    """A symbol for each code of a design: pearls their size, stones letters, the commonest first, then pairs of letters."""
    n = stones.groupBy(key, "code_id").agg(F.count("*").alias("n")).join(catalog.select("code_id", "kind", "phys_mm"), "code_id")
    place = F.row_number().over(Window.partitionBy(key, "kind").orderBy(F.desc("n"), "code_id")) - 1
    letters = F.array(*map(F.lit, LETTERS))
    k = len(LETTERS)
    second = F.col("place") - k
    letter = F.when(F.col("place") < k, F.get(letters, F.col("place"))).when(second < k * k, F.concat(F.get(letters, F.floor(second / k).cast("int")), F.get(letters, F.pmod(second, F.lit(k)))))
    return n.withColumn("place", place).select(key, "code_id", "n", "kind", F.when(F.col("kind") == "pearl", size_label("phys_mm")).otherwise(letter).alias("symbol"))


def size_label(column: str) -> Column:
    """A size as people write it: 5, not 5.0."""
    return F.regexp_replace(F.col(column).cast("string"), r"\.0$", "")


def symbol_faults(symbols: DataFrame, key: str = "design_id") -> DataFrame:
    """Codes without a symbol, symbols used twice, stones' symbols that are no single letter of the set."""
    used = F.count("symbol").over(Window.partitionBy(key, "symbol"))
    fault = (
        F.when(F.col("symbol").isNull(), "missing")
        .when(F.col("uses") > 1, "repeated")
        .when((F.col("kind") == "stone") & ~F.col("symbol").rlike("^[A-Z]$"), "not_one_letter")
        .when((F.col("kind") == "stone") & ~F.col("symbol").rlike(f"^[{LETTERS}]$"), "outside_set")
    )
    return symbols.withColumn("uses", used).withColumn("fault", fault).where(F.col("fault").isNotNull()).drop("uses")


def validate(stones: DataFrame, width: float, height: float, key: str = "design_id") -> DataFrame:
    """One row per rule that a design breaks: rule, how many stones, the smallest id."""
    again = F.count("*").over(Window.partitionBy(key, "stone_id"))
    rules = {
        "unknown_layer": ~F.coalesce(F.col("layer").isin("bg", "costume", "pet"), F.lit(False)),
        "repeated_id": F.col("_again") > 1,
        "no_code": F.col("code_id").isNull(),
        "not_a_number": F.col("x_mm").isNull() | F.col("y_mm").isNull() | F.isnan("x_mm") | F.isnan("y_mm"),
        "size": ~F.coalesce(F.col("phys_mm") > 0, F.lit(False)),
        "no_lock": F.col("locked").isNull(),
        "outside": F.coalesce((F.col("x_mm") < 0) | (F.col("y_mm") < 0) | (F.col("x_mm") > width) | (F.col("y_mm") > height), F.lit(False)),
    }
    broken = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return stones.withColumn("_again", again).select(key, "stone_id", F.explode(broken).alias("rule")).groupBy(key, "rule").agg(F.count("*").alias("n"), F.min("stone_id").alias("first_id"))


def diff(a: DataFrame, b: DataFrame, tolerance: float, numbers: list[str], others: list[str], keys: list[str]) -> DataFrame:
    """Rows of a and b by key: missing (only in a), extra (only in b), or changed, with the changed columns."""
    left = a.select(*keys, F.struct(*numbers, *others).alias("_a"))
    right = b.select(*keys, F.struct(*numbers, *others).alias("_b"))
    # two missing numbers differ, as no comparison with them holds
    near = lambda c: F.coalesce(F.abs(F.col(f"_a.{c}") - F.col(f"_b.{c}")) <= tolerance, F.lit(False))
    changed = F.array_compact(F.array(*(F.when(~near(c), F.lit(c)) for c in numbers), *(F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in others)))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.size("changed") > 0, "changed")
    both = left.join(right, keys, "full_outer").withColumn("changed", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), changed))
    return both.withColumn("state", state).where(F.col("state").isNotNull()).select(*keys, "state", F.array_join("changed", ",").alias("changed"))


def against_bill(stones: DataFrame, expected: DataFrame, key: str = "design_id") -> DataFrame:
    """Codes whose number of stones differs from an expected bill (key, code_id, expected)."""
    have = stones.groupBy(key, "code_id").agg(F.count("*").alias("placed"))
    rows = have.join(expected, [key, "code_id"], "full_outer").select(key, "code_id", F.coalesce("placed", F.lit(0)).alias("placed"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return rows.where("placed <> expected")


def catalog_faults(stones: DataFrame, catalog: DataFrame, key: str = "design_id") -> DataFrame:
    """Stones whose code is unknown, no longer made, or of another size, by design, code and fault."""
    known = catalog.select("code_id", "active", F.col("phys_mm").alias("_size"))
    rows = stones.join(known, "code_id", "left")
    faults = F.when(F.col("active").isNull(), F.array(F.lit("unknown"))).otherwise(F.array_compact(F.array(F.when(~F.col("active"), F.lit("inactive")), F.when(F.abs(F.col("_size") - F.col("phys_mm")) >= 1e-6, F.lit("size")))))
    return rows.select(key, "code_id", F.explode(faults).alias("fault")).groupBy(key, "code_id", "fault").agg(F.count("*").alias("n"))


def code_count(stones: DataFrame, key: str = "design_id") -> DataFrame:
    n = F.count_distinct("code_id")
    return stones.groupBy(key).agg(n.alias("codes")).withColumn("level", F.when(F.col("codes") > CODE_LIMIT, "error").when(F.col("codes") > CODE_TARGET, "warn").otherwise("pass"))


def commonest(stones: DataFrame, most: int, key: str = "design_id") -> DataFrame:
    """The most frequent codes of each design, at most so many."""
    n = stones.groupBy(key, "code_id").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "code_id"))).where(F.col("place") <= most)


def reading_order(stones: DataFrame, pitch: float, key: str = "design_id") -> DataFrame:
    """Ids P00001... by size (large first), row of ``pitch``, then place in the row."""
    row = F.floor(F.col("y_mm") / pitch + 0.5)
    order = Window.partitionBy(key).orderBy(F.desc("phys_mm"), row, "x_mm", "stone_id")
    return stones.select(key, "stone_id", F.format_string("P%05d", F.row_number().over(order)).alias("label"))


def mode_share(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value of each group (ties: the smallest) and its share."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = n.groupBy(*keys).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("_n"), value)).alias("_best"))
    return best.select(*keys, F.col(f"_best.{value}").alias(value), (-F.col("_best._n")).alias("n"), (-F.col("_best._n") / F.col("total")).alias("share"))


def bill_csv(bill: DataFrame, key: str = "design_id") -> DataFrame:
    """One row per line of a design's CSV: header, codes in order, total. Cells are quoted where needed."""

    def cell(c: Column) -> Column:
        s = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    numbers = ["bg", "costume", "pet", "total", "with_spare"]
    lines = bill.select(key, F.lit(1).alias("part"), "code_id", F.concat_ws(",", *(cell(F.col(c)) for c in ["code", "series", "kind", "shape", "hex", *numbers])).alias("line"))
    sums = bill.groupBy(key).agg(F.count("*").alias("codes"), *(F.sum(c).alias(c) for c in numbers))
    total = sums.select(key, F.lit(2).alias("part"), F.lit(None).cast("long").alias("code_id"), F.concat_ws(",", F.lit("TOTAL"), F.concat(F.col("codes").cast("string"), F.lit(" codes")), F.lit(""), F.lit(""), F.lit(""), *(F.col(c).cast("string") for c in numbers)).alias("line"))
    head = sums.select(key, F.lit(0).alias("part"), F.lit(None).cast("long").alias("code_id"), F.lit("code,series,kind,shape,hex," + ",".join(numbers)).alias("line"))
    rows = head.unionByName(lines).unionByName(total)
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("part", "code_id")).alias("row"), "line")
