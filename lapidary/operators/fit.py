"""Fitting a palette to a product: a few codes more, and a code for each item.

Items (item, mm, weight; t_l, t_a, t_b: the colour wanted; i_l, i_a, i_b: the colour in the picture) and codes (code_id, mm,
c_l, c_a, c_b) meet by cells of the colour space, each item as far as a code could still matter to it, so no row stands for
an item and a code that are far apart. A palette is what a product is made of, a few dozen codes at most: it goes along as
one array in the plan, and items are judged against it without a join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.functions import beads as B
from lapidary.functions import color
from lapidary.functions.color import d
from lapidary.functions.numeric import rounded
from lapidary.operators.spatial import stored

# Price of a millimetre too small, room above the nearest code, share that a new code has to suit.
PER_MM, GATE, SUPPORT = 2.0, 12.0, 0.02
#: Darkness, what it counts, items that call for a dark code; what an item without a code misses, and a target.
DARK, DARK_TIMES, DARK_ITEMS = 25.0, 3.0, 5
MISSING, UNMET = 100.0, 1000.0
#: Codes that a palette may have.
MOST = 256
FITS = f"(c.mm <= mm + {d(1e-6)})"
ALIKE, WANTED = color.de76("i", "c.c"), color.de76("t", "c.c")
COST = f"({WANTED} + {d(PER_MM)} * (mm - c.mm))"
SUITS = f"({FITS} AND {B.hue_fits('i', 'c.c')} AND {ALIKE} <= nearest + {d(GATE)})"


def _palette(codes: DataFrame, chosen: list[int]) -> Column:
    """Codes in their order, as an array in the plan."""
    rows = {r["code_id"]: r for r in codes.where(F.col("code_id").isin(chosen)).collect()}
    items = [rows[c] for c in dict.fromkeys(chosen) if c in rows]
    if not 0 < len(items) <= MOST:
        raise ValueError(f"a palette has 1 to {MOST} codes, not {len(items)}")
    return F.array(*(F.struct(F.lit(i).alias("place"), F.lit(r["code_id"]).cast("long").alias("code_id"), *(F.lit(float(r[c])).alias(c) for c in ("mm", "c_l", "c_a", "c_b"))) for i, r in enumerate(items)))


def _offers(codes: DataFrame) -> DataFrame:
    """The smallest of the codes that are alike in size and colour: the others suit the same items, and lose the tie."""
    return stored(codes.groupBy("mm", "c_l", "c_a", "c_b").agg(F.min("code_id").alias("code_id")), "offers")


def near_codes(items: DataFrame, codes: DataFrame, prefix: str, reach: Column) -> DataFrame:
    """Pairs of an item and a code that fits it (item's columns, ``c``) whose colours are at most ``reach`` apart.

    Items meet codes on a grid as wide as the power of two above their reach, in 27 cells.
    """
    lab = [f"{prefix}_{x}" for x in "lab"]
    asked = items.withColumn("_reach", reach).where("_reach >= 0").withColumn("_grid", F.ceil(F.log2(F.greatest("_reach", F.lit(1.0)))).cast("int"))
    grids = [r[0] for r in asked.select("_grid").distinct().collect()]
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    wide = F.pow(F.lit(2.0), F.col("_grid"))
    for c, x in zip(lab, "lab"):
        asked = asked.withColumn("_step", F.explode(around)).withColumn(f"_{x}", F.floor(F.col(c) / wide) + F.col("_step")).drop("_step")
    offered = codes.select(F.struct("code_id", F.col("mm").cast("double").alias("mm"), "c_l", "c_a", "c_b").alias("c")).withColumn("_grid", F.explode(F.array(*map(F.lit, grids)).cast("array<int>")))
    offered = offered.withColumns({f"_{x}": F.floor(F.col(f"c.c_{x}") / wide) for x in "lab"})
    # 27 cells an item, which no estimate sees
    met = asked.hint("merge").join(offered, ["_grid", "_l", "_a", "_b"]).where(F.expr(FITS) & (F.expr(color.de76(prefix, "c.c")) <= F.col("_reach")))
    return met.select(*items.columns, "c")


def with_nearest(items: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds ``nearest``, the difference of the picture's colour to the nearest code that fits (null: none), by growing rings."""
    rest, found, reach = stored(items, "items"), None, 8.0
    # no two colours of the space are further apart than this
    while reach <= 512:
        met = near_codes(rest, codes, "i", F.lit(reach)).groupBy("item").agg(F.min(F.expr(ALIKE)).alias("nearest"))
        hit = stored(rest.join(met, "item"), "nearest")
        found = hit if found is None else found.unionByName(hit)
        rest = stored(rest.join(hit.select("item"), "item", "left_anti"), "rest")
        if rest.isEmpty():
            return found
        reach *= 2
    return found.unionByName(rest.withColumn("nearest", F.lit(None).cast("double")))


def _chosen(pairs: DataFrame, gain: Column, more: list[Column], having: Column) -> list:
    """The code of the largest gain (equal to nine digits: the smallest code), as a list of one row or none."""
    rows = pairs.groupBy("c.code_id").agg(F.sum(gain).alias("gain"), *more).where((F.col("gain") > 0) & having)
    return rows.orderBy(F.desc(rounded(F.col("gain"), 9)), "code_id").limit(1).collect()


def _least(where: str, key: str) -> str:
    """Of the palette's codes that hold ``where`` the first with the least ``key``; null if there is none."""
    return f"array_min(transform(filter(palette, c -> {where}), c -> struct({key} AS key, c.place AS place, c.code_id AS code_id)))"


def fit_targets(items: DataFrame, codes: DataFrame, base: Iterable[int], most: int = 2) -> tuple[list[tuple[int, float]], DataFrame]:
    """Codes added to ``base``, each with what it saves on the wanted colours, and items with their code.

    An item pays its difference and ``PER_MM`` for each millimetre that a code is smaller; larger ones do not fit. Up to
    ``most`` codes are added, at each step the one that saves most. Items that no code fits take the nearest colour. Without
    a code in ``base`` every item may meet every code, and does.
    """
    base, added = list(base), []
    rows = stored(items, "items")
    known = [r[0] for r in codes.where(F.col("code_id").isin(base)).select("code_id").collect()]
    now = F.expr(f"array_min(transform(filter(palette, c -> {FITS}), c -> {COST}))")
    priced = rows.withColumn("palette", _palette(codes, base)).withColumn("now", F.least(F.coalesce(now, F.lit(UNMET)), F.lit(UNMET))).drop("palette") if known else rows.withColumn("now", F.lit(UNMET))
    # what costs no less than now can save nothing
    pairs = near_codes(stored(priced, "priced"), _offers(codes), "t", F.col("now")).withColumn("cost", F.expr(COST)).where("cost < now").select("item", "now", "c", "cost")
    pairs = stored(pairs, "pairs")
    for _ in range(most):
        best = _chosen(pairs, F.col("now") - F.col("cost"), [], F.lit(True))
        if not best:
            break
        added.append((best[0]["code_id"], best[0]["gain"]))
        paid = pairs.where(F.col("c.code_id") == added[-1][0]).select("item", F.col("cost").alias("paid"))
        pairs = stored(pairs.join(paid, "item", "left").withColumn("now", F.least("now", "paid")).drop("paid").where("cost < now"), "pairs")
    own = rows.withColumn("palette", _palette(codes, base + [c for c, _ in added]))
    found = own.withColumn("m", F.coalesce(F.expr(_least(FITS, COST)), F.expr(_least("true", WANTED))))
    return added, found.select("item", "m.code_id")


def fit_image(items: DataFrame, codes: DataFrame, base: Iterable[int], most: int = 2) -> tuple[list[tuple[int, float, float]], DataFrame]:
    """Codes added to ``base`` for the picture's colours, each with gain and support, and items with code and ``how``.

    A code suits an item if it is no larger, of a hue that may stand for the picture's, and within ``GATE`` of the nearest
    code there is. A code added has to suit ``SUPPORT`` of the weight, dark items counting ``DARK_TIMES``; the one that
    brings the picture nearest is taken. If many dark items have no code and two may be added, the first is chosen for
    dark ones alone. Items take the cheapest by wanted colour of the suitable codes near the picture (``gated``, if another
    one had been cheaper), or else the code nearest the picture (``unsuited``).
    """
    base, added = list(base), []
    dark = F.col("i_l") < DARK
    offers = _offers(codes)
    rows = with_nearest(items, offers).withColumn("weighed", F.col("weight") * F.when(dark, DARK_TIMES).otherwise(1.0))
    known = [r[0] for r in codes.where(F.col("code_id").isin(base)).select("code_id").collect()]
    near = F.expr(f"array_min(transform(filter(palette, c -> {SUITS}), c -> {ALIKE}))")
    now = lambda t: t.withColumn("now", F.least(F.coalesce(near, F.lit(MISSING)), F.lit(MISSING)))
    rows = stored(now(rows.withColumn("palette", _palette(codes, base))).drop("palette") if known else rows.withColumn("now", F.lit(MISSING)), "items")
    total, missing = rows.agg(F.sum("weighed"), F.count_if(dark & (F.col("now") >= MISSING))).first()
    reserve = missing >= DARK_ITEMS and most >= 2
    pairs = near_codes(rows, offers, "i", F.col("nearest") + F.lit(GATE)).where(F.expr(SUITS)).withColumn("apart", F.expr(ALIKE)).where(~F.col("c.code_id").isin(base))
    pairs = stored(pairs.select("item", "i_l", "weighed", "now", "c", "apart"), "pairs")
    for n in range(most):
        gain = F.when((F.col("apart") < F.col("now")) & (dark if reserve and n == 0 else F.lit(True)), F.col("weighed") * (F.col("now") - F.col("apart"))).otherwise(0.0)
        best = _chosen(pairs.where(~F.col("c.code_id").isin([c for c, *_ in added])), gain, [(F.sum("weighed") / F.lit(total or 1.0)).alias("support")], F.col("support") >= SUPPORT)
        if not best:
            break
        added.append((best[0]["code_id"], best[0]["gain"] / (total or 1.0), best[0]["support"]))
        taken = pairs.where(F.col("c.code_id") == added[-1][0]).select("item", F.col("apart").alias("taken"))
        # codes keep the rows that bring no more gain: their support counts all that they suit
        pairs = stored(pairs.join(taken, "item", "left").withColumn("now", F.least("now", "taken")).drop("taken"), "pairs")
    own = now(rows.drop("now").withColumn("palette", _palette(codes, base + [c for c, *_ in added])))
    pool = F.expr(_least(f"{SUITS} AND {ALIKE} <= now + {d(GATE)}", COST))
    free = F.coalesce(F.expr(_least(FITS, COST)), F.expr(_least("true", COST)))
    nearest = F.coalesce(F.expr(_least(FITS, ALIKE)), F.expr(_least("true", ALIKE)))
    found = own.withColumns({"pool": pool, "free": free, "close": nearest})
    how = F.when(F.col("pool").isNull(), "unsuited").when(F.col("pool.code_id") != F.col("free.code_id"), "gated").otherwise("suited")
    return added, found.select("item", F.coalesce("pool.code_id", "close.code_id").alias("code_id"), how.alias("how"))
