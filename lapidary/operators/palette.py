"""Choosing codes for target colours: costs, evaluation, greedy choice with swaps, merging, nearest codes.

Records are first grouped to (kind of record, weight). A cost table has one row per (record, code) with a finite cost; all
choices are aggregates over it, the driver's loops running over codes chosen, never over records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lapidary.functions import color
from lapidary.operators import spatial

UNCOVERED = 1000.0
SHRINK, SHRINK_PER_MM, CROSS = 20.0, 2.0, 12.0
DOWN = 25.0
#: What a record costs that no code is left for, when codes are dropped.
LEFT_OVER = 1e4
MAX_CODES = 11
#: Targets and codes that meet in one task at a time, and targets whose differences are held at once.
BLOCKS, SLICE = (256, 2048), 64
#: Pairs of a code and one of its pool that are priced at once.
PAIRS = 1 << 16
Judge = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame]


def looks(catalog: DataFrame) -> DataFrame:
    """Codes that look alike (colour, kind and size) as their smallest code_id, with their number ``codes``.

    Such codes cost every target the same, and ties go to the smallest code, so choices may be made among these.
    """
    return catalog.groupBy("r", "g", "b", "kind", "phys_mm").agg(F.min("code_id").alias("code_id"), F.count("*").alias("codes"))


def meet(targets: DataFrame, catalog: DataFrame, judge: Judge, schema: str) -> DataFrame:
    """``judge`` on every block of targets (target_id, r, g, b, phys_mm) with every block of codes (code_id, kind, codes too).

    A judge gets up to ``SLICE`` targets, a block's codes in order of code_id and the matrix of their differences; what it
    returns has the columns of ``schema``. Targets are copied once a block of codes and codes once a block of targets, so
    no row for a pair is shuffled, and a task holds two blocks whatever the tables' sizes.
    """
    wide = catalog if "codes" in catalog.columns else catalog.withColumn("codes", F.lit(1))
    left = color.add(targets, color.lab_steps("r", "g", "b", "p"), ["p_l", "p_a", "p_b"]).select("target_id", F.col("phys_mm").cast("double").alias("want_mm"), "p_l", "p_a", "p_b")
    right = color.add(wide, color.lab_steps("r", "g", "b", "q"), ["q_l", "q_a", "q_b"]).select("code_id", "kind", "codes", F.col("phys_mm").cast("double").alias("code_mm"), "q_l", "q_a", "q_b")
    n_left, n_right = (-(-rows.count() // size) or 1 for rows, size in zip((targets, catalog), BLOCKS))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = left.withColumn("_t", block("target_id", n_left)).withColumn("_c", every(n_right))
    right = right.withColumn("_c", block("code_id", n_right)).withColumn("_t", every(n_left))
    names = [c.split()[0] for c in schema.split(", ")]

    def judged(t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(c):
            c = c.sort_values("code_id")
            q = c[["q_l", "q_a", "q_b"]].to_numpy()[None]
            for i in range(0, len(t), SLICE):
                part = t.iloc[i : i + SLICE]
                found.append(judge(part, c, color.de2000_array(part[["p_l", "p_a", "p_b"]].to_numpy()[:, None], q)))
        return pd.concat(found)[names] if found else pd.DataFrame(columns=names)

    return left.groupBy("_t", "_c").cogroup(right.groupBy("_t", "_c")).applyInPandas(judged, schema)


def cost_matrix(t: pd.DataFrame, c: pd.DataFrame, de: np.ndarray) -> np.ndarray:
    """Cost of meeting targets with codes, NaN where it may not be: same size plain, smaller with a penalty, white to pearl."""
    want = t["want_mm"].to_numpy()[:, None]
    smaller, pearl = want - c["code_mm"].to_numpy()[None], (c["kind"] == "pearl").to_numpy()[None]
    white = ((t["p_l"] >= 70) & (np.hypot(t["p_a"], t["p_b"]) <= 15)).to_numpy()[:, None]
    plain = np.where(np.abs(smaller) <= 1e-6, de, np.where(smaller > 0, de + SHRINK + SHRINK_PER_MM * smaller, np.nan))
    return np.where(pearl, np.where(white & (want >= 4) & (smaller >= -1e-6), de + CROSS, np.nan), plain)


def _pairs(t: pd.DataFrame, c: pd.DataFrame, de: np.ndarray) -> pd.DataFrame:
    cost = cost_matrix(t, c, de)
    i, j = np.nonzero(~np.isnan(cost))
    same = (c["kind"] != "pearl").to_numpy()[j] & (np.abs(t["want_mm"].to_numpy()[i] - c["code_mm"].to_numpy()[j]) <= 1e-6)
    return pd.DataFrame({"target_id": t["target_id"].to_numpy()[i], "code_id": c["code_id"].to_numpy()[j], "de": de[i, j], "same": same, "cost": cost[i, j]})


def _least(t: pd.DataFrame, c: pd.DataFrame, de: np.ndarray) -> pd.DataFrame:
    cost = cost_matrix(t, c, de)
    usable = ~np.isnan(cost)
    least = np.where(usable, cost, np.inf).min(axis=1)
    return pd.DataFrame({"target_id": t["target_id"].to_numpy(), "usable": usable @ c["codes"].to_numpy(), "least": np.where(np.isinf(least), np.nan, least)})


def _closest(t: pd.DataFrame, c: pd.DataFrame, de: np.ndarray) -> pd.DataFrame:
    at = de.argmin(axis=1)  # the first, hence the smallest code of equal ones
    return pd.DataFrame({"target_id": t["target_id"].to_numpy(), "code_id": c["code_id"].to_numpy()[at], "de": de[np.arange(len(de)), at]})


def costs(targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """The cost table: target_id, code_id, de, same (a stone of just that size), cost; a row for each pair that may be."""
    return meet(targets, catalog, _pairs, "target_id long, code_id long, de double, same boolean, cost double")


def usable(targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """For each target the number of codes that it may be met with and the least cost (null: none)."""
    found = meet(targets, looks(catalog), _least, "target_id long, usable long, least double")
    least = F.min(F.when(~F.isnan("least"), F.col("least")))
    return found.groupBy("target_id").agg(F.sum("usable").alias("usable"), least.alias("least"))


def nearest(targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """For each target the code of the least difference ``de`` (ties: the smallest), each colour looked at once."""
    key = ["r", "g", "b"]
    codes = catalog.groupBy(*key).agg(F.min("code_id").alias("code_id"), F.lit("").alias("kind"), F.lit(0.0).alias("phys_mm"))
    asked = targets.groupBy(*key).agg(F.min("target_id").alias("target_id"), F.lit(0.0).alias("phys_mm"))
    found = meet(asked, codes, _closest, "target_id long, code_id long, de double").groupBy("target_id").agg(F.min(F.struct("de", "code_id")).alias("m"))
    by_colour = asked.join(found, "target_id").select(*key, "m.code_id", "m.de")
    return targets.select("target_id", *key).join(by_colour, key).select("target_id", "code_id", "de")


def cheapest(costs: DataFrame, keys: list[str]) -> DataFrame:
    """Each record's cheapest code (ties: the smallest) among the rows given."""
    return costs.groupBy(*keys).agg(F.min(F.struct("cost", "code_id")).alias("_b")).select(*keys, F.col("_b.code_id").alias("code_id"), F.col("_b.cost").alias("cost"))


def evaluate(costs: DataFrame, records: DataFrame, codes: DataFrame, uncovered: float = UNCOVERED) -> DataFrame:
    """By layer: stones, uncovered stones and the cost of the records (target_id, layer, weight) under a set of codes."""
    best = cheapest(costs.join(codes, "code_id", "left_semi"), ["target_id"])
    rows = records.select("target_id", "layer", "weight").join(best, "target_id", "left")
    cost = F.coalesce("cost", F.lit(uncovered))
    return rows.groupBy("layer").agg(F.sum("weight").alias("stones"), F.coalesce(F.sum(F.when(F.col("cost").isNull(), F.col("weight"))), F.lit(0)).alias("uncovered"), F.sum(cost * F.col("weight")).alias("cost"))


def greedy(costs: DataFrame, records: DataFrame, most: int, fixed: tuple[int, ...] = (), uncovered: float = UNCOVERED, min_gain: float = 0.0) -> list[tuple[int, float]]:
    """Codes in order of choice, each with what it saves; every round is one aggregate over the cost table."""
    weights = records.select("target_id", "weight")
    costs = costs.select("target_id", "code_id", "cost").join(weights, "target_id").cache()
    chosen: list[tuple[int, float]] = []
    for n in range(most):
        have = [c for c, _ in chosen]
        now = costs.where(F.col("code_id").isin(have)).groupBy("target_id").agg(F.min("cost").alias("now")) if have else None
        left = costs.where(~F.col("code_id").isin(have)) if have else costs
        if n < len(fixed):
            left = left.where(F.col("code_id") == fixed[n])
        rows = left.join(now, "target_id", "left") if now is not None else left.withColumn("now", F.lit(None).cast("double"))
        gain = F.greatest(F.least(F.coalesce("now", F.lit(uncovered)), F.lit(uncovered)) - F.col("cost"), F.lit(0.0)) * F.col("weight")
        best = rows.groupBy("code_id").agg(F.sum(gain).alias("gain")).orderBy(F.desc("gain"), "code_id").limit(1).collect()
        if not best or (n >= len(fixed) and best[0]["gain"] <= min_gain):
            break
        chosen.append((best[0]["code_id"], best[0]["gain"]))
    costs.unpersist()
    return chosen


def swapped(costs: DataFrame, records: DataFrame, codes: list[int], fixed: tuple[int, ...] = (), passes: int = 6, uncovered: float = UNCOVERED) -> list[int]:
    """Improve a set by exchanging one code for another while the total falls.

    A pass goes over the places of the set; each place takes the code that lowers the total most, if one does, before the
    next is looked at. Passes end when one changes nothing, or after ``passes``.

    All exchanges of a set are valued by one aggregate over the cost table: without code a, a record pays its best or, where
    a was its best, its second best; with code j beside, the lesser of that and j's cost. So what j saves in a's place is
    what it saves beside the whole set, and something more from the records whose best is a.
    """
    weights = records.select("target_id", "weight")
    costs = costs.select("target_id", "code_id", F.least("cost", F.lit(uncovered)).alias("cost")).join(weights, "target_id").cache()
    codes = list(codes)

    def exchanges() -> dict[int, tuple[float, int]]:
        """For each code that may go the largest gain and the code (ties: the smallest) that brings it."""
        order = Window.partitionBy("target_id").orderBy("cost", "code_id")
        top = costs.where(F.col("code_id").isin(codes)).withColumn("k", F.row_number().over(order)).where("k <= 2")
        top = top.groupBy("target_id").agg(F.max(F.when(F.col("k") == 1, F.col("code_id"))).alias("best"), F.max(F.when(F.col("k") == 1, F.col("cost"))).alias("c1"), F.max(F.when(F.col("k") == 2, F.col("cost"))).alias("c2"))
        two = weights.join(top, "target_id", "left").select("target_id", "weight", "best", F.coalesce("c1", F.lit(uncovered)).alias("c1"), F.coalesce("c2", F.lit(uncovered)).alias("c2"))
        loss = {r["best"]: r["loss"] for r in two.where("best is not null").groupBy("best").agg(F.sum((F.col("c2") - F.col("c1")) * F.col("weight")).alias("loss")).collect()}
        rows = costs.where(~F.col("code_id").isin(codes)).drop("weight").join(two, "target_id")
        saves = lambda c: F.greatest(F.col(c) - F.col("cost"), F.lit(0.0)) * F.col("weight")
        out = [i for i, c in enumerate(codes) if c not in fixed]
        more = [F.coalesce(F.sum(F.when(F.col("best") == codes[i], saves("c2") - saves("c1"))), F.lit(0.0)).alias(f"more_{i}") for i in out]
        valued = rows.groupBy("code_id").agg(F.sum(saves("c1")).alias("saved"), *more)
        most = valued.agg(F.count("*").alias("n"), *(F.max(F.struct((F.col("saved") + F.col(f"more_{i}")).alias("gain"), (-F.col("code_id")).alias("code"))).alias(f"best_{i}") for i in out)).first()
        return {i: (most[f"best_{i}"]["gain"] - loss.get(codes[i], 0.0), -most[f"best_{i}"]["code"]) for i in out} if most["n"] else {}

    gains = exchanges()
    for _ in range(passes):
        moved = False
        for i in range(len(codes)):
            if i in gains and gains[i][0] > 1e-6:
                codes[i] = gains[i][1]
                gains, moved = exchanges(), True
        if not moved:
            break
    costs.unpersist()
    return codes


def merge(costs: DataFrame, records: DataFrame, most: int, lock: tuple[int, ...] = (), catalog: DataFrame | None = None, penalty: float = DOWN) -> tuple[list[int], list[tuple[int, int, float]]]:
    """Start with each record's cheapest code and merge the pair of codes (a into b) that costs least until ``most`` are left.

    A merge costs the records of a their squared difference to b less that to the code they have now. The difference is
    ``de`` where the costs have it, else the cost. With a catalogue (code_id, kind, shape, phys_mm) records start with the
    cheapest code marked ``same``, if they have one, a merges into codes of its kind (pearl or not) and shape that are no
    larger, a smaller b costs ``penalty`` squared for each stone, and the price grows with the square of a's size. Locked
    codes are never merged into others. Returns codes and the history.

    A price is made of sums over a code's records, and these add up as codes merge. So one aggregate gives all that the
    merges need: for each two codes of the start (a part of the catalogue) the sum of the squared differences.
    """
    measure = "de" if "de" in costs.columns else "cost"
    rank = F.when(F.col("same"), 0).otherwise(1) if "same" in costs.columns else F.lit(0)
    costs = costs.select("target_id", "code_id", "cost", F.col(measure).alias("de"), rank.alias("rank")).join(records.select("target_id", "weight"), "target_id").cache()
    home = costs.groupBy("target_id").agg(F.min(F.struct("rank", "cost", "code_id")).alias("_b")).select("target_id", F.col("_b.code_id").alias("home")).cache()
    used = home.select(F.col("home").alias("code_id")).distinct()
    pairs = home.join(costs.join(used, "code_id", "left_semi"), "target_id").groupBy("home", "code_id").agg(F.count("*").alias("can"), F.sum(F.col("de") * F.col("de") * F.col("weight")).alias("squares"))
    pairs = pairs.toPandas()
    sizes = home.join(records.select("target_id", "weight"), "target_id").groupBy("home").agg(F.count("*").alias("n"), F.sum("weight").alias("stones")).toPandas()
    codes = np.sort(sizes["home"].to_numpy())
    squares, can = np.zeros((len(codes), len(codes))), np.zeros((len(codes), len(codes)), np.int64)
    at = (np.searchsorted(codes, pairs["home"]), np.searchsorted(codes, pairs["code_id"]))
    squares[at], can[at] = pairs["squares"], pairs["can"]
    place = np.searchsorted(codes, sizes["home"])
    n, stones = np.zeros(len(codes), np.int64), np.zeros(len(codes))
    n[place], stones[place] = sizes["n"], sizes["stones"]
    factor, down = np.ones(len(codes)), np.zeros((len(codes), len(codes)))
    fits = ~np.eye(len(codes), dtype=bool)
    if catalog is not None and len(codes):
        known = catalog.join(used, "code_id", "left_semi").select("code_id", (F.col("kind") == "pearl").alias("pearl"), "shape", "phys_mm").toPandas().set_index("code_id").loc[codes]
        pearl, shape, mm = (known[c].to_numpy() for c in ("pearl", "shape", "phys_mm"))
        mm = mm.astype(float)
        fits &= (pearl[:, None] == pearl[None]) & (shape[:, None] == shape[None]) & (mm[None] <= mm[:, None] + 1e-6)
        down = np.where(mm[None] < mm[:, None] - 1e-6, penalty**2, 0.0)
        factor = (mm / 2.8) ** 2
    fits[np.isin(codes, lock)] = False
    live = np.ones(len(codes), bool)

    def row(a: int) -> np.ndarray:
        """Prices of merging code a into each other one."""
        price = factor[a] * (squares[a] - squares[a, a] + down[a] * stones[a])
        return np.where(fits[a] & live & (can[a] == n[a]), price, np.inf)

    prices = np.stack([row(a) for a in range(len(codes))]) if len(codes) else np.zeros((0, 0))
    # the cheapest of each row, so that a merge looks anew only at the rows that it concerns
    least = prices.argmin(axis=1) if len(codes) else np.zeros(0, np.int64)
    history = []
    while live.sum() > most:
        a = int(prices[np.arange(len(codes)), least].argmin())
        b = int(least[a])
        if not np.isfinite(prices[a, b]):
            break
        history.append((int(codes[a]), int(codes[b]), float(prices[a, b])))
        live[a] = False
        squares[b] += squares[a]
        can[b] += can[a]
        n[b] += n[a]
        stones[b] += stones[a]
        prices[a], prices[:, a], prices[b] = np.inf, np.inf, row(b)
        stale = np.flatnonzero((least == a) | (np.arange(len(codes)) == b))
        least[stale] = prices[stale].argmin(axis=1)
    costs.unpersist()
    home.unpersist()
    return [int(c) for c in codes[live]], history


# Fixed values of shaped stones: the longest side of a small one, a round one in its place (price, least size, how much wider), sizes by logarithms.
SMALL_SHAPE, TO_ROUND, ROUND_LEAST, WIDER, SHAPE_SIZE = 8.0, 40.0, 4.0, 1.0, 100.0
# Fixed values of white: lightness at least, chroma at most.
WHITE_L, WHITE_C = 70.0, 15.0


def class_cost(gold_weight: float = 1.0) -> tuple[Column, Column]:
    """What a code costs in a stone's place (null: not allowed) and the colour's part of it, over columns of a pair.

    ``want_`` and ``code_`` material, shape (round or not), mm, w_mm, h_mm; Lab colours p and q; ``de``. Gold may not be
    darker than wanted: what it lacks in lightness counts ``gold_weight`` times beside the difference. A shaped stone
    keeps its shape at its size or smaller; a small one may become a round one of about its width. A round stone has the
    code of its size and material, a smaller one of its kind (pearl or not), or, if white and not small, a white pearl.
    """
    want, code, c = (lambda n: F.col(f"want_{n}")), (lambda n: F.col(f"code_{n}")), F.col
    darker = gold_weight * F.greatest(c("p_l") - c("q_l"), F.lit(0.0))
    de = F.when(want("material") == "gold", F.sqrt(c("de") * c("de") + darker * darker)).otherwise(c("de"))
    kind = (want("material") == "pearl") == (code("material") == "pearl")
    eps = 1e-6
    narrow, long = F.least(want("w_mm"), want("h_mm")), F.greatest(want("w_mm"), want("h_mm"))
    to_round = (code("shape") == "round") & kind & (long <= SMALL_SHAPE) & (code("mm") >= ROUND_LEAST) & (code("mm") <= narrow + WIDER)
    fits = (code("shape") == want("shape")) & (code("w_mm") <= want("w_mm") + eps) & (code("h_mm") <= want("h_mm") + eps)
    exact = (F.abs(code("w_mm") - want("w_mm")) < eps) & (F.abs(code("h_mm") - want("h_mm")) < eps)
    off = (F.abs(F.ln(code("w_mm") / want("w_mm"))) + F.abs(F.ln(code("h_mm") / want("h_mm")))) * (SHAPE_SIZE / 2)
    shaped = F.when(to_round, de + TO_ROUND).when(fits & exact, de).when(fits, de + off)
    white = (c("p_l") >= WHITE_L) & (F.sqrt(c("p_a") * c("p_a") + c("p_b") * c("p_b")) <= WHITE_C)
    own = (F.abs(code("mm") - want("mm")) < eps) & (code("material") == want("material"))
    pearl = (code("material") == "pearl") & (want("material") != "gold") & (want("mm") >= ROUND_LEAST) & (code("mm") <= want("mm") + eps) & white
    smaller = kind & (code("mm") < want("mm") - eps)
    plain = F.when(own, de).when(smaller, de + SHRINK + SHRINK_PER_MM * (want("mm") - code("mm"))).when(pearl, de + CROSS)
    return F.when(want("shape") != "round", shaped).when(code("shape") == "round", plain), de


def class_cost_array(want: dict[str, np.ndarray], code: dict[str, np.ndarray], gold_weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """``class_cost`` of pairs held as arrays, NaN where it is null; colours are compared only where a code is allowed.

    Both sides: mm, w_mm, h_mm, lab (a row a pair), pearl, gold, round, and material and shape as whole numbers (negative: null).
    """
    eps, known = 1e-6, (want["material"] >= 0) & (code["material"] >= 0)
    kind = known & (want["pearl"] == code["pearl"])
    narrow, long = np.minimum(want["w_mm"], want["h_mm"]), np.maximum(want["w_mm"], want["h_mm"])
    to_round = code["round"] & kind & (long <= SMALL_SHAPE) & (code["mm"] >= ROUND_LEAST) & (code["mm"] <= narrow + WIDER)
    fits = (code["shape"] == want["shape"]) & (code["w_mm"] <= want["w_mm"] + eps) & (code["h_mm"] <= want["h_mm"] + eps)
    exact = (np.abs(code["w_mm"] - want["w_mm"]) < eps) & (np.abs(code["h_mm"] - want["h_mm"]) < eps)
    with np.errstate(divide="ignore", invalid="ignore"):
        off = (np.abs(np.log(code["w_mm"] / want["w_mm"])) + np.abs(np.log(code["h_mm"] / want["h_mm"]))) * (SHAPE_SIZE / 2)
    shaped = np.where(to_round, TO_ROUND, np.where(fits & exact, 0.0, np.where(fits, off, np.nan)))
    p_l, p_a, p_b = want["lab"].T
    white = (p_l >= WHITE_L) & (np.sqrt(p_a * p_a + p_b * p_b) <= WHITE_C)
    own = known & (np.abs(code["mm"] - want["mm"]) < eps) & (code["material"] == want["material"])
    pearl = known & code["pearl"] & ~want["gold"] & (want["mm"] >= ROUND_LEAST) & (code["mm"] <= want["mm"] + eps) & white
    smaller = kind & (code["mm"] < want["mm"] - eps)
    plain = np.where(own, 0.0, np.where(smaller, SHRINK + SHRINK_PER_MM * (want["mm"] - code["mm"]), np.where(pearl, CROSS, np.nan)))
    more = np.where((want["shape"] >= 0) & ~want["round"], shaped, np.where(code["round"], plain, np.nan))
    at = np.flatnonzero(~np.isnan(more))
    de = color.de2000_array(want["lab"][at], code["lab"][at])
    darker = gold_weight * np.maximum(want["lab"][at, 0] - code["lab"][at, 0], 0.0)
    apart = np.full(len(more), np.nan)
    apart[at] = np.where(want["gold"][at], np.sqrt(de * de + darker * darker), de)
    return apart + more, apart


def _remapped(rows: pa.RecordBatch, least: float, farthest: float) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """For each row (a code with ``_pool``, the codes it may become, in order of code_id): the code it becomes, whether it is in its pool, whether it is shaped, the cost."""
    own, pools = {n: rows.column(n) for n in rows.schema.names}, rows.column("_pool")
    flat = pools.flatten()
    codes = dict(zip((f.name for f in flat.type), flat.flatten()))
    n = pc.list_value_length(pools).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.repeat(np.arange(len(n)), n)
    numbers = lambda side, c: side[c].to_numpy(zero_copy_only=False).astype(float)
    want = {c: numbers(own, c)[at] for c in ("mm", "w_mm", "h_mm")} | {"lab": np.stack([numbers(own, f"lab_{c}") for c in "lab"], axis=1)[at]}
    code = {c: numbers(codes, c) for c in ("mm", "w_mm", "h_mm")} | {"lab": np.stack([numbers(codes, f"lab_{c}") for c in "lab"], axis=1)}
    for c, marked in (("material", ("pearl", "gold")), ("shape", ("round",))):
        both = pa.concat_arrays([own[c], codes[c]]).dictionary_encode()
        places, names = both.indices.fill_null(-1).to_numpy(zero_copy_only=False), both.dictionary.to_pylist()
        want[c], code[c] = places[: len(n)][at], places[len(n) :]
        for name in marked:
            place = names.index(name) if name in names else -2
            want[name], code[name] = want[c] == place, code[c] == place
    shaped = pc.not_equal(own["shape"], "round").fill_null(False).to_numpy(zero_copy_only=False)
    same = pc.equal(pc.take(own["code_id"], pa.array(at)), codes["code_id"]).fill_null(False).to_numpy(zero_copy_only=False)
    inside = np.zeros(len(n), bool)
    inside[at[same]] = True
    cost, off = class_cost_array(want, code, 0.0)
    known = own["code_id"].is_valid().to_numpy(zero_copy_only=False)
    fits = known[at] & (off <= farthest) & ~np.isnan(cost) & (~code["round"] | (code["mm"] >= least))
    cost = np.where(inside[at], np.where(same, 0.0, np.inf), np.where(fits, cost, np.inf))
    best = np.full(len(n), np.inf)
    np.minimum.at(best, at, cost)
    hits = np.flatnonzero(np.isfinite(cost) & (cost == best[at]))[::-1]
    place = np.full(len(n), -1)
    place[at[hits]] = hits  # the first, hence the smallest code of equal ones
    return pc.take(codes["code_id"], pa.array(place, mask=place < 0)), inside, shaped, best


def remap(entries: DataFrame, pool: DataFrame, keys: list[str], least: float = 4.0, farthest: float = 20.0) -> DataFrame:
    """Codes of large stones brought into a pool: a code that is in it stays, another one takes the cheapest by ``class_cost``
    (ties: the smallest code), round ones ``least`` mm or more, no farther than ``farthest`` in colour; else it goes.

    Both: keys, code_id, material, shape, mm, w_mm, h_mm, lab_l, lab_a, lab_b, a row a code. Result: keys, code_id, further
    columns of the entries, to_code (null: none fits), why (kept, shape-size, smaller, no-class), cost.

    A pool stands as one array beside each of its entries, so no row for a pair is made or sorted, and entries are dealt
    once and not sorted; a task holds its pools, and ``PAIRS`` pairs at a time or one entry's.
    """
    text, numbers = ["material", "shape"], ["mm", "w_mm", "h_mm", "lab_l", "lab_a", "lab_b"]
    as_double = [F.col(c).cast("double").alias(c) for c in numbers]
    more = [c for c in entries.columns if c not in (*keys, "code_id", *text, *numbers)]
    codes = pool.dropna(subset=["code_id"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("code_id", *text, *as_double))).alias("_pool"))
    rows = entries.select(*keys, "code_id", *more, *text, *as_double).join(codes.hint("shuffle_hash"), keys, "left")
    kept = [*keys, "code_id", *more]
    schema = StructType([*(rows.schema[c] for c in kept), StructField("to_code", pool.schema["code_id"].dataType), StructField("why", StringType()), StructField("cost", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("_pool")).fill_null(0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                done = ends[start - 1] if start else 0
                end = max(int(np.searchsorted(ends, done + PAIRS, side="right")), start + 1)
                part = batch.slice(start, end - start)
                to_code, inside, shaped, cost = _remapped(part, least, farthest)
                why = np.where(inside, "kept", np.where(np.isinf(cost), "no-class", np.where(shaped, "shape-size", "smaller")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), to_code, pa.array(why, pa.string()), pa.array(cost, mask=np.isinf(cost))], names=schema.names)
                start = end

    return rows.mapInArrow(run, schema)


def alike(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records (target_id, weight) that agree in ``keys`` as one, their smallest target_id: weight summed, ``records`` counted."""
    return records.groupBy(*keys).agg(F.min("target_id").alias("target_id"), F.sum("weight").alias("weight"), F.count("*").alias("records"))


def merge_down(costs: DataFrame, records: DataFrame, codes: DataFrame, most: int, keep: tuple[int, ...] = (), penalty: float = DOWN, left_over: float = LEFT_OVER) -> tuple[list[int], list[tuple[int, int, float]]]:
    """Drop the code whose loss costs least, its records moving to their next best, until ``most`` are left.

    ``codes`` (code_id, phys_mm) is the start, ``records`` are (target_id, weight, records). Losing a code costs each of
    its records the squared difference of the next best less that of the code, and ``penalty`` squared if the next best is
    smaller, by weight; ``left_over`` if there is none. Codes in ``keep`` stay; ties go to the smallest code. Returns the
    codes left and the history (code, records moved, cost).

    A record is one row with its codes of the start in order of cost, so a round is a filter of that array and an
    aggregate to a row a code, and moves no record.
    """
    options = F.array_sort(F.collect_list(F.struct("cost", "code_id", "de", F.col("phys_mm").cast("double").alias("mm"))))
    rows = costs.join(F.broadcast(codes.select("code_id", "phys_mm")), "code_id").groupBy("target_id").agg(options.alias("options"))
    rows = spatial.stored(rows.join(records.select("target_id", "weight", "records"), "target_id"), "options")
    live, history = sorted(r["code_id"] for r in codes.select("code_id").collect()), []
    while len(live) > most:
        left = rows.withColumn("left", F.filter("options", lambda o: o["code_id"].isin(live)))
        left = left.select("weight", "records", F.get("left", 0).alias("now"), F.get("left", 1).alias("then")).where("now is not null")
        moved = F.col("then.de") * F.col("then.de") - F.col("now.de") * F.col("now.de") + F.when(F.col("then.mm") < F.col("now.mm") - 1e-6, penalty**2).otherwise(0.0)
        price = F.sum(F.col("weight") * F.when(F.col("then").isNull(), left_over).otherwise(moved))
        prices = {r["code"]: (r["price"], r["records"]) for r in left.groupBy(F.col("now.code_id").alias("code")).agg(price.alias("price"), F.sum("records").alias("records")).collect()}
        found = min(((*prices.get(c, (0.0, 0)), c) for c in live if c not in keep), key=lambda x: (x[0], x[2]), default=None)
        if found is None:
            break
        live.remove(found[2])
        history.append((found[2], int(found[1]), float(found[0])))
    return live, history
