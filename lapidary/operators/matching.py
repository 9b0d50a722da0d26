"""One-to-one matching of two layouts, its scores, mirror pairs, remapping, crops, alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.operators import spatial as S


def greedy(pairs: DataFrame, keys: list[str], a: str, b: str, cost: str) -> DataFrame:
    """Candidate pairs taken cheapest first, each side at most once; ties by (a, b).

    The cheapest pair of all is its two ends' cheapest, so each round takes all pairs that are that and strikes their ends
    out; what is left has a cheapest pair again. Rounds are few, since a chain of ever cheaper neighbours is short. All
    columns go through the rounds, so give those alone that are needed. A round deals its pairs out by a, by b, where a
    taken pair strikes the others of its b, and by a again.
    """
    rest, taken = pairs, []
    while True:
        first = lambda side: F.row_number().over(Window.partitionBy(*keys, side).orderBy(cost, a, b))
        over = lambda side: F.max("_m").over(Window.partitionBy(*keys, side))
        ranked = rest.withColumn("_m", first(a) == 1).withColumn("_m", F.col("_m") & (first(b) == 1))
        ranked = ranked.withColumn("_u", over(b)).where("_m or not _u").withColumn("_u", over(a)).where("_m or not _u").drop("_u")
        ranked = S.stored(ranked, "matched")
        taken.append(ranked.where("_m").drop("_m"))
        rest = ranked.where("not _m").drop("_m")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, taken)


def scores(matched: DataFrame, predicted: DataFrame, truth: DataFrame, keys: list[str], same: dict[str, Column]) -> DataFrame:
    """Precision, recall, F1 and the share of matches for which each of ``same`` holds, in per cent of one digit."""
    found = matched.groupBy(*keys).agg(F.count("*").alias("matched"), *(F.count_if(c).alias(f"_{n}") for n, c in same.items()))
    sizes = predicted.groupBy(*keys).agg(F.count("*").alias("predicted")).join(truth.groupBy(*keys).agg(F.count("*").alias("truth")), keys, "full").join(found, keys, "left").na.fill(0)
    share = lambda x, y: F.when(y > 0, F.floor(1000 * x / y + F.lit(0.5)) / 10.0)
    m = F.col("matched")
    return sizes.select(*keys, "predicted", "truth", "matched", share(m, F.col("predicted")).alias("precision"), share(m, F.col("truth")).alias("recall"), share(2 * m, F.col("predicted") + F.col("truth")).alias("f1"), *(share(F.col(f"_{n}"), m).alias(n) for n in same))


def majority(matched: DataFrame, keys: list[str], cluster: str, label: str) -> DataFrame:
    """How many matches carry their cluster's commonest true label: the upper bound of any renaming of clusters."""
    votes = matched.groupBy(*keys, cluster, label).agg(F.count("*").alias("n")).groupBy(*keys, cluster).agg(F.max("n").alias("n"))
    return votes.groupBy(*keys).agg(F.sum("n").alias("majority"))


def mirror_candidates(items: DataFrame, axis: float, reach: float, keys: list[str], nearest: float = 0.0) -> DataFrame:
    """Left items against right ones reflected about the axis, closer than ``reach``; items near the axis take no part."""
    far = items.where(F.abs(F.col("x_mm") - axis) >= nearest)
    left, right = far.where(F.col("x_mm") < axis), far.where(F.col("x_mm") >= axis)
    return S.within(left, right.withColumn("x_mm", 2 * axis - F.col("x_mm")), reach, keys)


def commonest(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The commonest value of each group; ties: the one seen first."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("_n"), "_first", value)).alias("_b"), F.sum("n").alias("_all"))
    return best.select(*keys, F.col(f"_b.{value}").alias(value), (-F.col("_b._n")).alias("n"), (-F.col("_b._n") / F.col("_all")).alias("share"))


def alignment(moving: DataFrame, fixed: DataFrame, shifts: DataFrame, tolerance: float, keys: list[str]) -> DataFrame:
    """For each shift (shift, dx, dy) how many moving items come within ``tolerance`` of a fixed one in x and y."""
    moved = moving.crossJoin(F.broadcast(shifts)).withColumns({"x_mm": F.col("x_mm") + F.col("dx"), "y_mm": F.col("y_mm") + F.col("dy")})  # a stated grid of shifts
    near = S.within(moved, fixed, 2 * tolerance, keys).where((F.abs(F.col("a_x_mm") - F.col("b_x_mm")) < tolerance) & (F.abs(F.col("a_y_mm") - F.col("b_y_mm")) < tolerance))
    return near.select(*keys, F.col("a_shift").alias("shift"), "a_stone_id").distinct().groupBy(*keys, "shift").agg(F.count("*").alias("hits"))


def _differ(a: str, b: str) -> Column:
    gaps = [F.col(f"{a}lab_{x}") - F.col(f"{b}lab_{x}") for x in "lab"]
    return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])


def _ratio(a: str, b: str) -> Column:
    return F.greatest(f"{a}d_mm", f"{b}d_mm") / F.least(f"{a}d_mm", f"{b}d_mm")


def axis_votes(items: DataFrame, keys: list[str], prior: float, row: float = 1.2, span: float = 30.0, least: float = 3.0, ratio: float = 1.25, differ: float = 15.0) -> DataFrame:
    """(keys, y, mid): middles of pairs in one row that are alike in size and colour and lie further apart than the upper one is wide.

    A pair whose middle lies within ``span`` of the prior axis is an item near another's image about that axis, so cells
    of a row's height and twice the span's width hold all that may meet.
    """
    seen = items.where(F.col("d_mm") >= least).select(*keys, "stone_id", "x_mm", "y_mm", "d_mm", "lab_l", "lab_a", "lab_b")
    name = lambda p: seen.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in seen.columns if c not in keys))
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    a = name("a").withColumns({"_cx": F.floor((2 * prior - F.col("a_x_mm")) / (2 * span)), "_cy": F.floor(F.col("a_y_mm") / row)})
    a = a.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"_cx": F.col("_cx") + F.col("_dx"), "_cy": F.col("_cy") + F.col("_dy")}).drop("_dx", "_dy")
    b = name("b").withColumns({"_cx": F.floor(F.col("b_x_mm") / (2 * span)), "_cy": F.floor(F.col("b_y_mm") / row)})
    # what was exploded is more than its file's size tells, here and below
    pairs = a.join(b.hint("merge"), [*keys, "_cx", "_cy"]).withColumn("mid", (F.col("a_x_mm") + F.col("b_x_mm")) / 2)
    upper = (F.col("a_y_mm") < F.col("b_y_mm")) | ((F.col("a_y_mm") == F.col("b_y_mm")) & (F.col("a_stone_id") < F.col("b_stone_id")))
    fits = upper & (F.col("b_y_mm") - F.col("a_y_mm") <= row) & (F.abs(F.col("mid") - prior) <= span) & (F.abs(F.col("a_x_mm") - F.col("b_x_mm")) >= F.col("a_d_mm"))
    return pairs.where(fits & (_ratio("a_", "b_") <= ratio) & (_differ("a_", "b_") <= differ)).select(*keys, ((F.col("a_y_mm") + F.col("b_y_mm")) / 2).alias("y"), "mid")


def local_axes(votes: DataFrame, keys: list[str], prior: float, step: float = 2.0, band: float = 15.0, bin_mm: float = 0.5, min_votes: float = 2.0, sigma: float = 6.0, fill: float = 10.0) -> DataFrame:
    """(keys, k, axis): the axis at heights k * ``step``, from the peak of the middles within ``band`` of them.

    Votes count by their distance to the prior axis, half as much in the bins beside their own. A height whose peak has
    less than ``min_votes`` takes the nearest one's axis within ``fill`` (ties: the upper one's). Sums are taken to a
    billionth, so that the order of their rows does not show.
    """
    at = F.explode(F.sequence(F.ceil((F.col("y") - band) / step), F.floor((F.col("y") + band) / step)))
    weight = F.exp(-(F.col("mid") - prior) * (F.col("mid") - prior) / (2 * sigma * sigma))
    votes = S.stored(votes, "votes")
    votes = votes.withColumn("k", at).withColumns({"bin": F.floor(F.col("mid") / bin_mm + F.lit(0.5)), "w": weight})
    spread = F.explode(F.array(*(F.struct((F.col("bin") + i).alias("bin"), (F.col("w") * f).alias("w")) for i, f in ((-1, 0.5), (0, 1.0), (1, 0.5)))))
    heights = votes.select(*keys, "k", spread.alias("v")).groupBy(*keys, "k", "v.bin").agg(F.floor(F.sum("v.w") * 1e9 + F.lit(0.5)).alias("votes"))
    peak = heights.groupBy(*keys, "k").agg(F.min(F.struct((-F.col("votes")).alias("votes"), "bin")).alias("p")).where(-F.col("p.votes") >= min_votes * 1e9).select(*keys, "k", F.col("p.bin").alias("_bin"))
    own = votes.join(peak.hint("merge"), [*keys, "k"]).where(F.abs(F.col("mid") - F.col("_bin") * bin_mm) <= 1.5 * bin_mm).groupBy(*keys, "k").agg((F.floor(F.avg("mid") * 1e9 + F.lit(0.5)) / 1e9).alias("axis"))
    reach = int(fill / 2)
    near = S.stored(own, "axes").withColumn("d", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    return near.groupBy(*keys, (F.col("k") + F.col("d")).alias("k")).agg(F.min(F.struct(F.abs("d").alias("far"), F.col("k").alias("of"), "axis")).alias("n")).select(*keys, "k", F.col("n.axis").alias("axis"))


def twins(items: DataFrame, axes: DataFrame, keys: list[str], largest: float, step: float = 2.0, least: float = 4.5, aside: float = 0.5, ratio: float = 1.8, differ: float = 30.0) -> DataFrame:
    """(keys, a, b, off, axis): items left of their height's axis and those right of it that are each other's nearest image.

    An image may be off by 0.35 of the larger size and 0.8 mm; ``largest`` bounds the sizes. Ties: the smaller stone_id.
    """
    big = items.where(F.col("d_mm") >= least).select(*keys, "stone_id", "x_mm", "y_mm", "d_mm", "lab_l", "lab_a", "lab_b")
    placed = big.withColumn("k", F.floor(F.col("y_mm") / step + F.lit(0.5))).join(axes.hint("merge"), [*keys, "k"]).drop("k")
    placed = S.stored(placed, "placed")

    def image(rows: DataFrame, side: int) -> DataFrame:
        near = S.within(rows.withColumn("x_mm", 2 * F.col("axis") - F.col("x_mm")), big, 0.35 * largest + 0.81, keys)
        fits = (F.col("distance") <= 0.35 * F.greatest("a_d_mm", "b_d_mm") + 0.8) & ((F.col("b_x_mm") - F.col("a_axis")) * side > 0)
        near = near.where(fits & (F.col("a_stone_id") != F.col("b_stone_id")) & (_ratio("a_", "b_") <= ratio) & (_differ("a_", "b_") <= differ))
        return near.groupBy(*keys, F.col("a_stone_id").alias("me")).agg(F.min(F.struct("distance", F.col("b_stone_id").alias("you"))).alias("n"), F.first("a_axis").alias("axis"))

    there = image(placed.where(F.col("x_mm") < F.col("axis") - aside), 1).select(*keys, F.col("me").alias("a"), F.col("n.you").alias("b"), F.col("n.distance").alias("off"), "axis")
    back = image(placed, -1).select(*keys, F.col("n.you").alias("a"), F.col("me").alias("b"))
    return there.join(back, [*keys, "a", "b"])
