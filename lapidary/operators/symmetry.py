"""The upright axis about which a picture is most like its mirror image, over a table of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most that one cell may differ; share of the cells that must meet one another.
MOST_DE, LEAST_OVERLAP = 50.0, 0.5


def axis_curve(cells: DataFrame, keys: list[str], n: int, first: int, last: int) -> DataFrame:
    """For every axis the cells that meet, all cells of either side, and the mean difference of those that meet.

    ``cells``: keys, px, py (of ``n`` a row), lab_l, lab_a, lab_b; a cell that is not there is not part of the mask. An axis
    is named by the sum of the columns that mirror each other, from ``first`` to ``last``. Result: keys, axis, both, any,
    iou, overlap, cost. Cells meet by row, and each pair counts for the one axis that lies between; a row is what the
    picture is wide, so pairs are as many as cells times columns.
    """
    lab = ["lab_l", "lab_a", "lab_b"]
    one = cells.select(*keys, "py", F.col("px").alias("x"), *(F.col(c).alias(f"p_{c}") for c in lab))
    two = cells.select(*keys, "py", F.col("px").alias("x2"), *(F.col(c).alias(f"q_{c}") for c in lab))
    # a pair and its turned one differ alike: met once, counted twice
    met = one.join(two, [*keys, "py"]).where((F.col("x") <= F.col("x2")) & (F.col("x") + F.col("x2")).between(first, last))
    gap = F.sqrt(sum(((F.col(f"p_{c}") - F.col(f"q_{c}")) * (F.col(f"p_{c}") - F.col(f"q_{c}")) for c in lab[1:]), (F.col("p_lab_l") - F.col("q_lab_l")) * (F.col("p_lab_l") - F.col("q_lab_l"))))
    times = F.when(F.col("x") == F.col("x2"), 1).otherwise(2)
    sums = met.groupBy(*keys, (F.col("x") + F.col("x2")).alias("axis")).agg(F.sum(times).alias("both"), F.sum(times * F.least(gap, F.lit(MOST_DE))).alias("cost"))
    # of every axis, how many cells have their image within the frame: from the number of cells in each column
    columns = cells.groupBy(*keys, "px").agg(F.count("*").alias("held"))
    seen = columns.select(*keys, "held", F.explode(F.sequence(F.greatest(F.col("px"), F.lit(first)), F.least(F.col("px") + n - 1, F.lit(last)))).alias("axis")).groupBy(*keys, "axis").agg(F.sum("held").alias("seen"))
    area = columns.groupBy(*keys).agg(F.sum("held").alias("area"))
    rows = sums.join(seen, [*keys, "axis"]).join(area, keys).withColumn("any", F.col("area") + F.col("seen") - F.col("both"))
    return rows.select(*keys, "axis", "both", "any", (F.col("both") / F.col("any")).alias("iou"), (F.col("both") / F.col("area")).alias("overlap"), (F.col("cost") / F.col("both")).alias("cost"))


def best_axis(curve: DataFrame, keys: list[str], cell_mm: float, masked: bool = True, least_overlap: float = LEAST_OVERLAP, slack: float = 0.0) -> DataFrame:
    """The best axis of each picture: keys, axis, axis_mm (between cells, by a parabola through its neighbours), iou, cost.

    Of axes at which enough meets, that of least difference; with a mask only of those whose overlap is within
    ``slack`` of the best. Equal ones: the first.
    """
    fair = curve.where(F.col("overlap") >= least_overlap)
    top = fair.groupBy(*keys).agg(F.max("iou").alias("top"))
    key = F.when(F.col("iou") >= F.col("top") - slack, F.col("cost")) if masked else F.col("cost")
    rated = curve.join(top, keys).withColumn("_key", key)
    best = rated.where((F.col("overlap") >= least_overlap) & F.col("_key").isNotNull()).groupBy(*keys).agg(F.min(F.struct("_key", "axis", "iou", "cost")).alias("b")).select(*keys, "b.*")
    beside = lambda by, name: rated.select(*keys, (F.col("axis") + by).alias("axis"), F.col("_key").alias(name))
    met = best.join(beside(1, "_left"), [*keys, "axis"], "left").join(beside(-1, "_right"), [*keys, "axis"], "left")
    bend = F.col("_left") - 2 * F.col("_key") + F.col("_right")
    off = F.when(bend > 0, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("_left") - F.col("_right")) / bend)))
    return met.select(*keys, "axis", ((F.col("axis") + F.coalesce(off, F.lit(0.0)) + 1) / 2 * cell_mm).alias("axis_mm"), "iou", "cost")
