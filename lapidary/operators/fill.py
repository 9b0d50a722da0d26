"""Places filled with small beads: how dense each bead's surroundings are, regions of dense beads, and their growth on a picture.

Neighbours meet by grid cell and material, regions are connected components of pairs, and growth runs over a table of cells:
the regions of all pictures that have the same turn grow at once, each as the component of free cells of its colour that
holds its seeds. No picture is ever in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.functions.numeric import rounded
from lapidary.operators.spatial import both_ends, components, stored, within


@dataclass(frozen=True)
class Fill:
    """Fixed values of the rules; sparse drawings may want others."""

    largest: float = 5.0  # beads above this are details
    reach: float = 3.0  # surroundings, in sizes of the bead
    least_size: float = 2.0  # smaller beads look as far around as this one
    near: int = 6  # neighbours of one material and colour
    cover: float = 0.55  # share of the surroundings that lies under any bead
    spread: float = 0.2  # smaller to larger variance of the neighbours' places
    de: float = 20.0  # colour difference within a region
    l_weight: float = 0.5  # of lightness in it
    link: float = 1.6  # beads of a region, in mean sizes
    beads: int = 15  # of a region at least
    inner: float = 0.5  # share of beads with three linked ones
    solid: float = 0.8  # that share in a region which need not be uneven
    cv: float = 0.15  # signs of uneven drawing: spread of sizes,
    broken: float = 0.3  # share of broken beads,
    under: float = 0.5  # share of beads below nine tenths of the smallest size
    whole: float = 0.9  # solidity of a bead that is not broken
    cell: float = 0.5  # mm, of the cells that the cover is counted in
    gap: float = 0.15  # between the stones that fill a region
    pitch_slack: float = 1.05


def difference(p: str, q: str, l_weight: float) -> Column:
    """Of the colours in columns p.. and q.. (lab_l, lab_a, lab_b), lightness weighted."""
    dl, da, db = (F.col(f"{p}lab_{c}") - F.col(f"{q}lab_{c}") for c in "lab")
    return F.sqrt(F.lit(l_weight * l_weight) * dl * dl + da * da + db * db)


def _candidates(beads: DataFrame, rule: Fill) -> DataFrame:
    return beads.where((F.col("shape") == "round") & (F.col("d_mm") <= rule.largest))


def surroundings(beads: DataFrame, keys: list[str], smallest: Column, rule: Fill = Fill()) -> DataFrame:
    """Every small round bead with what is around it: keys, stone_id, n, two_d, cv, frag, sub, cover, dense.

    ``beads``: keys, stone_id, x_mm, y_mm, d_mm, shape, material, lab_l, lab_a, lab_b, solidity. ``n`` counts neighbours of its
    material and colour; ``two_d`` is the ratio of their places' variances about the bead, the others are shares and the
    spread of sizes among them and itself. ``smallest`` is the smallest size that its material comes in. ``cover`` is
    counted only where ``n`` and ``two_d`` suffice, since only there it decides.
    """
    own = [*keys, "material"]
    rows = _candidates(beads, rule).select(*own, "stone_id", "x_mm", "y_mm", "d_mm", "lab_l", "lab_a", "lab_b", (F.col("solidity") < rule.whole).cast("double").alias("bad"), (F.col("d_mm") < F.lit(0.9) * smallest).cast("double").alias("low"))
    rows = stored(rows.withColumn("r", rule.reach * F.greatest("d_mm", F.lit(rule.least_size))), "beads")
    met = within(rows, rows, rule.reach * max(rule.largest, rule.least_size) + 1e-6, own)
    met = met.where((F.col("a_stone_id") != F.col("b_stone_id")) & (F.col("distance") <= F.col("a_r")) & (difference("a_", "b_", rule.l_weight) <= rule.de))
    dx, dy = F.col("b_x_mm") - F.col("a_x_mm"), F.col("b_y_mm") - F.col("a_y_mm")
    sums = met.groupBy(*keys, F.col("a_stone_id").alias("stone_id")).agg(
        F.count("*").alias("n"), F.sum(dx * dx).alias("xx"), F.sum(dy * dy).alias("yy"), F.sum(dx * dy).alias("xy"),
        F.sum("b_d_mm").alias("d"), F.sum(F.col("b_d_mm") * F.col("b_d_mm")).alias("dd"), F.sum("b_bad").alias("bads"), F.sum("b_low").alias("lows"),
    )
    joined = rows.join(sums, [*keys, "stone_id"], "left").fillna(0, ["n", "xx", "yy", "xy", "d", "dd", "bads", "lows"])
    half, root = (F.col("xx") + F.col("yy")) / 2, F.sqrt((F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy")) / 4 + F.col("xy") * F.col("xy"))
    all_, mean = F.col("n") + 1, (F.col("d") + F.col("d_mm")) / (F.col("n") + 1)
    spread = F.sqrt(F.greatest((F.col("dd") + F.col("d_mm") * F.col("d_mm")) / all_ - mean * mean, F.lit(0.0)))
    told = joined.select(
        *keys, "stone_id", "x_mm", "y_mm", "r", "n",
        rounded(F.when(half + root > 0, (half - root) / (half + root)).otherwise(0.0), 6).alias("two_d"),
        rounded(spread / mean, 6).alias("cv"), ((F.col("bads") + F.col("bad")) / all_).alias("frag"), ((F.col("lows") + F.col("low")) / all_).alias("sub"),
    )
    told = stored(told, "surroundings")
    asked = told.where((F.col("n") >= rule.near) & (F.col("two_d") >= rule.spread))
    found = told.join(cover(asked, beads, keys, rule.cell), [*keys, "stone_id"], "left")
    return found.select(*keys, "stone_id", "n", "two_d", "cv", "frag", "sub", "cover", F.coalesce(F.col("cover") >= rule.cover, F.lit(False)).alias("dense"))


def cover(places: DataFrame, beads: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """The share of cells under any bead in the square about each place that has the area of the circle of radius ``r``.

    Beads are runs of cells in each row of cells; a place meets the runs of its rows, so that neither side is spread over
    single cells. Result: keys, stone_id, cover.
    """
    cx, cy, r = F.col("x_mm") / cell, F.col("y_mm") / cell, F.col("d_mm") / 2 / cell
    half = F.sqrt(F.greatest(r * r - (F.col("row") - cy) * (F.col("row") - cy), F.lit(0.0)))
    spans = beads.where("d_mm > 0").withColumn("row", F.explode(F.sequence(F.ceil(cy - r), F.floor(cy + r)))).select(*keys, "row", F.ceil(cx - half).alias("first"), F.floor(cx + half).alias("last")).where("last >= first")
    # runs of one row that share no cell: of each what those before it leave
    before = F.max("last").over(Window.partitionBy(*keys, "row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("first", F.greatest("first", before + 1)).where("last >= first")
    side = F.col("r") / cell * F.sqrt(F.lit(3.141592653589793)) / 2
    edge = lambda v: F.floor(v + F.lit(0.5)).cast("long")
    boxes = places.select(*keys, "stone_id", edge(cx - side).alias("x0"), edge(cx + side).alias("x1"), edge(cy - side).alias("y0"), edge(cy + side).alias("y1")).where("x1 > x0 and y1 > y0")
    lines = boxes.withColumn("row", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)))
    # bands of cells along a row keep beads and places apart that are far from each other; both sides are many rows a bead
    wide = 64
    bands = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / wide), F.floor(F.col(b) / wide)))
    band = F.col("band") * wide
    parts = apart.withColumn("band", bands("first", "last")).withColumns({"first": F.greatest("first", band), "last": F.least("last", band + wide - 1)})
    met = lines.withColumn("band", bands("x0", "x1")).join(parts.hint("merge"), [*keys, "row", "band"])
    cells = F.least("last", F.col("x1") - 1) - F.greatest("first", "x0") + 1
    union = met.where(cells > 0).groupBy(*keys, "stone_id").agg(F.sum(cells).alias("held"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return boxes.join(union, [*keys, "stone_id"], "left").select(*keys, "stone_id", rounded(F.coalesce("held", F.lit(0)) / area, 6).alias("cover"))


def regions(beads: DataFrame, dense: DataFrame, keys: list[str], smallest: Column, rule: Fill = Fill()) -> tuple[DataFrame, DataFrame]:
    """Components of dense beads, judged: (keys, stone_id, region) and (keys, region, material, beads, ..., verdict).

    ``dense``: keys, stone_id. A region is named by its smallest bead. Its verdict is ``few`` beads, ``thin`` (too few of them
    have three linked ones), ``tidy`` (drawn evenly, so each bead stands for itself) or ``fill``.
    """
    own = [*keys, "material"]
    rows = beads.select(*own, "stone_id", "x_mm", "y_mm", "d_mm", "lab_l", "lab_a", "lab_b", "solidity").join(dense.select(*keys, "stone_id").hint("merge"), [*keys, "stone_id"], "left_semi")
    rows = stored(rows, "dense")
    met = within(rows, rows, rule.link * rule.largest + 1e-6, own).where((F.col("a_stone_id") < F.col("b_stone_id")) & (F.col("distance") <= rule.link * (F.col("a_d_mm") + F.col("b_d_mm")) / 2))
    met = stored(met.withColumn("alike", difference("a_", "b_", rule.l_weight) <= rule.de), "links")
    ends = met.where("alike").select(*keys, F.col("a_stone_id").alias("a"), F.col("b_stone_id").alias("b"))
    of = stored(components(rows.select(*keys, F.col("stone_id").alias("node")), ends, keys).select(*keys, F.col("node").alias("stone_id"), F.col("component").alias("region")), "regions")
    side = lambda c: of.select(*keys, F.col("stone_id").alias(f"{c}_stone_id"), F.col("region").alias(f"{c}_region"))
    # beads of one region count as linked by distance alone
    inside = met.join(side("a"), [*keys, "a_stone_id"]).join(side("b"), [*keys, "b_stone_id"]).where("a_region = b_region")
    degrees = both_ends(inside, keys, ["distance"]).groupBy(*keys, "stone_id").agg(F.count("*").alias("links"), F.min("distance").alias("nearest"))
    held = rows.join(of, [*keys, "stone_id"]).join(degrees, [*keys, "stone_id"], "left")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    upper = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")
    touch = F.col("nearest") <= F.lit(1.6) * F.col("d_mm")
    spread = F.sqrt(F.greatest(F.avg(F.col("d_mm") * F.col("d_mm")) - F.avg("d_mm") * F.avg("d_mm"), F.lit(0.0)))
    rated = held.withColumn("_step", F.when(touch, F.col("nearest"))).groupBy(*keys, "region").agg(
        F.first("material").alias("material"), F.count("*").alias("beads"), upper("d_mm").alias("drawn_mm"), *(upper(f"lab_{c}").alias(f"lab_{c}") for c in "lab"),
        share(F.coalesce("links", F.lit(0)) >= 3).alias("inner"), rounded(spread / F.avg("d_mm"), 6).alias("cv"), share(F.col("solidity") < rule.whole).alias("frag"), share(F.col("d_mm") < F.lit(0.9) * smallest).alias("sub"),
        F.count("_step").alias("steps"), upper("_step").alias("_pitch"),
    )
    tidy = (F.col("inner") < rule.solid) & (F.col("cv") < rule.cv) & (F.col("frag") < rule.broken) & (F.col("sub") < rule.under)
    verdict = F.when(F.col("beads") < rule.beads, "few").when(F.col("inner") < rule.inner, "thin").when(tidy, "tidy").otherwise("fill")
    pitch = F.when(F.col("steps") >= 5, F.col("_pitch")).otherwise(F.col("drawn_mm"))
    return of, rated.withColumns({"verdict": verdict, "pitch_mm": pitch}).drop("steps", "_pitch")


def filling(found: DataFrame, sizes: DataFrame, rule: Fill = Fill()) -> DataFrame:
    """Adds ``phys_mm`` and ``with`` to regions: the largest size of their material that the drawn steps leave room for.

    ``sizes``: material, sizes (ascending). Pearls drawn smaller than any pearl become white stones; where nothing fits, the
    smallest size is taken.
    """
    room = F.col("pitch_mm") * rule.pitch_slack
    fit = lambda c: F.filter(c, lambda v: v + rule.gap <= room)
    white = sizes.where("material = 'white'").select(F.col("sizes").alias("_white"))
    rows = found.join(F.broadcast(sizes), "material", "left").join(F.broadcast(white.limit(1)), F.lit(True), "left")
    swap = (F.col("material") == "pearl") & (F.size(F.coalesce(fit("sizes"), F.array().cast("array<double>"))) == 0) & (F.size("_white") > 0)
    rows = rows.withColumns({"with": F.when(swap, "white").otherwise(F.col("material")), "sizes": F.when(swap, F.col("_white")).otherwise(F.col("sizes"))})
    return rows.withColumn("phys_mm", F.coalesce(F.array_max(fit("sizes")), F.get("sizes", F.lit(0)))).drop("sizes", "_white")


def _node(x: str = "px", y: str = "py") -> Column:
    return F.shiftleft(F.col(y).cast("long"), 32) + F.col(x).cast("long")


def _beside(cells: DataFrame, other: DataFrame, keys: list[str], ours: list[str], theirs: list[str]) -> DataFrame:
    """Cells with their right and lower neighbours; columns a_ of the cell, b_ of the neighbour."""
    here = cells.select(*keys, "px", "py", *(F.col(c).alias(f"a_{c}") for c in ours))
    steps = F.explode(F.array(F.struct(F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.lit(0).alias("x"), F.lit(1).alias("y"))))
    shown = other.withColumn("_s", steps).select(*keys, (F.col("px") - F.col("_s.x")).alias("px"), (F.col("py") - F.col("_s.y")).alias("py"), *(F.col(c).alias(f"b_{c}") for c in theirs))
    return here.join(shown, [*keys, "px", "py"])


def grow(cells: DataFrame, seeds: DataFrame, keys: list[str], most_de: float = 20.0, l_weight: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Regions that take the cells of their colour around their seeds, in order of ``turn``; a cell is taken once.

    ``cells``: keys, px, py, lab_l, lab_a, lab_b, held (null: free; else the material of the bead on it, or another word for what
    no region may take). ``seeds``: keys, turn, material, px, py. A region takes the seeds that are open to it and not taken
    before; their upper median colour is its own; from there it goes on over sides of cells that are open and within ``most_de``
    of that. Results: (keys, px, py, turn) and (keys, turn, material, lab_l, lab_a, lab_b, cells, merged), where ``merged`` is the
    smallest turn of the regions of one material and colour that touch.

    A turn's regions of all pictures grow at once, as components of open cells; rounds are as many as a picture's regions.
    """
    cells, seeds = stored(cells.select(*keys, "px", "py", "lab_l", "lab_a", "lab_b", "held"), "cells"), stored(seeds.select(*keys, "turn", "material", "px", "py").distinct(), "seeds")
    open_ = F.col("held").isNull() | (F.col("held") == F.col("material"))
    upper = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)").alias(f"ref_lab_{c[-1]}")
    place = [*keys, "px", "py"]
    owned = cells.select(*place).limit(0).withColumn("turn", F.lit(0))
    refs = None
    for turn in [r[0] for r in seeds.select("turn").distinct().orderBy("turn").collect()]:
        free = cells.join(owned.select(*place), place, "left_anti")
        start = stored(free.join(seeds.where(F.col("turn") == turn).select(*place, "material"), place).where(open_), "start")
        ref = stored(start.groupBy(*keys).agg(F.first("material").alias("material"), *(upper(f"lab_{c}") for c in "lab")), "ref")
        alike = free.join(ref, keys).where(open_ & (difference("", "ref_", l_weight) <= most_de)).select(*place)
        way = stored(alike.unionByName(start.select(*place)).distinct().withColumn("node", _node()), "way")
        edges = _beside(way, way, keys, ["node"], ["node"]).select(*keys, F.col("a_node").alias("a"), F.col("b_node").alias("b"))
        parts = components(way.select(*keys, "node"), edges, keys)
        hit = parts.join(start.select(*keys, _node().alias("node")), [*keys, "node"], "left_semi").select(*keys, "component").distinct()
        taken = way.join(parts.join(hit, [*keys, "component"], "left_semi"), [*keys, "node"]).select(*place, F.lit(turn).alias("turn"))
        owned = stored(owned.unionByName(taken), "owned")
        ref = ref.withColumn("turn", F.lit(turn))
        refs = ref if refs is None else refs.unionByName(ref)
    if refs is None:
        refs = seeds.select(*keys, "material", *(F.lit(None).cast("double").alias(f"ref_lab_{c}") for c in "lab"), "turn").limit(0)
    touching = _beside(owned, owned, keys, ["turn"], ["turn"]).where("a_turn <> b_turn").select(*keys, F.least("a_turn", "b_turn").alias("a"), F.greatest("a_turn", "b_turn").alias("b")).distinct()
    side = lambda c: refs.select(*keys, F.col("turn").alias(c), F.col("material").alias(f"{c}_material"), *(F.col(f"ref_lab_{x}").alias(f"{c}_lab_{x}") for x in "lab"))
    same = touching.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"]).where((F.col("a_material") == F.col("b_material")) & (difference("a_", "b_", l_weight) <= most_de))
    merged = components(refs.select(*keys, F.col("turn").alias("node")), same.select(*keys, "a", "b"), keys).select(*keys, F.col("node").alias("turn"), F.col("component").alias("merged"))
    sizes = owned.groupBy(*keys, "turn").agg(F.count("*").alias("cells"))
    found = refs.join(sizes, [*keys, "turn"]).join(merged, [*keys, "turn"])
    return owned, found.select(*keys, "turn", "material", *(F.col(f"ref_lab_{c}").alias(f"lab_{c}") for c in "lab"), "cells", "merged")
