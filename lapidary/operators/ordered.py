"""Loops whose steps look at those before them, as rounds over all steps that wait for nothing.

Each of these is defined by one pass in a given order, in which a step sees what earlier ones near it decided: bodies that
give way, edges that make chains, labels that spread, errors that are passed on. A step needs the steps before it only
where they are near; so all steps without an undecided one before them are taken at once, and the result is that of the
pass. The rounds are as many as the longest row of neighbours in ascending order, which is short where the order has
nothing to do with the place; no component is ever gathered in one task. Every round is written to the shared folder.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.functions import color
from lapidary.functions.numeric import rounded
from lapidary.operators.spatial import both_ends, close_pairs, stored

_EPS = 1e-9


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def waves(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``wave`` to (keys, node): how many nodes stand on the longest way of edges (first, then) up to it."""
    rest, edges, found = stored(nodes.select(*keys, "node").distinct(), "nodes"), stored(edges.select(*keys, "first", "then").distinct(), "edges"), []
    while not rest.isEmpty():
        ready = stored(rest.join(edges.select(*keys, F.col("then").alias("node")), [*keys, "node"], "left_anti"), "ready")
        if ready.isEmpty():
            raise ValueError("the edges go round in a circle")
        found.append(ready.withColumn("wave", F.lit(len(found))))
        rest = stored(rest.join(ready, [*keys, "node"], "left_anti"), "nodes")
        edges = stored(edges.join(ready.select(*keys, F.col("node").alias("first")), [*keys, "first"], "left_anti"), "edges")
    return _union(found) if found else rest.withColumn("wave", F.lit(0))


def place(items: DataFrame, keys: list[str], clearance: float, obstacles: DataFrame | None = None) -> DataFrame:
    """Round bodies that take, in order of ``rank`` (ties: item), the first of their options that keeps clear of those before.

    ``items``: keys, item, rank, x_mm, y_mm, options (array of dx, dy, size). Two bodies are clear if their edges are
    ``clearance`` apart or more. ``obstacles`` (keys, item, x, y, size) stand in an item's way from the start. Result: keys,
    item, chosen (from 0; null: none fits), x_mm, y_mm, phys_mm (null too). Bodies that were taken do not overlap, so few
    of them are near any other.
    """
    far = F.array_max(F.transform("options", lambda o: F.hypot(o["dx"], o["dy"]) + o["size"] / 2))
    base = stored(items.select(*keys, "item", F.struct("rank", "item").alias("at"), "x_mm", "y_mm", "options", (far * 2).alias("_body")).where("size(options) > 0"), "items")
    # whatever options two bodies take, they can only meet within this
    near = close_pairs(base.select(*keys, "item", "at", "x_mm", "y_mm", "_body"), clearance + _EPS, keys, order="item", size="_body")
    turned = F.col("a_at") > F.col("b_at")
    pick = lambda p, q, c: F.when(turned, F.col(f"{q}_{c}")).otherwise(F.col(f"{p}_{c}"))
    edges = stored(near.select(*keys, pick("a", "b", "item").alias("first"), pick("b", "a", "item").alias("then")), "near")
    there = obstacles.select(*keys, "item", F.struct("x", "y", "size").alias("t")) if obstacles is not None else None
    rest, decided = base.select(*keys, "item"), []

    def clear(o: Column) -> Column:
        gap = lambda t: F.hypot(F.col("x_mm") + o["dx"] - t["x"], F.col("y_mm") + o["dy"] - t["y"]) - (t["size"] + o["size"]) / 2
        return F.coalesce(F.forall("others", lambda t: gap(t) >= clearance - _EPS), F.lit(True))

    while not rest.isEmpty():
        ready = rest.join(edges.select(*keys, F.col("then").alias("item")), [*keys, "item"], "left_anti").join(base.drop("at", "_body"), [*keys, "item"])
        others = None if there is None else there.groupBy(*keys, "item").agg(F.collect_list("t").alias("others"))
        ready = ready.withColumn("others", F.lit(None).cast("array<struct<x:double,y:double,size:double>>")) if others is None else ready.join(others, [*keys, "item"], "left")
        chosen = ready.withColumn("chosen", F.array_position(F.transform("options", clear), True).cast("int") - 1).withColumn("o", F.when(F.col("chosen") >= 0, F.get("options", F.col("chosen"))))
        chosen = chosen.select(*keys, "item", F.when(F.col("chosen") >= 0, F.col("chosen")).alias("chosen"), (F.col("x_mm") + F.col("o.dx")).alias("x_mm"), (F.col("y_mm") + F.col("o.dy")).alias("y_mm"), F.col("o.size").alias("phys_mm"))
        done = stored(chosen, "placed")
        decided.append(done)
        taken = done.where("chosen is not null").select(*keys, F.col("item").alias("first"), F.struct(F.col("x_mm").alias("x"), F.col("y_mm").alias("y"), F.col("phys_mm").alias("size")).alias("t"))
        new = edges.join(taken, [*keys, "first"]).select(*keys, F.col("then").alias("item"), "t")
        there = stored(new if there is None else new.unionByName(there.join(done.select(*keys, "item"), [*keys, "item"], "left_anti")), "there")
        edges = stored(edges.join(done.select(*keys, F.col("item").alias("first")), [*keys, "first"], "left_anti"), "near")
        rest = stored(rest.join(done.select(*keys, "item"), [*keys, "item"], "left_anti"), "rest")
    if not decided:
        return base.select(*keys, "item", F.lit(None).cast("int").alias("chosen"), "x_mm", "y_mm", F.lit(None).cast("double").alias("phys_mm"))
    return _union(decided)


#: Steps of a nudge in mm, and its directions.
NUDGES, DIRECTIONS = (0.1, 0.2), 12


def nudged_options(sizes: Column, nudges: tuple[float, ...] = NUDGES) -> Column:
    """For each size in turn: at its place, then moved by each step in each direction, clockwise on the canvas."""
    moves = [(0.0, 0.0)] + [(math.cos(k * math.pi / (DIRECTIONS / 2)) * r, math.sin(k * math.pi / (DIRECTIONS / 2)) * r) for r in nudges for k in range(DIRECTIONS)]
    at = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in moves))
    return F.flatten(F.transform(sizes, lambda s: F.transform(at, lambda m: F.struct(m["dx"].alias("dx"), m["dy"].alias("dy"), s.cast("double").alias("size")))))


def repair(stones: DataFrame, keys: list[str], catalogue: list[float], clearance: float = 0.15, steps: int = 1, nudges: tuple[float, ...] = NUDGES, start: str = "phys_mm") -> DataFrame:
    """Collisions resolved: larger and surer stones first; one in the way is nudged, then made smaller by up to ``steps`` sizes, or goes.

    ``stones``: keys, stone_id, x_mm, y_mm, phys_mm, score, and ``start``, the size that a stone has at first. Result: the
    stones with fate (kept, nudged, shrunk, dropped) and new x_mm, y_mm, phys_mm (null where dropped).
    """
    lower = F.filter(F.array(*(F.lit(float(s)) for s in sorted(catalogue, reverse=True))), lambda s: s < F.col(start) - 1e-6)
    options = nudged_options(F.concat(F.array(F.col(start).cast("double")), F.slice(lower, 1, steps)), nudges)
    items = stones.select(*keys, F.col("stone_id").alias("item"), F.struct(-F.col("phys_mm"), -F.col("score")).alias("rank"), "x_mm", "y_mm", options.alias("options"))
    each = 1 + len(nudges) * DIRECTIONS
    fate = F.when(F.col("chosen").isNull(), "dropped").when(F.col("chosen") >= each, "shrunk").when(F.col("chosen") > 0, "nudged").otherwise("kept")
    return place(items, keys, clearance).select(*keys, F.col("item").alias("stone_id"), fate.alias("fate"), "x_mm", "y_mm", "phys_mm")


def rescue(stones: DataFrame, keys: list[str], catalogue: list[float], clearance: float = 0.15, steps: int = 1, nudges: tuple[float, ...] = NUDGES, large: float = 4.0, rounds: int = 2) -> DataFrame:
    """``repair`` that looks again at the large stones that it drops, and has a placed one start smaller where this frees more.

    A placed stone that keeps out two dropped ones or more is made smaller, to the largest size at which those of them that
    it no longer keeps out have more area than it loses; stones of its own kind and size do not count, being drawn over each
    other. Then all are placed anew, since what was freed comes before others that took its room. ``stones`` have a ``kind``
    too: stones of one kind and size bear one code. Adds ``forced``, the size that a stone had to start with (null: its own).
    """
    rows = stored(stones.select(*keys, "stone_id", "x_mm", "y_mm", "phys_mm", "score", "kind"), "stones")
    big = rows.where(F.col("phys_mm") >= large)
    forced = stored(rows.select(*keys, "stone_id", F.col("phys_mm").cast("double").alias("forced")).limit(0), "forced")
    started = lambda df: df.join(forced, [*keys, "stone_id"], "left").withColumn("_start", F.coalesce("forced", "phys_mm"))
    sizes = F.array(*(F.lit(float(s)) for s in catalogue))
    area = lambda size: F.col(size) * F.col(size)
    for _ in range(rounds):
        fates = stored(repair(started(big), keys, catalogue, clearance, steps, nudges, "_start").withColumnRenamed("phys_mm", "_size"), "fates")
        own = big.select(*keys, "stone_id", "kind", F.col("x_mm").alias("_x"), F.col("y_mm").alias("_y"), F.col("phys_mm").alias("_own"))
        lost = F.col("fate") == "dropped"
        # the dropped as they were drawn, the placed as they stand
        both = fates.join(own, [*keys, "stone_id"]).select(*keys, "stone_id", "kind", lost.alias("lost"), F.coalesce("x_mm", "_x").alias("x_mm"), F.coalesce("y_mm", "_y").alias("y_mm"), F.coalesce("_size", "_own").cast("double").alias("phys_mm"))
        met = close_pairs(both, clearance - _EPS, keys).where(F.col("a_lost") != F.col("b_lost"))
        end = lambda is_lost, c: F.when(F.col("a_lost") == is_lost, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
        kept_out = met.select(*keys, end(False, "stone_id").alias("stone_id"), end(False, "phys_mm").alias("size"), end(True, "phys_mm").alias("lost_size"), "distance", ((F.col("a_kind") == F.col("b_kind")) & (F.col("a_phys_mm") == F.col("b_phys_mm"))).alias("same"))
        tried = kept_out.join(forced, [*keys, "stone_id"], "left_anti").withColumn("smaller", F.explode(F.filter(sizes, lambda s: s < F.col("size") - 1e-6)))
        frees = ~F.col("same") & (F.col("distance") - (F.col("smaller") + F.col("lost_size")) / 2 >= clearance - _EPS)
        sums = tried.where(frees).groupBy(*keys, "stone_id", "size", "smaller").agg(F.count("*").alias("n"), F.sum(area("lost_size")).alias("gain"))
        worth = sums.where((F.col("n") >= 2) & (F.round(F.col("gain") - area("size") + area("smaller"), 9) > 0))
        new = stored(worth.groupBy(*keys, "stone_id").agg(F.max("smaller").alias("forced")), "forced")
        if new.isEmpty():
            break
        forced = stored(forced.unionByName(new), "forced")
    return repair(started(rows), keys, catalogue, clearance, steps, nudges, "_start").join(forced, [*keys, "stone_id"], "left")


def resolve_overlap(stones: DataFrame, keys: list[str], clearance: float = -0.05, large: float = 5.0, small: float = 2.8) -> DataFrame:
    """Stones that keep clear: large ones first by size, small ones at size ``small``, surer ones first; then in the same
    order small ones get their own size back where there is room. Those for which there is none are left out.

    ``stones``: keys, stone_id, x_mm, y_mm, phys_mm, score. Result: keys, stone_id, phys_mm, measured_mm.
    """
    big = F.col("phys_mm") >= large
    rank = F.struct((~big).alias("small"), F.when(big, -F.col("phys_mm")).otherwise(0.0).alias("size"), (-F.coalesce("score", F.lit(0.0))).alias("score"))
    one = lambda *sizes: F.array(*(F.struct(F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), s.cast("double").alias("size")) for s in sizes))
    rows = stored(stones.select(*keys, F.col("stone_id").alias("item"), rank.alias("rank"), "x_mm", "y_mm", F.col("phys_mm").alias("measured_mm"), F.when(big, F.col("phys_mm")).otherwise(F.least("phys_mm", F.lit(small))).alias("_first")), "stones")
    first = place(rows.withColumn("options", one(F.col("_first"))), keys, clearance).where("chosen is not null").select(*keys, "item", "phys_mm")
    kept = stored(rows.drop("_first").join(first, [*keys, "item"]), "kept")
    grown = kept.where("measured_mm > phys_mm")
    # in its way from the start: all that do not grow, and those that do after it, at the size that they have now
    near = close_pairs(kept.withColumn("at", F.struct("rank", "item")).drop("rank"), clearance + _EPS, keys, order="item", size="measured_mm")
    sides = [near.select(*keys, F.col(f"{p}_item").alias("item"), F.col(f"{q}_x_mm").alias("x"), F.col(f"{q}_y_mm").alias("y"), F.col(f"{q}_phys_mm").alias("size"), (F.col(f"{q}_at") > F.col(f"{p}_at")).alias("_after"), (F.col(f"{q}_measured_mm") > F.col(f"{q}_phys_mm")).alias("_grows")) for p, q in ("ab", "ba")]
    ahead = stored(_union(sides).where("_after or not _grows").drop("_after", "_grows"), "ahead")
    back = place(grown.withColumn("options", one(F.col("measured_mm"), F.col("phys_mm"))), keys, clearance, ahead).select(*keys, "item", F.col("phys_mm").alias("_new"))
    return kept.join(back, [*keys, "item"], "left").select(*keys, F.col("item").alias("stone_id"), F.coalesce("_new", "phys_mm").alias("phys_mm"), "measured_mm")


#: Fixed values of the chain rule: sizes' ratio of one size and at most, centres apart by sizes, steps' ratio, colour, angle.
SAME_SIZE, TAPER, TAPER_COST, NEAREST, FARTHEST, PITCH, CHAIN_DE, LEAST_SIZE = 1.15, 1.45, 0.3, 0.6, 1.5, 1.65, 20.0, 2.2
STRAIGHT = -math.cos(math.pi / 4)


def chain_candidates(beads: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (keys, a, b, dx, dy, d, q) that a chain may have, the smaller q the better: even, of one size, straight on.

    ``beads``: keys, stone_id, x_mm, y_mm, d_mm, material, lab_l, lab_a, lab_b. The straightness of an edge is that of the best edge
    that goes on from either end.
    """
    rows = beads.where(F.col("d_mm") >= LEAST_SIZE).withColumn("_body", F.col("d_mm") * FARTHEST)
    near = close_pairs(rows, _EPS, keys, size="_body")
    mean = (F.col("a_d_mm") + F.col("b_d_mm")) / 2
    ratio = F.greatest("a_d_mm", "b_d_mm") / F.least("a_d_mm", "b_d_mm")
    differ = F.sqrt(sum((F.col(f"a_lab_{c}") - F.col(f"b_lab_{c}")) ** 2 for c in "lab"))
    fits = (ratio <= TAPER) & (F.col("distance") >= NEAREST * mean) & (F.col("distance") <= FARTHEST * mean) & ((F.col("a_material") == F.col("b_material")) | (differ <= CHAIN_DE))
    even = F.abs(F.col("distance") - mean) / mean + F.when(ratio > SAME_SIZE, TAPER_COST).otherwise(0.0)
    edges = stored(near.where(fits).select(*keys, F.col("a_stone_id").alias("a"), F.col("b_stone_id").alias("b"), (F.col("b_x_mm") - F.col("a_x_mm")).alias("dx"), (F.col("b_y_mm") - F.col("a_y_mm")).alias("dy"), F.col("distance").alias("d"), even.alias("even")), "candidates")
    # from either end: who comes, at whom, and by which way
    ways = _union([edges.select(*keys, F.col(p).alias("start"), F.col(q).alias("end"), (F.col("dx") * s).alias("dx"), (F.col("dy") * s).alias("dy"), "d") for p, q, s in (("a", "b", 1), ("b", "a", -1))])
    onward = ways.select(*keys, F.col("start").alias("end"), F.col("end").alias("next"), F.col("dx").alias("ex"), F.col("dy").alias("ey"), F.col("d").alias("e"))
    on = ways.join(onward, [*keys, "end"]).where((F.col("next") != F.col("start")) & (F.greatest("d", "e") / F.least("d", "e") <= PITCH))
    best = on.groupBy(*keys, "start", "end").agg(F.max((F.col("dx") * F.col("ex") + F.col("dy") * F.col("ey")) / F.col("d") / F.col("e")).alias("on"))
    of = lambda p, q, name: best.select(*keys, F.col("start").alias(p), F.col("end").alias(q), F.greatest("on", F.lit(0.0)).alias(name))
    met = edges.join(of("a", "b", "_ab"), [*keys, "a", "b"], "left").join(of("b", "a", "_ba"), [*keys, "a", "b"], "left")
    straight = (2 - F.coalesce("_ab", F.lit(0.0)) - F.coalesce("_ba", F.lit(0.0))) / 2
    return met.select(*keys, "a", "b", "dx", "dy", "d", rounded(F.col("even") + straight, 9).alias("q"))


def chains(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (keys, a, b, dx, dy, d, q) taken best first (ties: a, b) as long as they make smooth open chains; adds ``chain``.

    An edge is taken if both ends have one edge at most, do not hang together yet, and at either end the way goes on by 45
    degrees at most and steps of about one length. A chain can only be lengthened at its ends, and what an edge is refused
    for never goes away; so each round takes every edge that is the best one left of both chains that it would join.
    ``chain`` is the smallest node of the chain.
    """
    left = stored(edges.select(*keys, "a", "b", "dx", "dy", "d", "q"), "edges")
    one = left.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = stored(one.select("*", F.col("node").alias("chain"), F.array().cast("array<struct<dx:double,dy:double,d:double>>").alias("has")), "nodes")
    taken = []

    def smooth(has: str, sign: int) -> Column:
        way = lambda t: (t["dx"] * F.col("dx") + t["dy"] * F.col("dy")) * sign / t["d"] / F.col("d")
        return F.forall(has, lambda t: (way(t) <= STRAIGHT) & (F.greatest(t["d"], F.col("d")) / F.least(t["d"], F.col("d")) <= PITCH))

    while True:
        of = lambda n: nodes.select(*keys, F.col("node").alias(n), F.col("chain").alias(f"_c{n}"), F.col("has").alias(f"_h{n}"))  # noqa: B023, E731
        met = left.join(of("a"), [*keys, "a"]).join(of("b"), [*keys, "b"])
        met = met.where((F.col("_ca") != F.col("_cb")) & (F.size("_ha") < 2) & (F.size("_hb") < 2) & smooth("_ha", 1) & smooth("_hb", -1)).drop("_ha", "_hb")
        left = stored(met.withColumn("_e", F.struct("q", "a", "b")), "edges")
        if left.isEmpty():
            break
        best = stored(left.select(*keys, F.explode(F.array("_ca", "_cb")).alias("chain"), "_e").groupBy(*keys, "chain").agg(F.min("_e").alias("_e")), "best")
        of = lambda n: best.select(*keys, F.col("chain").alias(n), "_e")  # noqa: B023, E731
        new = stored(left.join(of("_ca"), [*keys, "_ca", "_e"], "left_semi").join(of("_cb"), [*keys, "_cb", "_e"], "left_semi").drop("_e"), "taken")
        taken.append(new.drop("_ca", "_cb"))
        ends = _union([new.select(*keys, F.col(n).alias("node"), F.struct((F.col("dx") * s).alias("dx"), (F.col("dy") * s).alias("dy"), "d").alias("_new")) for n, s in (("a", 1), ("b", -1))])
        named = _union([new.select(*keys, F.col(c).alias("chain"), F.least("_ca", "_cb").alias("_to")) for c in ("_ca", "_cb")])
        moved = nodes.join(ends, [*keys, "node"], "left").join(named, [*keys, "chain"], "left")
        nodes = stored(moved.select(*keys, "node", F.coalesce("_to", "chain").alias("chain"), F.when(F.col("_new").isNull(), F.col("has")).otherwise(F.concat("has", F.array("_new"))).alias("has")), "nodes")
        left = left.drop("_ca", "_cb", "_e")
    if not taken:
        return left.drop("_ca", "_cb", "_e").withColumn("chain", F.col("a"))
    return _union(taken).join(nodes.select(*keys, F.col("node").alias("a"), "chain"), [*keys, "a"])


def label_votes(beads: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, item, other, weight): neighbours of about one size, weighing more the nearer they are to the usual distance.

    Neighbours are centres within 1.35 mean sizes and half a millimetre; one size is a ratio of 1.4 at most; the usual
    distance is the upper median of an item's.
    """
    near = close_pairs(beads.select(*keys, "stone_id", "x_mm", "y_mm", "d_mm").withColumn("_body", F.col("d_mm") * 1.35), 0.5 + _EPS, keys, size="_body")
    near = near.where((F.col("distance") <= 1.35 * (F.col("a_d_mm") + F.col("b_d_mm")) / 2 + 0.5) & (F.greatest("a_d_mm", "b_d_mm") / F.least("a_d_mm", "b_d_mm") <= 1.4))
    each = both_ends(near, keys, ["distance"]).select(*keys, F.col("stone_id").alias("item"), "other", "distance")
    usual = each.groupBy(*keys, "item").agg(F.array_sort(F.collect_list("distance")).alias("d")).select(*keys, "item", F.get("d", F.floor(F.size("d") / 2).cast("int")).alias("usual"))
    off = F.abs(F.col("distance") - F.col("usual")) / F.greatest(F.lit(0.3), 0.15 * F.col("usual"))
    return each.join(usual, [*keys, "item"]).select(*keys, "item", "other", rounded(1 / (1 + off), 9).alias("weight"))


def propagate(items: DataFrame, votes: DataFrame, keys: list[str], passes: int = 3, sure: float = 0.5, floor: float = 0.2, share: float = 0.7, least: float = 1.0, voters: int = 2) -> DataFrame:
    """Unsure labels that follow their neighbours', in place: passes in the order of the items, in which a change is seen by those after.

    ``items``: keys, item, label, conf, fixed (never changes). ``votes``: keys, item, other, weight. An item with ``conf``
    under ``sure`` and at least ``voters`` votes takes the label with most weight (ties: the smaller label), each vote
    weighing its own and the other's conf (``floor`` at least), if that is ``share`` of all and ``least`` or more; it is then
    sure. Only unsure items wait for each other. Adds ``was``.
    """
    rows = items.select(*keys, "item", "label", "conf", F.col("label").alias("was"))
    open_ = items.where(~F.col("fixed") & (F.col("conf") < sure)).select(*keys, "item")
    heard = votes.join(votes.groupBy(*keys, "item").count().where(F.col("count") >= voters).drop("count"), [*keys, "item"], "left_semi").join(open_, [*keys, "item"], "left_semi")
    heard = stored(heard.select(*keys, "item", "other", "weight"), "votes")
    asked = heard.select(*keys, "item").distinct()
    order = heard.join(asked.withColumnRenamed("item", "other"), [*keys, "other"], "left_semi").where("other < item")
    wave = stored(waves(asked.withColumnRenamed("item", "node"), order.select(*keys, F.col("other").alias("first"), F.col("item").alias("then")), keys).withColumnRenamed("node", "item"), "waves")
    last = wave.agg(F.max("wave")).first()[0]
    state = stored(rows, "labels")
    for _ in range(passes if last is not None else 0):
        changed = 0
        for w in range(last + 1):
            now = wave.where(F.col("wave") == w).drop("wave").join(state.where(F.col("conf") < sure), [*keys, "item"]).select(*keys, "item", F.col("label").alias("own"))
            said = heard.join(now, [*keys, "item"]).join(state.select(*keys, F.col("item").alias("other"), "label", "conf"), [*keys, "other"])
            sums = said.groupBy(*keys, "item", "own", "label").agg(F.round(F.sum(F.greatest("conf", F.lit(floor)) * F.col("weight")), 9).alias("w"))
            top = sums.groupBy(*keys, "item", "own").agg(F.min(F.struct(-F.col("w"), "label")).alias("t"), F.sum("w").alias("all")).select(*keys, "item", "own", F.col("t.label").alias("to"), (-F.col("t.col1")).alias("w"), "all")
            new = stored(top.where((F.col("to") != F.col("own")) & (F.col("w") >= share * F.col("all") - _EPS) & (F.col("w") >= least - _EPS)).select(*keys, "item", "to"), "changed")
            n = new.count()
            changed += n
            if n:
                state = stored(state.join(new, [*keys, "item"], "left").select(*keys, "item", F.coalesce("to", "label").alias("label"), F.when(F.col("to").isNotNull(), F.lit(sure)).otherwise(F.col("conf")).alias("conf"), "was"), "labels")
        if not changed:
            break
    return state


def diffuse(items: DataFrame, edges: DataFrame, keys: list[str], strength: float = 1.0) -> DataFrame:
    """Error diffusion on a graph: in the order of the items each takes the code nearest to its colour and the errors passed on
    to it, and passes ``strength`` of its own error on, evenly, to the neighbours that come after it.

    ``items``: keys, item (its place in the order), lab_l, lab_a, lab_b, palette (array of code, l, a, b; few). ``edges``:
    keys, a, b. Result: keys, item, code. Nearest is by CIEDE2000, to nine digits, ties to the smaller code.
    """
    ways = stored(edges.select(*keys, F.least("a", "b").alias("first"), F.greatest("a", "b").alias("then")).where("first <> then").distinct(), "ways")
    after = ways.groupBy(*keys, F.col("first").alias("item")).agg(F.count("*").alias("_after"))
    base = items.join(after, [*keys, "item"], "left")
    wave = waves(items.select(*keys, F.col("item").alias("node")), ways, keys).withColumnRenamed("node", "item")
    base = stored(base.join(wave, [*keys, "item"]), "items")
    last = base.agg(F.max("wave")).first()[0]
    passed, done = None, []
    for w in range(-1 if last is None else last + 1):
        now = base.where(F.col("wave") == w)
        got = [F.lit(0.0).alias(f"_{c}") for c in "lab"]
        if passed is not None:
            # summed in the order in which they came
            of = passed.groupBy(*keys, "item").agg(F.array_sort(F.collect_list(F.struct("first", "l", "a", "b"))).alias("e"))
            now = now.join(of, [*keys, "item"], "left")
            got = [F.coalesce(F.aggregate("e", F.lit(0.0), lambda s, e: s + e[c]), F.lit(0.0)).alias(f"_{c}") for c in "lab"]  # noqa: B023
        now = now.select(*keys, "item", "_after", "palette", *got, "lab_l", "lab_a", "lab_b").select(*keys, "item", "_after", "palette", *((F.col(f"lab_{c}") + F.col(f"_{c}")).alias(f"p_{c}") for c in "lab"))
        rows = now.select(*keys, "item", "_after", "p_l", "p_a", "p_b", F.explode("palette").alias("c")).select("*", "c.code", *(F.col(f"c.{c}").alias(f"q_{c}") for c in "lab")).drop("c")
        best = color.add(rows, color.de2000_steps("p", "q"), ["de"]).groupBy(*keys, "item", "_after").agg(F.min(F.struct(F.round("de", 9).alias("de"), "code", "q_l", "q_a", "q_b", "p_l", "p_a", "p_b")).alias("m"))
        done.append(stored(best.select(*keys, "item", "_after", "m.code", *(((F.col(f"m.p_{c}") - F.col(f"m.q_{c}")) * strength / F.col("_after")).alias(c) for c in "lab")), "diffused"))
        new = ways.join(done[-1].where("_after is not null").select(*keys, F.col("item").alias("first"), "l", "a", "b"), [*keys, "first"]).select(*keys, F.col("then").alias("item"), "first", "l", "a", "b")
        passed = stored(new if passed is None else new.unionByName(passed.join(done[-1], [*keys, "item"], "left_anti")), "passed")
    return _union([d.select(*keys, "item", "code") for d in done]) if done else items.select(*keys, "item", F.lit(None).cast("long").alias("code"))


def despeckle(items: DataFrame, edges: DataFrame, codes: DataFrame, keys: list[str], least: int = 2, farthest: float = 20.0, passes: int = 2) -> DataFrame:
    """Stray colours that give way, in place: passes in the order of the items over clusters of neighbours of one code.

    A cluster of fewer than ``least`` items, none of them ``fixed``, takes the code that most links to its neighbours bear
    (ties: nearest by CIEDE2000 to the cluster's mean colour, to nine digits; smaller code), unless it is more than
    ``farthest`` from that colour. A cluster is looked at once a pass, when its first item comes up that was not looked at.

    ``items``: keys, item, code, lab_l, lab_a, lab_b, fixed. ``edges``: keys, a, b. ``codes``: code, lab_l, lab_a, lab_b.
    Result: keys, item, code, was. Clusters only grow, so what is large at the start of a pass or holds a fixed item never
    changes in it, and only items of small clusters wait for each other: those that a step can reach, 2 * least - 3 links
    away through small clusters.
    """
    state = stored(items.select(*keys, "item", "code", F.col("code").alias("was"), "fixed", "lab_l", "lab_a", "lab_b"), "codes")
    ends = F.array(F.struct(F.col("a").alias("item"), F.col("b").alias("other")), F.struct(F.col("b").alias("item"), F.col("a").alias("other")))
    links = stored(edges.where("a <> b").select(*keys, F.explode(ends).alias("e")).select(*keys, "e.*").distinct(), "links")
    of = lambda df, c: df.select(*keys, F.col("item").alias(c))
    known = codes.select(F.col("code").alias("to"), *(F.col(f"lab_{c}").alias(f"q_{c}") for c in "lab"))

    def clusters(starts: DataFrame) -> DataFrame:
        """(keys, start, item, code, colour) of the whole clusters of those starts that lie in small ones without a fixed item."""
        own = Window.partitionBy(*keys, "start")
        found = starts.join(state.drop("was"), [*keys, "item"]).where("not fixed").withColumn("start", F.col("item"))
        for _ in range(least - 1):
            same = state.drop("was").withColumnRenamed("item", "other")
            more = found.select(*keys, "start", "item", "code").join(links, [*keys, "item"]).drop("item").join(same, [*keys, "other", "code"]).withColumnRenamed("other", "item")
            found = found.unionByName(more).dropDuplicates([*keys, "start", "item"]).withColumns({"_n": F.count("*").over(own), "_bad": F.max("fixed").over(own)})
            found = found.where((F.col("_n") < least) & ~F.col("_bad")).drop("_n", "_bad")
        return stored(found.drop("fixed"), "clusters")

    for _ in range(passes):
        soft = clusters(of(state, "item"))
        pending = stored(soft.select(*keys, "item").distinct(), "pending")
        inner = stored(links.join(pending, [*keys, "item"], "left_semi").join(of(pending, "other"), [*keys, "other"], "left_semi"), "inner")
        reach = inner.select(*keys, F.col("item").alias("first"), F.col("other").alias("then"))
        for _ in range(2 * least - 4):
            onward = reach.join(inner.select(*keys, F.col("item").alias("then"), "other"), [*keys, "then"]).select(*keys, "first", F.col("other").alias("then"))
            reach = stored(reach.unionByName(onward).distinct(), "reach")
        waits, changed = stored(reach.where("first < then"), "waits"), False
        while not pending.isEmpty():
            ready = pending.join(waits.select(*keys, F.col("then").alias("item")), [*keys, "item"], "left_anti")
            held = clusters(ready)
            beside = held.select(*keys, "start", "item", "code").join(links, [*keys, "item"]).join(state.select(*keys, F.col("item").alias("other"), F.col("code").alias("to")), [*keys, "other"]).where("to <> code")
            votes = beside.groupBy(*keys, "start", "to").agg(F.count("*").alias("n"))
            top = votes.withColumn("_most", F.max("n").over(Window.partitionBy(*keys, "start"))).where("n = _most").select(*keys, "start", "to")
            mean = held.groupBy(*keys, "start").agg(*(F.round(F.sum(f"lab_{c}") / F.count("*"), 9).alias(f"p_{c}") for c in "lab"))
            near = color.add(top.join(mean, [*keys, "start"]).join(known, "to"), color.de2000_steps("p", "q"), ["de"])
            pick = near.groupBy(*keys, "start").agg(F.min(F.struct(F.round("de", 9).alias("de"), "to")).alias("m")).where(F.col("m.de") <= farthest).select(*keys, "start", "m.to")
            new = stored(held.select(*keys, "start", "item").join(pick, [*keys, "start"]).select(*keys, "item", "to"), "changed")
            if not new.isEmpty():
                changed = True
                state = stored(state.join(new, [*keys, "item"], "left").withColumn("code", F.coalesce("to", "code")).drop("to"), "codes")
            seen = of(held, "item").unionByName(ready)
            pending = stored(pending.join(seen, [*keys, "item"], "left_anti"), "pending")
            waits = stored(waits.join(of(pending, "first"), [*keys, "first"], "left_semi").join(of(pending, "then"), [*keys, "then"], "left_semi"), "waits")
        if not changed:
            break
    return state.select(*keys, "item", "code", "was")


# A part is smaller than this much of its whole and lies this far within; a cluster has so many parts and area.
PART, WITHIN, CLUSTER, CLUSTER_AREA = 0.62, 0.85, 3, 0.45
#: Two masks of one bead are nearer, and differ less in size, than this much of it.
TWIN = 0.35


def absorb(beads: DataFrame, keys: list[str]) -> DataFrame:
    """What becomes of each bead (keys, stone_id, x_mm, y_mm, d_mm, score): keys, stone_id, fate.

    Largest first (ties: stone_id), a bead that still stands looks at the smaller ones that still stand within it: if they
    are a cluster it is no bead (``cluster``), else they are its parts (``part``). Of those left, surest first (ties: larger,
    stone_id), one that nearly coincides with a kept one is its ``twin``; the others are ``kept``. A bead waits only for
    those that hold it or a part of it, in a chain for each part, so a round takes all that wait for nothing.
    """
    rows = stored(beads.select(*keys, F.col("stone_id").alias("item"), "x_mm", "y_mm", "d_mm", "score"), "beads")
    near = stored(close_pairs(rows, 1e-9, keys, order="item", size="d_mm"), "near")
    turned = F.col("b_d_mm") > F.col("a_d_mm")
    end = lambda p, q, c: F.when(turned, F.col(f"{q}_{c}")).otherwise(F.col(f"{p}_{c}"))
    held = near.select(*keys, end("a", "b", "item").alias("whole"), end("b", "a", "item").alias("part"), end("a", "b", "d_mm").alias("wide"), end("b", "a", "d_mm").alias("small"), "distance")
    held = stored(held.where((F.col("small") < PART * F.col("wide")) & (F.col("distance") < 0.5 * F.col("wide") * WITHIN)), "held")
    chain = held.withColumn("_next", F.lead("whole").over(Window.partitionBy(*keys, "part").orderBy(F.desc("wide"), "whole")))
    order = chain.select(*keys, F.col("whole").alias("first"), F.coalesce("_next", "part").alias("then"))
    level = stored(waves(held.select(*keys, F.col("whole").alias("node")).unionByName(held.select(*keys, F.col("part").alias("node"))), order, keys), "waves")
    most = level.agg(F.max("wave")).first()[0]
    gone = rows.select(*keys, "item").limit(0).withColumn("fate", F.lit(""))
    of_wave = held.join(level.select(*keys, F.col("node").alias("whole"), "wave"), [*keys, "whole"])
    for wave in range(0 if most is None else most + 1):
        dead = lambda c: gone.select(*keys, F.col("item").alias(c))  # noqa: B023, E731
        live = stored(of_wave.where(F.col("wave") == wave).join(dead("whole"), [*keys, "whole"], "left_anti").join(dead("part"), [*keys, "part"], "left_anti"), "live")
        sums = live.groupBy(*keys, "whole").agg(F.count("*").alias("n"), (F.sum(F.col("small") * F.col("small")) / F.max(F.col("wide") * F.col("wide"))).alias("area"))
        clusters = stored(sums.where((F.col("n") >= CLUSTER) & (F.col("area") >= CLUSTER_AREA)).select(*keys, "whole"), "clusters")
        parts = live.join(clusters, [*keys, "whole"], "left_anti").select(*keys, F.col("part").alias("item")).distinct()
        gone = stored(gone.unionByName(clusters.select(*keys, F.col("whole").alias("item"), F.lit("cluster").alias("fate"))).unionByName(parts.withColumn("fate", F.lit("part"))), "gone")
    left = near.where((F.col("distance") < TWIN * F.least("a_d_mm", "b_d_mm")) & (F.abs(F.col("a_d_mm") - F.col("b_d_mm")) < TWIN * F.greatest("a_d_mm", "b_d_mm")))
    for c in "ab":
        left = left.join(gone.select(*keys, F.col("item").alias(f"{c}_item")), [*keys, f"{c}_item"], "left_anti")
    rank = lambda p: F.struct(-F.col(f"{p}_score"), -F.col(f"{p}_d_mm"), F.col(f"{p}_item"))
    ahead = rank("a") < rank("b")
    edges = stored(left.select(*keys, F.when(ahead, F.col("a_item")).otherwise(F.col("b_item")).alias("first"), F.when(ahead, F.col("b_item")).otherwise(F.col("a_item")).alias("then")), "twins")
    twins = gone.select(*keys, "item").limit(0)
    while not edges.isEmpty():
        # what nothing stands before is kept, and all that it strikes falls
        kept = edges.select(*keys, "first").distinct().join(edges.select(*keys, F.col("then").alias("first")), [*keys, "first"], "left_anti")
        struck = stored(edges.join(kept, [*keys, "first"], "left_semi").select(*keys, F.col("then").alias("item")).distinct(), "struck")
        twins = stored(twins.unionByName(struck), "fallen")
        # a kept one's edges are all done; a fallen one strikes nothing
        for c in ("first", "then"):
            edges = edges.join(struck.select(*keys, F.col("item").alias(c)), [*keys, c], "left_anti")
        edges = stored(edges, "twins")
    fates = gone.unionByName(twins.withColumn("fate", F.lit("twin")))
    return rows.join(fates, [*keys, "item"], "left").select(*keys, F.col("item").alias("stone_id"), F.coalesce("fate", F.lit("kept")).alias("fate"))
