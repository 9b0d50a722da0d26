"""Outlines and their gaps against loops over points and sides."""

import math
import random

import numpy as np
import pytest

from lapidary.functions import shapes
from lapidary.operators import qc, shaped, spatial, symmetry


def side_distance(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    k = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / ((dx * dx + dy * dy) or 1.0)))
    return math.hypot(p[0] - a[0] - k * dx, p[1] - a[1] - k * dy)


def loop_gap(p, q):
    deep, apart, overlap = 0.0, math.inf, False
    for one, two in ((p, q), (q, p)):
        sides = list(zip(two, np.roll(two, -1, axis=0)))
        for x in one:
            d = min(side_distance(x, a, b) for a, b in sides)
            crossed = sum((a[1] > x[1]) != (b[1] > x[1]) and x[0] < (b[0] - a[0]) * (x[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in sides)
            apart = min(apart, d)
            if crossed % 2:
                overlap, deep = True, max(deep, d)
    return -deep if overlap else apart


def polygon(shape, x, y, w, h, rot):
    p = shapes.OUTLINES.get(shape, shapes.ellipse)(w, h)
    c, s = math.cos(math.radians(rot)), math.sin(math.radians(rot))
    return np.stack([x + p[:, 0] * c - p[:, 1] * s, y + p[:, 0] * s + p[:, 1] * c], 1)


def test_outlines_fill_their_boxes():
    for name, w, h in (("marquise", 2.6, 5.2), ("teardrop", 3.0, 5.0), ("heart", 6.0, 5.0), ("star", 4.0, 4.0), ("flower", 4.0, 3.0)):
        p = polygon(name, 0, 0, w, h, 0)
        assert (abs(p).max(axis=0) <= (w / 2 + 1e-9, h / 2 + 1e-9)).all() and abs(p[:, 1]).max() == pytest.approx(h / 2, rel=0.2)
    lens = shapes.marquise(2.0, 4.0)
    r = (4 + 16) / 8  # the circle through both tips and the middle of the side
    assert len(lens) == 64 and np.hypot(np.abs(lens[:, 0]) + r - 1, lens[:, 1]) == pytest.approx(np.full(64, r)) and lens[0] == pytest.approx((0, -2))
    drop = shapes.teardrop(2.0, 4.0)
    assert drop[-1] == pytest.approx((0, 2)) and np.hypot(drop[:-1, 0], drop[:-1, 1] + 1) == pytest.approx(np.ones(63))
    assert (drop[0] - drop[-1]) @ (drop[0] - (0, -1)) == pytest.approx(0)  # a tangent
    tip = shapes.heart(4.0, 4.0)
    assert tip[:, 1].max() == pytest.approx(2) and tip[tip[:, 1].argmax()] == pytest.approx((0, 2))


def test_shaped_pairs(spark):
    r = random.Random(4)
    kinds = ["round", "heart", "marquise", "teardrop", "star", "flower"]
    rows = []
    for g in range(3):
        for i in range(60):
            kind, size = r.choice(kinds), r.choice([2.8, 5.0, 12.0])
            rows.append((g, i, r.uniform(0, 60), r.uniform(0, 60), size, kind, size * r.choice([0.5, 1.0]) if kind != "round" else 99.0, size, r.uniform(0, 360)))
    rows += [(7, 0, 0.0, 0.0, 2.8, "round", 2.8, 2.8, 0.0), (7, 1, 3.0, 0.0, 2.8, "round", 2.8, 2.8, 0.0), (8, 0, 5.0, 5.0, 6.0, "heart", 6.0, 6.0, 10.0), (8, 1, 5.0, 5.0, 6.0, "heart", 6.0, 6.0, 10.0)]
    df = spark.createDataFrame(rows, "design_id int, stone_id long, x_mm double, y_mm double, phys_mm double, shape string, w_mm double, h_mm double, rot_deg double")
    want = {}
    for p in rows:
        for q in rows:
            if p[0] == q[0] and p[1] < q[1] and math.hypot(p[2] - q[2], p[3] - q[3]) < 20:
                if p[5] == q[5] == "round":
                    gap = math.hypot(p[2] - q[2], p[3] - q[3]) - (p[4] + q[4]) / 2
                else:
                    gap = loop_gap(*(polygon(s[5], s[2], s[3], *((s[4], s[4]) if s[5] == "round" else s[6:8]), s[8]) for s in (p, q)))
                if gap < 0.3:
                    want[p[0], p[1], q[1]] = gap
    got = {(x["design_id"], x["a_stone_id"], x["b_stone_id"]): x["gap"] for x in shaped.shaped_pairs(df, 0.3, ["design_id"]).collect()}
    assert got == pytest.approx(want) and len(want) > 40 and got[7, 0, 1] == pytest.approx(0.2)
    assert shaped.shaped_pairs(df.limit(0), 0.3, ["design_id"]).count() == 0
    # the checks take the shapes where the stones have them
    n = {(x["design_id"], x["check_id"]): x["n"] for x in qc.run(df, {}, ["overlap"]).collect()}
    assert n == {(g, "overlap"): k for g in {0, 1, 2, 8} if (k := sum(d == g and v < -0.05 for (d, _, _), v in want.items()))}
    plain = {(x["design_id"], x["check_id"]): x["n"] for x in qc.run(df.drop("shape"), {}, ["overlap"]).collect()}
    assert plain != n and spatial.close_pairs(df, -0.05, ["design_id"]).count() == sum(plain.values())


def test_axis_of_a_mirrored_picture(spark):
    """Two pictures, each with a mirror image of itself and some cells that have none, against a loop over axes."""
    r = random.Random(8)
    cells = {}
    for g, axis in ((0, 37), (1, 30)):
        for y in range(20):
            for x in range(axis // 2 - 12, axis // 2 + 1):
                if r.random() < 0.8:
                    lab = tuple(r.uniform(0, 80) for _ in range(3))
                    cells[g, x, y] = lab
                    cells[g, axis - x, y] = tuple(v + r.uniform(-3, 3) for v in lab)
        for _ in range(15):
            cells[g, r.randrange(0, 40), r.randrange(20, 24)] = (50.0, 0.0, 0.0)
    df = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "g long, px int, py int, lab_l double, lab_a double, lab_b double")
    curve = symmetry.axis_curve(df, ["g"], 40, 10, 60)
    got = {(x["g"], x["axis"]): (x["both"], x["any"], x["cost"]) for x in curve.collect()}
    for g in (0, 1):
        for s in range(10, 61):
            own = {(x, y): v for (d, x, y), v in cells.items() if d == g}
            met = [min(50.0, math.dist(v, own[s - x, y])) for (x, y), v in own.items() if (s - x, y) in own]
            either = set(own) | {(s - x, y) for x, y in own if 0 <= s - x < 40}
            assert got.get((g, s)) == ((len(met), len(either), pytest.approx(sum(met) / len(met))) if met else None)
    best = {x["g"]: x for x in symmetry.best_axis(curve, ["g"], 2.0).collect()}
    assert best[0]["axis"] == 37 and best[1]["axis"] == 30 and best[0]["axis_mm"] == pytest.approx(38, abs=0.6)
    free = {x["g"]: x["axis"] for x in symmetry.best_axis(curve, ["g"], 2.0, masked=False).collect()}
    assert free == {0: 37, 1: 30}
    assert symmetry.best_axis(symmetry.axis_curve(df.limit(0), ["g"], 40, 10, 60), ["g"], 2.0).count() == 0
