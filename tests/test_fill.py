"""Filled places, their growth and the absorption of parts against plain loops."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from lapidary.operators import fill, ordered

KEY = ["g"]
RULE = fill.Fill()
BEADS = "g long, stone_id long, x_mm double, y_mm double, d_mm double, shape string, material string, lab_l double, lab_a double, lab_b double, solidity double"


def shade(p, q, weight=RULE.l_weight):
    return math.sqrt(weight * weight * (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2)


def upper(values):
    return sorted(values)[len(values) // 2]


@pytest.fixture(scope="module")
def drawn():
    """Lattices with jitter, some even, some uneven, a row of beads, and strewn ones."""
    r, out = random.Random(5), {}
    for g in range(12):
        rows = []
        for k, (even, n, m) in enumerate([(True, 8, 8), (False, 9, 9), (False, 1, 20)]):
            step = (2.6, 2.9, 3.2)[g % 3]
            for i in range(n):
                for j in range(m):
                    size = 2.8 if even else r.choice([2.0, 2.6, 3.2])
                    rows.append((4 + i * step + 26 * k + r.uniform(-0.2, 0.2), 4 + j * step + r.uniform(-0.2, 0.2), size, "round", "gold" if k == 1 else "color", (40.0 + r.randrange(20), 20.0 + 5 * k, 10.0 + r.randrange(8)), 0.85 if not even and r.random() < 0.5 else 0.95))
        for _ in range(25):
            rows.append((r.uniform(0, 90), r.uniform(0, 70), r.choice([2.0, 4.0, 7.0]), r.choice(["round", "heart"]), "color", (r.uniform(0, 90), r.uniform(-60, 60), r.uniform(-60, 60)), 0.95))
        out[g] = [(i, *row) for i, row in enumerate(rows)]
    return out


def frame(spark, drawn):
    return spark.createDataFrame([(g, i, x, y, d, s, m, *lab, sol) for g, rows in drawn.items() for i, x, y, d, s, m, lab, sol in rows], BEADS)


def signs(rows, rule=RULE, smallest=2.8):
    small = [b for b in rows if b[4] == "round" and b[3] <= rule.largest]
    spots = set()
    for _, x, y, dm, *_ in rows:
        cx, cy, r = x / rule.cell, y / rule.cell, dm / 2 / rule.cell
        spots |= {(u, v) for v in range(math.ceil(cy - r), math.floor(cy + r) + 1) for u in range(math.ceil(cx - r), math.floor(cx + r) + 1) if (u - cx) ** 2 + (v - cy) ** 2 <= r * r}
    out = {}
    for b in small:
        reach = rule.reach * max(b[3], rule.least_size)
        near = [t for t in small if t is not b and t[5] == b[5] and math.hypot(t[1] - b[1], t[2] - b[2]) <= reach and shade(t[6], b[6]) <= rule.de]
        xx, yy, xy = sum((t[1] - b[1]) ** 2 for t in near), sum((t[2] - b[2]) ** 2 for t in near), sum((t[1] - b[1]) * (t[2] - b[2]) for t in near)
        root = math.sqrt((xx - yy) ** 2 / 4 + xy * xy)
        two_d = ((xx + yy) / 2 - root) / ((xx + yy) / 2 + root) if near else 0.0
        a = reach / rule.cell * math.sqrt(math.pi) / 2
        x0, x1, y0, y1 = (math.floor(v + 0.5) for v in (b[1] / rule.cell - a, b[1] / rule.cell + a, b[2] / rule.cell - a, b[2] / rule.cell + a))
        covered = sum((u, v) in spots for u in range(x0, x1) for v in range(y0, y1)) / ((x1 - x0) * (y1 - y0))
        sizes = [t[3] for t in [b, *near]]
        mean = sum(sizes) / len(sizes)
        cv = math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)) / mean
        asked = len(near) >= rule.near and two_d >= rule.spread
        out[b[0]] = (len(near), two_d, cv, sum(t[7] < rule.whole for t in [b, *near]) / len(sizes), sum(s < 0.9 * smallest for s in sizes) / len(sizes), covered if asked else None, asked and covered >= rule.cover)
    return out


def test_surroundings_and_regions_are_the_loop(spark, drawn):
    beads = frame(spark, drawn)
    around = fill.surroundings(beads, KEY, F.lit(2.8))
    got = {(r["g"], r["stone_id"]): (r["n"], r["two_d"], r["cv"], r["frag"], r["sub"], r["cover"], r["dense"]) for r in around.collect()}
    want = {(g, i): v for g, rows in drawn.items() for i, v in signs(rows).items()}
    assert got.keys() == want.keys() and len({v[6] for v in want.values()}) == 2
    for k, v in want.items():
        assert got[k][0] == v[0] and got[k][6] == v[6] and got[k][1:5] == pytest.approx(v[1:5], abs=1e-5), k
        assert (got[k][5] is None) == (v[5] is None) and (v[5] is None or got[k][5] == pytest.approx(v[5], abs=1e-6)), k

    members, rated = fill.regions(beads, around.where("dense"), KEY, F.lit(2.8))
    named = {(r["g"], r["stone_id"]): r["region"] for r in members.collect()}
    told = {(r["g"], r["region"]): r for r in rated.collect()}
    seen = collections.Counter()
    for g, rows in drawn.items():
        rest = {b[0]: b for b in rows if (g, b[0]) in want and want[g, b[0]][6]}
        while rest:
            first = min(rest)
            todo, lot = [rest.pop(first)], []
            while todo:
                u = todo.pop()
                lot.append(u)
                for t in list(rest.values()):
                    if t[5] == u[5] and shade(t[6], u[6]) <= RULE.de and math.hypot(t[1] - u[1], t[2] - u[2]) <= RULE.link * (t[3] + u[3]) / 2:
                        todo.append(rest.pop(t[0]))
            assert all(named[g, u[0]] == first for u in lot)
            apart = lambda u, t: math.hypot(t[1] - u[1], t[2] - u[2])
            links = [[apart(u, t) for t in lot if t is not u and apart(u, t) <= RULE.link * (t[3] + u[3]) / 2] for u in lot]
            sizes = [u[3] for u in lot]
            mean = sum(sizes) / len(lot)
            inner, cv = sum(len(x) >= 3 for x in links) / len(lot), math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(lot)) / mean
            frag, sub = sum(u[7] < RULE.whole for u in lot) / len(lot), sum(s < 0.9 * 2.8 for s in sizes) / len(lot)
            even = inner < RULE.solid and cv < RULE.cv and frag < RULE.broken and sub < RULE.under
            verdict = "few" if len(lot) < RULE.beads else "thin" if inner < RULE.inner else "tidy" if even else "fill"
            steps = [min(x) for x, u in zip(links, lot) if x and min(x) <= 1.6 * u[3]]
            r = told[g, first]
            assert (r["beads"], r["verdict"], r["drawn_mm"]) == (len(lot), verdict, upper(sizes)) and r["inner"] == pytest.approx(inner) and r["cv"] == pytest.approx(cv, abs=1e-5)
            assert r["pitch_mm"] == pytest.approx(upper(steps) if len(steps) >= 5 else upper(sizes)) and r["lab_l"] == upper([u[6][0] for u in lot])
            seen[verdict] += 1
    assert {"fill", "few"} <= seen.keys() and sum(seen.values()) == len(told)


def test_filling_takes_the_largest_size_with_room(spark):
    found = spark.createDataFrame([(1, "color", 4.0), (2, "color", 1.0), (3, "pearl", 3.0), (4, "pearl", 6.0), (5, "gold", 9.0)], "region int, material string, pitch_mm double")
    sizes = spark.createDataFrame([("color", [2.8, 4.0, 5.0]), ("pearl", [4.0, 5.0]), ("white", [2.8, 4.0])], "material string, sizes array<double>")
    rows = {r["region"]: (r["with"], r["phys_mm"]) for r in fill.filling(found, sizes).collect()}
    assert rows == {1: ("color", 4.0), 2: ("color", 2.8), 3: ("white", 2.8), 4: ("pearl", 5.0), 5: ("gold", None)}


def queue(cells, seeds, most=20.0):
    """Regions one after the other, cell by cell."""
    own, refs = {}, {}
    free = lambda at, m: at in cells and at not in own and cells[at][1] in (None, m)
    for turn in sorted({s[0] for s in seeds}):
        material = next(s[1] for s in seeds if s[0] == turn)
        start = [s[2] for s in seeds if s[0] == turn and free(s[2], material)]
        if not start:
            continue
        ref = tuple(upper([cells[c][0][k] for c in start]) for k in range(3))
        refs[turn] = (material, ref)
        for c in start:
            own[c] = turn
        todo = collections.deque(start)
        while todo:
            x, y = todo.popleft()
            for at in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
                if free(at, material) and shade(cells[at][0], ref) <= most:
                    own[at] = turn
                    todo.append(at)
    group = {t: t for t in refs}
    changed = True
    while changed:
        changed = False
        for (x, y), t in own.items():
            for at in ((x + 1, y), (x, y + 1)):
                u = own.get(at, t)
                if u != t and refs[t][0] == refs[u][0] and shade(refs[t][1], refs[u][1]) <= most and group[t] != group[u]:
                    group[t] = group[u] = min(group[t], group[u])
                    changed = True
    return own, refs, group


def test_growth_is_the_queue(spark):
    r, cells, seeds, want_own, want = random.Random(8), [], [], {}, {}
    for g in range(60):
        w, h = r.randrange(1, 14), r.randrange(1, 14)
        tones = [(30.0, 0.0, 0.0), (60.0, 12.0, 6.0), (40.0, 50.0, 0.0)]
        grid = {}
        for x in range(w):
            for y in range(h):
                if r.random() < 0.93:
                    tone = tones[(x // 4 + y // 5 + g) % 3]
                    grid[x, y] = (tuple(v + r.uniform(-9, 9) for v in tone), r.choice([None] * 8 + ["gold", "color", "detail"]))
        own_seeds = []
        for turn in range(1, r.randrange(1, 6)):
            x, y, m = r.randrange(w), r.randrange(h), r.choice(["gold", "color"])
            own_seeds += [(turn, m, (x + i, y + j)) for i in (0, 1) for j in (0, 1)]
        cells += [(g, x, y, *lab, held) for (x, y), (lab, held) in grid.items()]
        seeds += [(g, t, m, *at) for t, m, at in own_seeds]
        own, refs, group = queue(grid, own_seeds)
        want_own |= {(g, *at): t for at, t in own.items()}
        want |= {(g, t): (m, *ref, sum(u == t for u in own.values()), group[t]) for t, (m, ref) in refs.items()}
    table = spark.createDataFrame(cells, "g long, px long, py long, lab_l double, lab_a double, lab_b double, held string")
    sown = spark.createDataFrame(seeds, "g long, turn int, material string, px long, py long")
    own, found = fill.grow(table, sown, KEY)
    assert {(r["g"], r["px"], r["py"]): r["turn"] for r in own.collect()} == want_own
    got = {(r["g"], r["turn"]): (r["material"], r["lab_l"], r["lab_a"], r["lab_b"], r["cells"], r["merged"]) for r in found.collect()}
    assert got == want and any(v[5] < k[1] for k, v in want.items())


def test_growth_of_nothing(spark):
    table = spark.createDataFrame([(1, 0, 0, 1.0, 1.0, 1.0, None)], "g long, px long, py long, lab_l double, lab_a double, lab_b double, held string")
    own, found = fill.grow(table, spark.createDataFrame([], "g long, turn int, material string, px long, py long"), KEY)
    assert own.count() == 0 and found.count() == 0


def test_absorption_is_the_loop(spark):
    r, rows, want = random.Random(3), [], {}
    for g in range(400):
        side = r.choice([6, 12, 20])
        beads = [(i, r.uniform(0, side), r.uniform(0, side), r.choice([1.5, 2.0, 2.1, 3.4, 3.5, 6.0, 6.2, 12.0]), r.choice([0.2, 0.5, 0.9])) for i in range(r.randrange(0, 16))]
        rows += [(g, *b) for b in beads]
        fate, line = {}, sorted(beads, key=lambda b: (-b[3], b[0]))
        for b in line:
            if b[0] in fate:
                continue
            parts = [s for s in line if s is not b and s[0] not in fate and s[3] < 0.62 * b[3] and math.hypot(s[1] - b[1], s[2] - b[2]) < 0.5 * b[3] * 0.85]
            if len(parts) >= 3 and sum(s[3] ** 2 for s in parts) / b[3] ** 2 >= 0.45:
                fate[b[0]] = "cluster"
            else:
                fate |= {s[0]: "part" for s in parts}
        kept = []
        for b in sorted((b for b in line if b[0] not in fate), key=lambda b: -b[4]):
            if any(math.hypot(k[1] - b[1], k[2] - b[2]) < 0.35 * min(k[3], b[3]) and abs(k[3] - b[3]) < 0.35 * max(k[3], b[3]) for k in kept):
                fate[b[0]] = "twin"
            else:
                kept.append(b)
                fate[b[0]] = "kept"
        want |= {(g, i): f for i, f in fate.items()}
    table = spark.createDataFrame(rows, "g long, stone_id long, x_mm double, y_mm double, d_mm double, score double")
    got = {(r["g"], r["stone_id"]): r["fate"] for r in ordered.absorb(table, KEY).collect()}
    assert got == want and collections.Counter(want.values()).keys() == {"cluster", "part", "kept", "twin"}
