"""Rounds against the loops that they stand for, on many small random designs."""

import collections
import math
import random

import numpy as np
import pytest

from lapidary.functions import color
from lapidary.operators import ordered
from lapidary.sources.tables import SIZES

KEY = ["g"]


def gap(p, q):
    return math.hypot(p[0] - q[0], p[1] - q[1]) - (p[2] + q[2]) / 2


@pytest.fixture(scope="module")
def designs():
    r = random.Random(21)
    out = {}
    for g in range(1000):
        side = r.choice([8, 15, 30])
        out[g] = [(i, r.uniform(0, side), r.uniform(0, side), r.choice(SIZES if g % 2 else SIZES[:3]), r.choice([0.1, 0.5, 0.9])) for i in range(r.randrange(0, 13))]
    return out


STONES = "g long, stone_id long, x_mm double, y_mm double, phys_mm double, score double"


def frame(spark, designs):
    return spark.createDataFrame([(g, *s) for g, rows in designs.items() for s in rows], STONES)


def test_collision_repair_is_the_loop(spark, designs):
    want = {}
    for g, rows in designs.items():
        placed = []
        for i, x, y, size, _ in sorted(rows, key=lambda s: (-s[3], -s[4], s[0])):
            sizes = [size] + [s for s in sorted(SIZES, reverse=True) if s < size - 1e-6][:1]
            options = []
            for s in sizes:
                options += [(s, 0.0, 0)] + [(s, d, k) for d in (0.1, 0.2) for k in range(12)]
            for n, (s, d, k) in enumerate(options):
                at = (x + math.cos(k * math.pi / 6) * d, y + math.sin(k * math.pi / 6) * d, s)
                if all(gap(at, t) >= 0.15 - 1e-9 for t in placed):
                    placed.append(at)
                    want[g, i] = ("kept" if n == 0 else "nudged" if n < 25 else "shrunk", *at)
                    break
            else:
                want[g, i] = ("dropped", None, None, None)
    got = {(r["g"], r["stone_id"]): (r["fate"], r["x_mm"], r["y_mm"], r["phys_mm"]) for r in ordered.repair(frame(spark, designs), KEY, SIZES).collect()}
    assert got.keys() == want.keys()
    assert collections.Counter(v[0] for v in want.values()).keys() == {"kept", "nudged", "shrunk", "dropped"}
    for k, (fate, *at) in want.items():
        assert got[k][0] == fate and (fate == "dropped" or got[k][1:] == pytest.approx(tuple(at))), k


def test_resolve_overlap_is_the_loop(spark, designs):
    want = {}
    for g, rows in designs.items():
        out = []
        for i, x, y, size, score in sorted(rows, key=lambda s: (s[3] < 5, -s[3] if s[3] >= 5 else 0, -s[4], s[0])):
            d = size if size >= 5 else min(size, 2.8)
            if all(gap((x, y, d), (t[1], t[2], t[3])) >= -0.05 - 1e-9 for t in out):
                out.append([i, x, y, d, size])
        for t in out:
            if t[4] > t[3] and all(gap((t[1], t[2], t[4]), (u[1], u[2], u[3])) >= -0.05 - 1e-9 for u in out if u is not t):
                t[3] = t[4]
        want |= {(g, t[0]): (t[3], t[4]) for t in out}
    got = {(r["g"], r["stone_id"]): (r["phys_mm"], r["measured_mm"]) for r in ordered.resolve_overlap(frame(spark, designs), KEY).collect()}
    assert got == want and len({v for v in want.values() if v[0] == 2.8 < v[1]}) == 1


def test_rescue_is_the_loop(spark):
    r = random.Random(22)
    kinds, rows = {}, {}
    for g in range(300):
        # a large one in the middle of rings of smaller ones
        at = [(r.uniform(7, 9), r.uniform(7, 9), r.choice([8.0, 10.0]))]
        for _ in range(r.randrange(3, 12)):
            far, turn = r.uniform(4, 8), r.uniform(0, 6.3)
            at.append((8 + far * math.cos(turn), 8 + far * math.sin(turn), r.choice([2.8, 4.0, 5.0, 6.0])))
        rows[g] = [(i, *p, r.choice([0.1, 0.5, 0.9])) for i, p in enumerate(at)]
        kinds |= {(g, i): r.choice("xy") for i in range(len(at))}
    sizes = [2.8, 4.0, 5.0, 6.0, 8.0, 10.0]

    def passed(stones, forced):
        placed = {}
        for i, x, y, size, _ in sorted(stones, key=lambda s: (-s[3], -s[4], s[0])):
            own = forced.get(i, size)
            for s in [own] + [s for s in sorted(sizes, reverse=True) if s < own - 1e-6][:1]:
                places = [(x, y, s)] + [(x + math.cos(k * math.pi / 6) * d, y + math.sin(k * math.pi / 6) * d, s) for d in (0.1, 0.2) for k in range(12)]
                fit = [p for p in places if all(gap(p, t) >= 0.15 - 1e-9 for t in placed.values())]
                if fit:
                    placed[i] = fit[0]
                    break
        return placed

    want = {}
    for g, stones in rows.items():
        big, forced = [s for s in stones if s[3] >= 4], {}
        for _ in range(2):
            placed = passed(big, forced)
            lost, new = [s for s in big if s[0] not in placed], {}
            for i, t in placed.items():
                out = [s for s in lost if gap(t, s[1:4]) < 0.15 - 1e-9]
                for e in sorted((e for e in sizes if e < t[2] - 1e-6), reverse=True):
                    freed = [s for s in out if gap((t[0], t[1], e), s[1:4]) >= 0.15 - 1e-9 and (kinds[g, s[0]], s[3]) != (kinds[g, i], t[2])]
                    if i not in forced and len(freed) >= 2 and round(sum(s[3] ** 2 for s in freed) - t[2] ** 2 + e**2, 9) > 0:
                        new[i] = e
                        break
            if not new:
                break
            forced |= new
        placed = passed(stones, forced)
        want |= {(g, s[0]): (forced.get(s[0]), *placed.get(s[0], (None,) * 3)) for s in stones}
    data = spark.createDataFrame([(g, *s, kinds[g, s[0]]) for g, stones in rows.items() for s in stones], STONES + ", kind string")
    got = {(x["g"], x["stone_id"]): x for x in ordered.rescue(data, KEY, sizes).collect()}
    assert got.keys() == want.keys() and sum(v[0] is not None for v in want.values()) > 10
    for k, (size, *at) in want.items():
        x = got[k]
        assert x["forced"] == size and (x["fate"] == "dropped") == (at[0] is None), k
        assert at[0] is None or (x["x_mm"], x["y_mm"], x["phys_mm"]) == pytest.approx(tuple(at)), k
    saved = lambda rows: sum(x["fate"] != "dropped" for x in rows if x["stone_id"])
    assert saved(got.values()) > saved(ordered.repair(data, KEY, sizes).collect())
    assert ordered.rescue(data.limit(0), KEY, sizes).count() == 0


def test_nothing_to_place(spark):
    assert ordered.repair(spark.createDataFrame([], STONES), KEY, SIZES).count() == 0
    assert ordered.resolve_overlap(spark.createDataFrame([], STONES), KEY).count() == 0


def test_waves_of_a_circle(spark):
    nodes = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "g long, node long")
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 1, 3)], "g long, first long, then long")
    assert {r["node"]: r["wave"] for r in ordered.waves(nodes, edges, KEY).collect()} == {1: 0, 2: 1, 3: 2}
    with pytest.raises(ValueError):
        ordered.waves(nodes, edges.union(spark.createDataFrame([(0, 3, 1)], edges.schema)), KEY)


def test_chains_are_the_loop(spark):
    r = random.Random(5)
    rows = []
    for g in range(60):
        for row in range(4):  # rows of beads that wave and cross
            x, y, turn, d = r.uniform(0, 40), r.uniform(0, 40), r.uniform(0, 6), r.choice([2.5, 3.0, 4.2])
            for _ in range(r.randrange(2, 14)):
                rows.append((g, len(rows), x, y, d * r.uniform(0.9, 1.2), r.choice("mn"), *(r.uniform(20, 40) for _ in range(3))))
                turn += r.uniform(-0.6, 0.6)
                x, y = x + math.cos(turn) * d * r.uniform(0.8, 1.2), y + math.sin(turn) * d * r.uniform(0.8, 1.2)
    schema = "g long, stone_id long, x_mm double, y_mm double, d_mm double, material string, lab_l double, lab_a double, lab_b double"
    by, want, scored = collections.defaultdict(list), {}, {}
    for b in rows:
        by[b[0]].append(b)
    for g, beads in by.items():
        at = {b[1]: b for b in beads}
        edges = {}
        for p in beads:
            for q in beads:
                dm, dist = (p[4] + q[4]) / 2, math.hypot(p[2] - q[2], p[3] - q[3])
                ratio = max(p[4], q[4]) / min(p[4], q[4])
                if p[1] < q[1] and min(p[4], q[4]) >= 2.2 and ratio <= 1.45 and 0.6 * dm <= dist <= 1.5 * dm and (p[5] == q[5] or math.dist(p[6:], q[6:]) <= 20):
                    edges[p[1], q[1]] = (dist, abs(dist - dm) / dm + 0.3 * (ratio > 1.15))
        near = collections.defaultdict(list)
        for (a, b), (dist, _) in edges.items():
            near[a].append((b, dist))
            near[b].append((a, dist))
        way = lambda a, b: (at[b][2] - at[a][2], at[b][3] - at[a][3])  # noqa: B023, E731
        dot = lambda v, w: (v[0] * w[0] + v[1] * w[1]) / math.hypot(*v) / math.hypot(*w)
        on = lambda a, b, dist: max([0.0] + [dot(way(a, b), way(b, c)) for c, e in near[b] if c != a and max(dist, e) / min(dist, e) <= 1.65])  # noqa: B023, E731
        order = sorted((round(q + (2 - on(a, b, dist) - on(b, a, dist)) / 2, 9), a, b, dist) for (a, b), (dist, q) in edges.items())
        scored |= {(g, a, b): q for q, a, b, _ in order}
        root, has = {i: i for i in at}, collections.defaultdict(list)

        def find(i):
            while root[i] != i:  # noqa: B023
                i = root[i]  # noqa: B023
            return i

        smooth = lambda n, o, dist: all(dot(way(n, t), way(n, o)) <= -math.cos(math.pi / 4) and max(e, dist) / min(e, dist) <= 1.65 for t, e in has[n])  # noqa: B023, E731
        for _, a, b, dist in order:
            if len(has[a]) < 2 and len(has[b]) < 2 and find(a) != find(b) and smooth(a, b, dist) and smooth(b, a, dist):
                has[a].append((b, dist))
                has[b].append((a, dist))
                root[max(find(a), find(b))] = min(find(a), find(b))
                want[g, a, b] = None
        want |= {k: find(k[1]) for k in want if k[0] == g}
    edges = ordered.chain_candidates(spark.createDataFrame(rows, schema), KEY)
    assert {(x["g"], x["a"], x["b"]): x["q"] for x in edges.collect()} == pytest.approx(scored)
    got = {(x["g"], x["a"], x["b"]): x["chain"] for x in ordered.chains(edges, KEY).collect()}
    assert got == want and len(got) > 500
    assert ordered.chains(edges.limit(0), KEY).count() == 0


def graph(r, g, n):
    at = [(r.uniform(0, 12), r.uniform(0, 12)) for _ in range(n)]
    return [(g, a, b, math.dist(at[a], at[b])) for a in range(n) for b in range(n) if a != b and math.dist(at[a], at[b]) < 4]


def test_propagation_is_the_loop(spark):
    r = random.Random(6)
    items, votes, want = [], [], {}
    for g in range(80):
        own = [(g, i, r.choice("abc"), r.choice([0.1, 0.3, 0.45, 0.6, 0.9]), r.random() < 0.1) for i in range(r.randrange(1, 25))]
        pairs = [(a, b, c, round(1 / (1 + d), 6)) for a, b, c, d in graph(r, g, len(own))]
        items += own
        votes += pairs
        near = collections.defaultdict(list)
        for _, i, j, w in pairs:
            near[i].append((j, w))
        label, conf = [x[2] for x in own], [x[3] for x in own]
        for _ in range(3):
            changed = False
            for _, i, _, _, fixed in own:
                if conf[i] >= 0.5 or fixed or len(near[i]) < 2:
                    continue
                v = collections.Counter()
                for j, w in near[i]:
                    v[label[j]] += max(0.2, conf[j]) * w
                v = {k: round(x, 9) for k, x in v.items()}
                top = min(v, key=lambda k: (-v[k], k))
                if top != label[i] and v[top] >= 0.5 * sum(v.values()) - 1e-9 and v[top] >= 0.4 - 1e-9:
                    label[i], conf[i], changed = top, 0.5, True
            if not changed:
                break
        want |= {(g, i): (label[i], own[i][2]) for i in range(len(own))}
    a = spark.createDataFrame(items, "g long, item long, label string, conf double, fixed boolean")
    b = spark.createDataFrame(votes, "g long, item long, other long, weight double")
    got = {(x["g"], x["item"]): (x["label"], x["was"]) for x in ordered.propagate(a, b, KEY, share=0.5, least=0.4).collect()}
    assert got == want and sum(x != y for x, y in want.values()) > 20
    assert ordered.propagate(a.limit(0), b.limit(0), KEY).count() == 0


def test_diffusion_is_the_loop(spark):
    r = random.Random(7)
    items, edges, want = [], [], {}
    for g in range(25):
        palette = [(10 * g + k, r.uniform(0, 100), r.uniform(-60, 60), r.uniform(-60, 60)) for k in range(5)]
        own = [(g, i, r.uniform(0, 100), r.uniform(-60, 60), r.uniform(-60, 60), palette) for i in range(20)]
        pairs = [(a, b, c) for a, b, c, _ in graph(r, g, 20) if b < c]
        items += own
        edges += pairs
        later = collections.defaultdict(list)
        for _, i, j in pairs:
            later[i].append(j)
        err = np.zeros((20, 3))
        for _, i, *lab, _ in own:
            t = np.array(lab) + err[i]
            de = [round(float(color.de2000_array(t[None], np.array([p[1:]]))[0]), 9) for p in palette]
            k = min(range(5), key=lambda k: (de[k], palette[k][0]))
            want[g, i] = palette[k][0]
            for j in later[i]:
                err[j] += (t - palette[k][1:]) / len(later[i])
    a = spark.createDataFrame(items, "g long, item long, lab_l double, lab_a double, lab_b double, palette array<struct<code:long,l:double,a:double,b:double>>")
    b = spark.createDataFrame(edges, "g long, a long, b long")
    got = {(x["g"], x["item"]): x["code"] for x in ordered.diffuse(a, b, KEY).collect()}
    assert got == want
    assert got != {(x["g"], x["item"]): x["code"] for x in ordered.diffuse(a, b, KEY, 0.0).collect()}
    assert ordered.diffuse(a.limit(0), b, KEY).count() == 0


@pytest.mark.parametrize("least", [2, 3])
def test_despeckle_is_the_loop(spark, least):
    r = random.Random(8)
    palette = [(k, r.uniform(30, 70), r.uniform(-20, 20), r.uniform(-20, 20)) for k in range(5)]
    items, edges, want, n = [], [], {}, 10
    for g in range(60):
        own = [(g, i, r.choice([0, 0, 1, 1, 2, 3, 4]), r.uniform(30, 70), r.uniform(-20, 20), r.uniform(-20, 20), r.random() < 0.08) for i in range(n)]
        pairs = [(a, b, c) for a, b, c, d in graph(r, g, n) if b < c and d < 3.9]
        items += own
        edges += pairs
        near = collections.defaultdict(set)
        for _, i, j in pairs:
            near[i].add(j)
            near[j].add(i)
        code = [x[2] for x in own]
        for _ in range(2):
            seen = set()
            for i in range(n):
                if i in seen or own[i][6]:
                    continue
                comp = [i]
                for m in comp:
                    comp += [j for j in sorted(near[m]) if code[j] == code[i] and j not in comp]
                seen |= set(comp)
                votes = collections.Counter(code[j] for m in comp for j in near[m] if j not in comp)
                if len(comp) >= least or any(own[m][6] for m in comp) or not votes:
                    continue
                mean = np.round(np.mean([own[m][3:6] for m in comp], axis=0), 9)
                de = {c: round(float(color.de2000_array(mean[None], np.array([palette[c][1:]]))[0]), 9) for c in votes}
                to = min((c for c in votes if votes[c] == max(votes.values())), key=lambda c: (de[c], c))
                if de[to] <= 20:
                    for m in comp:
                        code[m] = to
        want |= {(g, i): (code[i], own[i][2]) for i in range(n)}
    a = spark.createDataFrame(items, "g long, item long, code long, lab_l double, lab_a double, lab_b double, fixed boolean")
    b = spark.createDataFrame(edges, "g long, a long, b long")
    c = spark.createDataFrame(palette, "code long, lab_l double, lab_a double, lab_b double")
    got = {(x["g"], x["item"]): (x["code"], x["was"]) for x in ordered.despeckle(a, b, c, KEY, least).collect()}
    assert got == want and sum(x != y for x, y in want.values()) > 40
    assert ordered.despeckle(a.limit(0), b, c, KEY, least).count() == 0
