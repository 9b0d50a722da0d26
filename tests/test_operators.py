import inspect
import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapidary.functions import color
from lapidary.operators import labels, learn, palette, spatial
from lapidary.sources import markup
from lapidary.streaming import ledger

# Published CIEDE2000 test pairs (Sharma, Wu and Dalal, 2005).
PAIRS = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
    (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0000),
    (50.0, 2.5, 0.0, 50.0, 0.0, -2.5, 4.3065),
    (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
    (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
    (2.0776, 0.0795, -1.1350, 0.9033, -0.0636, -0.5514, 0.9082),
]


def test_ciede2000(spark):
    df = spark.createDataFrame(PAIRS, "p_l double, p_a double, p_b double, q_l double, q_a double, q_b double, want double")
    for r in color.add(df, color.de2000_steps("p", "q"), ["de"]).collect():
        assert r["de"] == pytest.approx(r["want"], abs=1e-4)


def test_lab_of_white_and_black(spark):
    df = spark.createDataFrame([(255, 255, 255), (0, 0, 0)], "r int, g int, b int")
    white, black = color.add(df, color.lab_steps("r", "g", "b")).orderBy(F.desc("r")).collect()
    assert white["lab_l"] == pytest.approx(100, abs=0.01) and black["lab_l"] == pytest.approx(0, abs=0.01)


def test_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    points = [(rng.randrange(3), i, rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(150)]
    df = spark.createDataFrame(points, "g int, stone_id int, x_mm double, y_mm double")
    got = {(r["a_stone_id"], r["b_stone_id"]) for r in spatial.neighbour_pairs(df, 4.0, ["g"]).collect()}
    want = {(a[1], b[1]) for a, b in itertools.combinations(points, 2) if a[0] == b[0] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 < 16}
    assert got == want


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(0, rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(0, i) for i in range(60)], "g int, node int")
    got = spatial.components(nodes, spark.createDataFrame(edges, "g int, a int, b int"), ["g"]).collect()
    assert {r["node"]: r["component"] for r in got} == {i: find(i) for i in range(60)}


def test_nearest_by_rings(spark):
    rng = random.Random(7)
    a = [(0, i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(20)]
    b = [(0, i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(15)]
    schema = "g int, i int, x_mm double, y_mm double"
    got = spatial.nearest(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["g"], "i", 2.0, 80.0).collect()
    for r in got:
        p = a[r["i"]]
        assert r["nearest"] == min(b, key=lambda q: ((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2, q[1]))[1]


def test_nearest_far_away(spark):
    schema = "g int, i int, x_mm double, y_mm double"
    a, b = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 1, 5.0, 5.0)], schema), spark.createDataFrame([(0, 7, 3000.0, 4000.0)], schema)
    got = {r["i"]: (r["nearest"], r["distance"]) for r in spatial.nearest(a, b, ["g"], "i", 2.0).collect()}
    assert got == {0: (7, 5000.0), 1: (None, None)}


def test_close_pairs_of_all_sizes(spark):
    """Sizes from a tenth to sixty millimetres, each pair once, with both rows' columns at the right ends."""
    from lapidary.operators import qc

    rng = random.Random(12)
    rows = [(d, i, rng.uniform(-50, 150), rng.uniform(0, 200), rng.choice([0.1, 0.5, 2.8, 4.0, 10.0, 10.5, 20.0, 60.0])) for d in (1, 2) for i in range(150)]
    rows += [(3, 0, 0.0, 0.0, 20.0), (3, 1, 12.0, 0.0, 20.0), (4, 0, 0.0, 0.0, 20.0), (4, 1, 20.1, 0.0, 20.0), (5, 0, 1.0, 1.0, 4.0), (5, 1, 1.0, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "design_id int, stone_id long, x_mm double, y_mm double, phys_mm double")
    gap = lambda p, q: ((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) ** 0.5 - (p[4] + q[4]) / 2
    for clearance in (-0.05, 0.15, 3.0):
        want = sorted((p[0], p[1], q[1], p[4], q[4]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and gap(p, q) < clearance)
        got = sorted((r["design_id"], r["a_stone_id"], r["b_stone_id"], r["a_phys_mm"], r["b_phys_mm"]) for r in spatial.close_pairs(df, clearance, ["design_id"]).collect())
        assert got == want
    assert spatial.close_pairs(df.limit(0), 0.1, ["design_id"]).count() == 0
    found = {(r["design_id"], r["check_id"]): r["n"] for r in qc.run(df, {}, ["overlap", "gap"]).collect()}
    assert found[3, "overlap"] == 1 and found[4, "gap"] == 2 and (4, "overlap") not in found
    near = {(r["design_id"], r["stone_id"]): r["gap"] for r in spatial.nearest_gap(df, ["design_id"]).collect()}
    for p in rows:
        largest = max(q[4] for q in rows if q[0] == p[0])
        gaps = [gap(p, q) for q in rows if q[0] == p[0] and q[1] != p[1] and gap(p, q) + (p[4] + q[4]) / 2 < largest + 1.5]
        assert near[p[0], p[1]] == (pytest.approx(min(gaps)) if gaps else None)


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(1)
    assert learn.assignment(np.array([[4, 1, 3], [2, 0, 5]])) == [1, 0]
    for n, m in ((3, 3), (3, 5), (5, 6)):
        cost = rng.integers(0, 30, (n, m))
        got = learn.assignment(cost)
        assert len(set(got)) == n
        assert sum(cost[i, j] for i, j in enumerate(got)) == min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


def test_potts_against_exhaustion():
    rng, optimal = np.random.default_rng(11), 0
    for _ in range(40):
        cost = rng.uniform(0, 10, (6, 3))
        edges = [(a, b, float(rng.uniform(0, 3))) for a, b in itertools.combinations(range(6), 2) if rng.random() < 0.5]
        value = lambda lab: cost[np.arange(6), lab].sum() + sum(w for a, b, w in edges if lab[a] != lab[b])  # noqa: B023, E731
        best, got = labels.exhaustive(cost, edges, 1.0), value(labels.expand(cost, edges, 1.0))
        assert best - 1e-9 <= got <= 2 * best + 1e-9 and value(labels.sweep(cost, edges, 1.0)) >= best - 1e-9
        optimal += got <= best + 1e-9
    assert optimal >= 36


def test_potts_on_components(spark):
    unary = spark.createDataFrame([(0, n, x, float(abs(x - n % 2))) for n in range(5) for x in range(2)], "component int, node int, label int, cost double")
    edges = spark.createDataFrame([(0, n, n + 1, 9.0) for n in range(4)], "component int, a int, b int, weight double")
    found = labels.solve(unary, edges, 1.0)
    assert {r["label"] for r in found.collect()} == {0}
    assert labels.energy(unary.drop("component"), edges.drop("component"), found.drop("component"), 1.0).first()["energy"] == 2.0


@pytest.fixture(scope="module")
def costs(spark):
    rng = random.Random(2)
    rows = [(t, c, float(rng.randrange(1, 40))) for t in range(9) for c in range(6) if rng.random() < 0.8]
    return rows, spark.createDataFrame(rows, "target_id long, code_id long, cost double"), spark.createDataFrame([(t, "bg", t % 3 + 1) for t in range(9)], "target_id long, layer string, weight long")


def total(rows, codes):
    return sum(min([c for t2, k, c in rows if t2 == t and k in codes] + [1000.0]) * (t % 3 + 1) for t in range(9))


def test_greedy_and_swaps(spark, costs):
    rows, table, records = costs
    chosen, want = [c for c, _ in palette.greedy(table, records, 3)], []
    for _ in range(3):
        want.append(min((c for c in range(6) if c not in want), key=lambda c: (total(rows, [*want, c]), c)))
    assert chosen == want
    better = palette.swapped(table, records, chosen)
    assert total(rows, better) <= total(rows, chosen)
    assert all(total(rows, [*(set(better) - {a}), b]) >= total(rows, better) - 1e-6 for a in better for b in range(6) if b not in better)
    got = palette.evaluate(table, records, spark.createDataFrame([(c,) for c in better], "code_id long")).first()
    assert got["cost"] == pytest.approx(total(rows, better))


def test_merge(costs):
    _, table, records = costs
    codes, history = palette.merge(table, records, 2)
    assert len(codes) <= 6 and all(a not in codes for a, _, _ in history)


def test_logistic_and_kmeans(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (200, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a + 2 * b > 0), 1.0) for a, b in x], "a double, b double, y int, w double")
    w, scale = learn.logistic(df, ["a", "b"], "y", steps=40)
    z = sum(w[i] * (x[:, i] - scale[i][0]) / scale[i][1] for i in range(2)) + w[2]
    assert ((z > 0) == (x[:, 0] + 2 * x[:, 1] > 0)).mean() > 0.95
    blobs = spark.createDataFrame([(float(i % 3 * 10 + i % 2), 0.0, 1.0) for i in range(30)], "a double, b double, w double")
    assert sorted(round(c[0], 3) for c in learn.kmeans(blobs, ["a", "b"], "w", 3)) == [0.5, 10.5, 20.5]


def test_transforms(spark):
    df = spark.createDataFrame([("translate(3 4) scale(2)",), ("rotate(90)",), ("matrix(1 2 3 4 5 6)",), ("",)], "t string")
    got = [r[0] for r in df.select(markup.parse_transform(F.col("t"))).collect()]
    assert got[0] == [2, 0, 0, 2, 3, 4] and got[2] == [1, 2, 3, 4, 5, 6] and got[3] == [1, 0, 0, 1, 0, 0]
    assert got[1] == pytest.approx([0, 1, -1, 0, 0, 0], abs=1e-12)


def test_escape_round_trip(spark):
    text = 'a<b>&"c"&amp;'
    row = spark.createDataFrame([(text,)], "t string").select(markup.unescape(markup.escape(F.col("t"))).alias("t")).first()
    assert row["t"] == text


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, ["click", "purchase", "error"][i % 3 if i % 5 else 1], float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, event_type string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ledger.usage(stream, "user_id", "event_type", "value").writeStream.outputMode("complete").format("memory").queryName("usage").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("usage").collect())) == sorted(map(tuple, ledger.usage(df, "user_id", "event_type", "value").collect()))


def test_layers_against_one_loop(spark):
    from lapidary.operators import compose

    rng = random.Random(9)
    rows = [(0, i, rng.randrange(3), rng.uniform(0, 40), rng.uniform(0, 40), rng.choice([2.8, 4.0, 8.0]), rng.random() < 0.2) for i in range(120)]
    kept, state = [], {}
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        hits = [t for t in kept if t[2] != r[2] and ((r[3] - t[3]) ** 2 + (r[4] - t[4]) ** 2) ** 0.5 - (r[5] + t[5]) / 2 < 0]
        if hits and not r[6]:
            state[r[1]] = "collided"
            continue
        for t in hits:
            if not t[6]:
                kept.remove(t)
                state[t[1]] = "removed"
        kept.append(r)
        state[r[1]] = "kept"
    df = spark.createDataFrame(rows, "design_id int, stone_id long, layer_rank int, x_mm double, y_mm double, phys_mm double, locked boolean")
    assert {r["stone_id"]: r["fate"] for r in compose.layered(df).collect()} == state


def test_geometry(spark):
    from lapidary.functions import geometry as G

    point = "array<struct<x:double,y:double>>"
    square, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    df = spark.createDataFrame([(3.0, 3.0, square, [hole]), (1.5, 1.5, square, [hole]), (5.0, 1.0, square, None)], f"x double, y double, p {point}, h array<{point}>")
    got = df.select(G.inside_region(F.col("x"), F.col("y"), F.col("p"), F.col("h")), G.region_area(F.col("p"), F.col("h"))).collect()
    assert [tuple(r) for r in got] == [(True, 15.0), (False, 15.0), (False, 16.0)]
    runs = spark.createDataFrame([([2, 3, 1, 1, 2, 3],), ([0, 4],)], "r array<int>")
    assert all(r["r"] == r["back"] for r in runs.select("r", G.encode_runs(G.decode_runs(F.col("r"))).alias("back")).collect())
    names = spark.createDataFrame([("L10",), ("L9",), ("A2",)], "c string").orderBy(G.natural_key(F.col("c"))).collect()
    assert [r["c"] for r in names] == ["A2", "L9", "L10"]


def test_files(spark, tmp_path):
    from lapidary.sources import files

    (tmp_path / "sizes.csv").write_bytes("﻿physical_mm,reference_mm,status,rule,notes\n2.8,2,ok,,\n5,4.1,ok,,\n".encode())
    sizes = files.read_csv(spark, str(tmp_path / "sizes.csv"), files.SIZE_MAP)
    stones = spark.createDataFrame([(2.8,), (5.0,), (6.0,)], "phys_mm double")
    assert [r["ref_mm"] for r in files.reference_size(stones, sizes).orderBy("phys_mm").collect()] == [2.0, 4.1, 5.2]
    (tmp_path / "rules.json").write_text('{"max": 13, "note": "plain text"}')
    assert {r["key"]: r["value"] for r in files.read_rules(spark, str(tmp_path / "rules.json")).collect()} == {"max": "13", "note": "plain text"}
    docs = spark.createDataFrame([("other/1",)], "format string")
    with pytest.raises(Exception, match="unknown format"):
        files.checked(docs, "regions/1").collect()


def test_merge_by_the_reference_rules(spark):
    """Against a plain form of the rules: kind, shape and size bound a merge, smaller codes cost more, rounds go on to the end."""
    rng = np.random.default_rng(11)
    codes = [(j, "pearl" if j % 4 == 0 else "stone", "heart" if j % 5 == 1 else "round", [2.8, 4.0, 6.0][j % 3]) for j in range(30)]
    rows, same = {}, {}
    for t in range(80):
        want = [2.8, 4.0, 6.0][t % 3]
        for j, kind, _, mm in codes:
            if mm <= want:
                rows[t, j], same[t, j] = float(rng.uniform(1, 40)), kind != "pearl" and mm == want
    weight = {t: int(rng.integers(1, 5)) for t in range(80)}
    cost = lambda t, j: rows[t, j] + (0 if same[t, j] else 20.0)
    at = {t: min((not same[t, j], cost(t, j), j) for u, j in rows if u == t)[2] for t in range(80)}
    start, want = len(set(at.values())), []
    while len(set(at.values())) > 6:
        found = []
        for a in set(at.values()):
            for b in set(at.values()) - {a}:
                (_, ka, sa, ma), (_, kb, sb, mb) = codes[a], codes[b]
                if ka == kb and sa == sb and mb <= ma:
                    own = [t for t in at if at[t] == a]
                    found.append(((ma / 2.8) ** 2 * sum(weight[t] * (rows[t, b] ** 2 - rows[t, a] ** 2 + (625 if mb < ma else 0)) for t in own), a, b))
        if not found:
            break
        price, a, b = min(found)
        at = {t: b if j == a else j for t, j in at.items()}
        want.append((a, b, price))
    table = spark.createDataFrame([(t, j, cost(t, j), d, same[t, j]) for (t, j), d in rows.items()], "target_id long, code_id long, cost double, de double, same boolean")
    records = spark.createDataFrame(list(weight.items()), "target_id long, weight long")
    catalog = spark.createDataFrame(codes, "code_id long, kind string, shape string, phys_mm double")
    left, history = palette.merge(table, records, 6, catalog=catalog)
    assert start - len(want) < start - 5 and left == sorted(set(at.values()))
    assert [h[:2] for h in history] == [h[:2] for h in want] and [h[2] for h in history] == pytest.approx([h[2] for h in want])


def test_swaps_pass_over_all_places(spark):
    rng = np.random.default_rng(12)
    rows = {(t, j): float(rng.uniform(0, 100)) for t in range(60) for j in range(25)}
    total = lambda chosen: sum(min(rows[t, j] for j in chosen) for t in range(60))
    want = list(range(11))
    for a in range(11):  # one pass
        best = min((j for j in range(25) if j not in want), key=lambda j: total([*want[:a], j, *want[a + 1 :]]))
        if total([*want[:a], best, *want[a + 1 :]]) < total(want) - 1e-6:
            want[a] = best
    table = spark.createDataFrame([(t, j, c) for (t, j), c in rows.items()], "target_id long, code_id long, cost double")
    records = spark.createDataFrame([(t, 1) for t in range(60)], "target_id long, weight long")
    assert palette.swapped(table, records, list(range(11)), passes=1) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_palette_queries_do_the_whole_job(spark):
    from lapidary import plans

    small, large = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
    assert plans.QUERIES["palette_greedy"](spark, small).count() == 11
    assert plans.QUERIES["palette_swaps"](spark, small).count() == 11
    merged = {x["from_code"] for x in plans.QUERIES["palette_merge"](spark, large).collect()}
    assert len(merged) > 11  # a hundred targets, most with a code of their own


def test_components_have_no_bound_of_rounds(spark):
    """Rounds go on until no label moves; a bound would return a long component split."""
    assert "rounds" not in inspect.signature(spatial.components).parameters
    order = list(range(40))
    random.Random(3).shuffle(order)
    nodes = spark.createDataFrame([(0, i) for i in range(42)], "k long, node long")
    edges = spark.createDataFrame([(0, a, b) for a, b in zip(order, order[1:])] + [(0, 40, 41)], "k long, a long, b long")
    found = {r["node"]: r["component"] for r in spatial.components(nodes, edges, ["k"]).collect()}
    assert found == {i: 0 if i < 40 else 40 for i in range(42)}


def test_differences_in_arrays_are_those_of_the_columns(spark):
    rng = np.random.default_rng(5)
    labs = np.column_stack([rng.uniform(0, 100, 400), rng.uniform(-90, 90, (400, 2))])
    labs[::9, 1:] = 0.0
    p, q = labs[:200], labs[200:]
    columns = [f"{s}_{x}" for s in "pq" for x in "lab"]
    rows = color.add(spark.createDataFrame(np.hstack([p, q]).tolist(), columns), color.de2000_steps("p", "q"), ["de"])
    assert np.allclose(sorted(r["de"] for r in rows.collect()), np.sort(color.de2000_array(p, q)), atol=1e-9)


def test_costs_do_not_depend_on_blocks(spark, monkeypatch):
    targets = spark.createDataFrame([(i, i * 37 % 256, i * 91 % 256, i * 157 % 256, [2.8, 4.0, 5.0][i % 3], i % 4 + 1) for i in range(40)], "target_id long, r int, g int, b int, phys_mm double, weight long")
    codes = spark.createDataFrame([(i, i % 7 * 30, i % 5 * 50, i % 3 * 90, [2.8, 4.0, 5.0][i % 3], "pearl" if i % 10 == 0 else "stone") for i in range(150)], "code_id long, r int, g int, b int, phys_mm double, kind string")
    views = {"costs": palette.costs, "usable": palette.usable, "nearest": palette.nearest}
    whole = {n: sorted(map(tuple, f(targets, codes).collect())) for n, f in views.items()}
    monkeypatch.setattr(palette, "BLOCKS", (7, 11))
    monkeypatch.setattr(palette, "SLICE", 3)
    assert {n: sorted(map(tuple, f(targets, codes).collect())) for n, f in views.items()} == whole
    usable, least = {}, {}
    for target, _, _, _, cost in whole["costs"]:
        usable[target], least[target] = usable.get(target, 0) + 1, min(cost, least.get(target, cost))
    assert whole["usable"] == sorted((t, usable[t], least[t]) for t in usable)
    assert palette.costs(targets.limit(0), codes).count() == palette.nearest(targets, codes.limit(0)).count() == 0


def test_merge_down(spark):
    rng = np.random.default_rng(5)
    cost = {(t, c): (float(rng.integers(1, 60)), float(rng.integers(1, 40))) for t in range(40) for c in range(9) if rng.random() < 0.6}
    size = {c: 2.0 + c % 3 for c in range(9)}
    table = spark.createDataFrame([(t, c, de, v) for (t, c), (v, de) in cost.items()], "target_id long, code_id long, de double, cost double")
    records = spark.createDataFrame([(t, t % 4 + 1, 1) for t in range(40)], "target_id long, weight long, records long")
    codes = spark.createDataFrame(list(size.items()), "code_id long, phys_mm double")
    live, want = set(range(9)), []
    while len(live) > 3:
        prices = {}
        for a in live - {4}:
            price = moved = 0
            for t in range(40):
                order = sorted((cost[t, c][0], c) for c in live if (t, c) in cost)
                if order and order[0][1] == a:
                    moved += 1
                    gap = 1e4 if len(order) == 1 else cost[t, order[1][1]][1] ** 2 - cost[t, a][1] ** 2 + 625 * (size[order[1][1]] < size[a])
                    price += (t % 4 + 1) * gap
            prices[a] = (price, a, moved)
        price, a, moved = min(prices.values())
        live.remove(a)
        want.append((a, moved, price))
    left, history = palette.merge_down(table, records, codes, 3, keep=(4,))
    assert left == sorted(live) and 4 in left
    assert history == [(a, m, pytest.approx(p)) for a, m, p in want]
    assert palette.merge_down(table.limit(0), records, codes, 8)[1] == [(0, 0, 0.0)]
    assert palette.merge_down(table, records, codes, 1, keep=tuple(range(9))) == (list(range(9)), [])


def test_admission_of_calls(spark, tmp_path):
    schema = "k string, call string, state string, at long, usd double"
    first = [("a", "1", "sent", 1, None), ("a", "2", "sent", 2, None), ("a", "3", "sent", 3, None), ("a", "1", "done", 4, 0.01), ("a", "4", "sent", 5, None), ("b", "1", "done", 1, 9.0), ("b", "1", "sent", 2, None)]
    second = [("a", "3", "done", 6, 5.0), ("a", "2", "error", 7, None), ("a", "4", "done", 8, None), ("a", "5", "sent", 9, None), ("a", "6", "sent", 10, None), (None, "1", "sent", 1, None), (None, None, "sent", 2, None)]
    want = {("a", "1", 1, None, 0.0), ("a", "2", 2, None, 0.0), ("a", "3", None, "usd", 0.0), ("a", "4", 3, None, 0.01), ("b", "1", 1, None, 0.0), ("a", "5", 4, None, 0.01), ("a", "6", None, "calls", 0.01), (None, "1", 1, None, 0.0)}
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "calls"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "calls"))
        q = ledger.admit(stream, "k", 4, 0.08, 0.03).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert set(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_remap_by_class(spark):
    from lapidary.operators import palette

    entry = lambda code, material, shape, w, h, lab=(50.0, 10.0, 10.0): (0, code, material, shape, max(w, h), w, h, *lab)
    schema = "g long, code_id long, material string, shape string, mm double, w_mm double, h_mm double, lab_l double, lab_a double, lab_b double"
    white = (95.0, 0.0, 0.0)
    pool = [
        entry(1, "base", "round", 5.0, 5.0), entry(2, "base", "round", 2.8, 2.8), entry(3, "pearl", "round", 5.0, 5.0, white),
        entry(4, "base", "heart", 6.0, 6.0), entry(5, "gold", "round", 8.0, 8.0, (50.0, 11.0, 10.0)), entry(6, "base", "round", 5.0, 5.0),
    ]
    asked = [
        entry(1, "base", "round", 5.0, 5.0), entry(10, "base", "round", 8.0, 8.0), entry(11, "base", "round", 4.0, 4.0), entry(12, "facet", "round", 6.0, 6.0, white),
        entry(13, "base", "heart", 8.0, 8.0), entry(14, "base", "marquise", 4.0, 8.0), entry(15, "base", "marquise", 5.0, 10.0), entry(16, "pearl", "heart", 5.0, 5.0),
        entry(17, "gold", "round", 8.0, 8.0), entry(18, "base", "round", 8.0, 8.0, (20.0, 60.0, -60.0)), entry(19, "gold", "round", 6.0, 6.0, white),
    ]
    got = {x["code_id"]: (x["to_code"], x["why"], x["cost"]) for x in palette.remap(spark.createDataFrame(asked, schema), spark.createDataFrame(pool, schema), ["g"]).collect()}
    # the smaller of two equal codes; the small round stays out; a white one becomes a pearl, unless gold
    assert {k: v[:2] for k, v in got.items()} == {
        1: (1, "kept"), 10: (1, "smaller"), 11: (None, "no-class"), 12: (3, "smaller"), 13: (4, "shape-size"), 14: (1, "shape-size"), 15: (None, "no-class"),
        16: (None, "no-class"), 17: (5, "smaller"), 18: (None, "no-class"), 19: (None, "no-class"),
    }
    want = {1: 0.0, 10: 26.0, 12: 12.0, 13: 100 * math.log(8 / 6), 14: 40.0}
    assert {k: got[k][2] for k in want} == pytest.approx(want)
    assert palette.remap(spark.createDataFrame([], schema), spark.createDataFrame(pool, schema), ["g"]).count() == 0


def test_gold_may_not_be_darker(spark):
    from lapidary.operators import palette

    row = lambda material, p, q: (material, "round", 5.0, 5.0, 5.0, material, "round", 5.0, 5.0, 5.0, p, 0.0, 0.0, q, 0.0, 0.0, 3.0)
    sides = ", ".join(f"{s}_material string, {s}_shape string, {s}_mm double, {s}_w_mm double, {s}_h_mm double" for s in ("want", "code"))
    rows = spark.createDataFrame([row("gold", 60.0, 56.0), row("gold", 56.0, 60.0), row("base", 60.0, 56.0)], f"{sides}, p_l double, p_a double, p_b double, q_l double, q_a double, q_b double, de double")
    assert [x["cost"] for x in rows.select(palette.class_cost()[0].alias("cost")).collect()] == pytest.approx([5.0, 3.0, 3.0])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_tables_are_not_broadcast(spark, tmp_path):
    # cells of a mask, copies of a row on its cells and rows of cells under a bead are many more than a file's size tells
    from lapidary.operators import fill
    from lapidary.plans import imports

    spark.range(20).selectExpr("id AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    cells = spark.range(5).selectExpr("id AS design_id", "0 AS px", "0 AS py")
    assert "Broadcast" not in plan_of(cells.join(imports.mask(spark, str(tmp_path)), ["design_id", "px", "py"]))
    spark.range(30).selectExpr("0 AS design_id", "id AS stone_id", "CAST(id AS DOUBLE) AS x_mm", "CAST(id % 7 AS DOUBLE) AS y_mm", "2.0D AS d_mm", "4.0D AS r").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert "BroadcastHashJoin" not in plan_of(spatial.within(rows, rows, 3.0, ["design_id"]))
    assert "BroadcastHashJoin" not in plan_of(spatial.close_pairs(rows, 0.5, ["design_id"], size="d_mm"))
    held = fill.cover(rows, rows, ["design_id"], 0.5).collect()
    want = {}
    spots = {(x, y) for i in range(30) for y in range(int(i % 7 * 2) - 2, int(i % 7 * 2) + 3) for x in range(2 * i - 2, 2 * i + 3) if (x - 2 * i) ** 2 + (y - i % 7 * 2) ** 2 <= 4}
    for i in range(30):
        side = 8 * math.pi**0.5 / 2
        x0, x1, y0, y1 = (math.floor(v + 0.5) for v in (2 * i - side, 2 * i + side, i % 7 * 2 - side, i % 7 * 2 + side))
        want[i] = sum(x0 <= x < x1 and y0 <= y < y1 for x, y in spots) / ((x1 - x0) * (y1 - y0))
    assert {r.stone_id: r.cover for r in held} == pytest.approx(want, abs=1e-6)


def test_pairs_stand_in_few_cells(spark):
    # a row is copied to the cells that its reach touches, not to nine and once more for each class of size
    rows = spark.range(2000).selectExpr("0 AS design_id", "id AS stone_id", "(id * 7919 % 3000) / 10.0D AS x_mm", "(id * 104729 % 3000) / 10.0D AS y_mm", "CAST(element_at(array(2.8, 4, 5, 6, 7, 8, 10), CAST(id % 7 AS INT) + 1) AS DOUBLE) AS phys_mm")
    assert spatial._touched(rows, "x_mm", "y_mm", 30.0, F.lit(1 / 3)).count() < 3.2 * rows.count()
    at = [(r.stone_id, r.x_mm, r.y_mm, r.phys_mm) for r in rows.collect()]
    far = lambda p, q: math.sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2)
    want = {(p[0], q[0]) for p in at for q in at if p[0] < q[0] and far(p, q) - (p[3] + q[3]) / 2 < 0.15}
    found = [(r.a_stone_id, r.b_stone_id) for r in spatial.close_pairs(rows, 0.15, ["design_id"]).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    near = [(r.a_stone_id, r.b_stone_id) for r in spatial.neighbour_pairs(rows, 9.0, ["design_id"]).collect()]
    assert len(near) == len(set(near)) and set(near) == {(p[0], q[0]) for p in at for q in at if p[0] < q[0] and far(p, q) < 9.0}


_CODE = "code_id long, material string, shape string, mm double, w_mm double, h_mm double, lab_l double, lab_a double, lab_b double"


def _some_code(rng, code_id):
    mm = rng.choice([2.8, 4.0, 5.0, 6.0, 8.0, 10.0])
    lab = rng.choice([(95.0, 0.0, 0.0), (50.0, 10.0, 10.0), (rng.uniform(40, 60), rng.uniform(0, 20), rng.uniform(0, 20))])
    return (code_id, rng.choice(["base", "base", "gold", "pearl", None]), rng.choice(["round", "round", "heart", "marquise", None]), mm, mm * rng.choice([0.5, 1.0]), mm, *lab)


def _priced_pairs(asked, pool, gold_weight):
    """Every pair of a group with its cost by the rule on columns."""
    names = [c.split()[0] for c in _CODE.split(", ")]
    side = lambda df, name, lab: df.select("g", *(F.col(c).alias(f"{lab}_{c[-1]}" if c.startswith("lab_") else f"{name}_{c}") for c in names))
    met = color.add(side(asked, "want", "p").join(side(pool, "code", "q"), "g"), color.de2000_steps("p", "q"), ["de"])
    cost, de = palette.class_cost(gold_weight)
    return met.withColumns({"cost": cost, "off": de}).collect()


@pytest.mark.parametrize("gold_weight", [0.0, 1.5])
def test_class_cost_of_arrays(spark, gold_weight):
    rng = random.Random(5)
    asked, pool = (spark.createDataFrame([(0, *_some_code(rng, c)) for c in range(40)], f"g long, {_CODE}") for _ in range(2))
    pairs = _priced_pairs(asked, pool, gold_weight)

    def arrays(name, lab):
        number = {None: -1, "base": 0, "gold": 1, "pearl": 2, "round": 3, "heart": 4, "marquise": 5}
        out = {c: np.array([r[f"{name}_{c}"] for r in pairs]) for c in ("mm", "w_mm", "h_mm")}
        out |= {c: np.array([number[r[f"{name}_{c}"]] for r in pairs]) for c in ("material", "shape")}
        return out | {"lab": np.array([[r[f"{lab}_{c}"] for c in "lab"] for r in pairs]), "pearl": out["material"] == 2, "gold": out["material"] == 1, "round": out["shape"] == 3}

    cost, de = palette.class_cost_array(arrays("want", "p"), arrays("code", "q"), gold_weight)
    want = np.array([np.nan if r["cost"] is None else r["cost"] for r in pairs])
    assert 100 < np.isfinite(want).sum() < len(pairs) - 100
    assert cost == pytest.approx(want, abs=1e-9, nan_ok=True)
    allowed = np.isfinite(want)
    assert de[allowed] == pytest.approx(np.array([r["off"] for r in pairs])[allowed], abs=1e-9)


def test_remap_against_pairs(spark, monkeypatch):
    # pools of none to nine codes and a third of them twice, fewer pairs at once than a batch has, no code or group, a further column
    rng = random.Random(28)
    pool = [(g, *_some_code(rng, c)) for g in (1, 2, 3) for c in rng.sample(range(40), 3 * g)]
    pool += [(p[0], p[1] + 100, *p[2:]) for p in pool[::3]]
    asked = [(g, *_some_code(rng, c), (c or 0) * 7) for g in (0, 1, 2, 3, None) for c in [*range(60), None]]
    pool, asked = spark.createDataFrame(pool, f"g long, {_CODE}"), spark.createDataFrame(asked, f"g long, {_CODE}, stones long")
    monkeypatch.setattr(palette, "PAIRS", 20)
    got = {(r.g, r.code_id): r for r in palette.remap(asked, pool, ["g"]).collect()}
    inside, best = {(r.g, r.code_id) for r in pool.collect()}, {}
    for r in _priced_pairs(asked, pool, 0.0):
        if r.want_code_id is not None and r.cost is not None and r.off <= 20 and (r.code_shape != "round" or r.code_mm >= 4):
            best[r.g, r.want_code_id] = min(best.get((r.g, r.want_code_id), (math.inf, 0)), (r.cost, r.code_code_id))
    rows = asked.collect()
    assert len(got) == len(rows)
    for r in rows:
        found, key = got[r.g, r.code_id], (r.g, r.code_id)
        cost, code = (0.0, r.code_id) if key in inside else best.get(key, (None, None))
        why = "kept" if key in inside else "no-class" if code is None else "shape-size" if r["shape"] not in ("round", None) else "smaller"
        assert (found.to_code, found.stones) == (code, r.stones) and found.cost == (None if cost is None else pytest.approx(cost))
        assert found.why == why
    assert {r.why for r in got.values()} == {"kept", "no-class", "shape-size", "smaller"}


def test_remap_sorts_no_row_a_pair(spark, monkeypatch):
    from lapidary.plans import colors
    from lapidary.sources import tables

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(colors, "_DEALT", 512)
    plan = plan_of(colors.query.queries["remapped_large"](spark, folder))
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan
    # what a task counts and ranks follows from the stones, not from the session's partitions
    assert f", {math.ceil(tables.stones(spark, folder).count() / 512)}), REPARTITION_BY_NUM" in plan
