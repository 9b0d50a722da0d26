"""Palettes fitted to wanted colours and to pictures, against plain loops over all items and codes."""

import math
import random

import pytest

from lapidary.operators import fit


def apart(p, q):
    return math.dist(p, q)


def hue_ok(image, code):
    turn = lambda v: math.degrees(math.atan2(v[2], v[1]))
    return math.hypot(*code[1:]) < 15 or (math.hypot(*image[1:]) >= 6 and abs((turn(image) - turn(code) + 540) % 360 - 180) <= 50)


def make(seed, n, m, dark=0.1):
    r = random.Random(seed)
    lab = lambda low: (r.uniform(0, 20) if low else r.uniform(30, 100), r.uniform(-60, 60) * r.random(), r.uniform(-60, 60) * r.random())
    items = []
    for i in range(n):
        image = lab(r.random() < dark)
        items.append((i, r.choice([2.8, 4.0, 6.0]), float(r.randrange(1, 5)), tuple(v + r.uniform(-6, 6) for v in image), image))
    codes = [(c, r.choice([2.8, 4.0, 5.0, 8.0]), lab(r.random() < 0.15)) for c in range(m)]
    return items, codes


def frames(spark, items, codes):
    a = spark.createDataFrame([(i, mm, w, *t, *p) for i, mm, w, t, p in items], "item long, mm double, weight double, t_l double, t_a double, t_b double, i_l double, i_a double, i_b double")
    return a, spark.createDataFrame([(c, mm, *lab) for c, mm, lab in codes], "code_id long, mm double, c_l double, c_a double, c_b double")


def cost(item, code):
    return apart(item[3], code[2]) + 2 * (item[1] - code[1]) if code[1] <= item[1] + 1e-6 else math.inf


@pytest.mark.parametrize("seed, base, most", [(1, [3, 7, 500], 2), (2, [], 3), (3, [1], 4)])
def test_targets(spark, seed, base, most):
    items, codes = make(seed, 60, 50)
    have = [c for b in base for c in codes if c[0] == b]
    now, added = [min([1e3, *(cost(i, c) for c in have)]) for i in items], []
    for _ in range(most):
        gains = {c[0]: sum(max(n - cost(i, c), 0) for i, n in zip(items, now)) for c in codes if c not in have}
        top = max(codes, key=lambda c: (gains.get(c[0], -1), -c[0]))
        have.append(top)
        added.append((top[0], gains[top[0]]))
        now = [min(n, cost(i, top)) for i, n in zip(items, now)]
    want = {}
    for i in items:
        fits = [c for c in have if c[1] <= i[1] + 1e-6]
        want[i[0]] = (min(fits, key=lambda c: cost(i, c)) if fits else min(have, key=lambda c: apart(i[3], c[2])))[0]
    got, found = fit.fit_targets(*frames(spark, items, codes), base, most)
    assert [c for c, _ in got] == [c for c, _ in added] and [g for _, g in got] == pytest.approx([g for _, g in added])
    assert {r["item"]: r["code_id"] for r in found.collect()} == want


@pytest.mark.parametrize("seed, base, most, dark", [(4, [3, 7], 2, 0.0), (5, [0], 3, 0.3), (6, [], 2, 0.3)])
def test_image(spark, seed, base, most, dark):
    items, codes = make(seed, 80, 60, dark)
    fits = lambda i, c: c[1] <= i[1] + 1e-6
    d = lambda i, c: apart(i[4], c[2])
    nearest = {i[0]: min((d(i, c) for c in codes if fits(i, c)), default=math.inf) for i in items}
    suits = lambda i, c: fits(i, c) and hue_ok(i[4], c[2]) and d(i, c) <= nearest[i[0]] + 12
    weight = {i[0]: i[2] * (3 if i[4][0] < 25 else 1) for i in items}
    total, have, added = sum(weight.values()), [codes[b] for b in base], []
    near = lambda i: min([100.0, *(d(i, c) for c in have if suits(i, c))])
    reserve = sum(i[4][0] < 25 and near(i) >= 100 for i in items) >= 5 and most >= 2
    assert reserve == (dark > 0)
    for n in range(most):
        now, rated = {i[0]: near(i) for i in items}, []
        for c in codes:
            own = [i for i in items if suits(i, c)]
            gain = sum(weight[i[0]] * max(now[i[0]] - d(i, c), 0) for i in own if not (reserve and n == 0) or i[4][0] < 25)
            support = sum(weight[i[0]] for i in own) / total
            if c not in have and gain > 0 and support >= 0.02:
                rated.append((gain / total, -c[0], support, c))
        if not rated:
            break
        top = max(rated)
        have.append(top[3])
        added.append((top[3][0], top[0], top[2]))
    want = {}
    for i in items:
        pool = [c for c in have if suits(i, c) and d(i, c) <= near(i) + 12]
        if pool:
            best, free = min(pool, key=lambda c: cost(i, c)), min([c for c in have if fits(i, c)], key=lambda c: cost(i, c))
            want[i[0]] = (best[0], "gated" if best != free else "suited")
        else:
            want[i[0]] = (min([c for c in have if fits(i, c)] or have, key=lambda c: d(i, c))[0], "unsuited")
    got, found = fit.fit_image(*frames(spark, items, codes), base, most)
    assert [g[0] for g in got] == [a[0] for a in added] and len(added) == most
    for g, a in zip(got, added):
        assert g[1:] == pytest.approx(a[1:])
    assert {r["item"]: (r["code_id"], r["how"]) for r in found.collect()} == want and len({h for _, h in want.values()}) > 1


def test_a_palette_without_codes_is_an_error(spark):
    items, codes = make(9, 3, 2)
    with pytest.raises(ValueError):
        fit.fit_targets(*frames(spark, items, codes), [77], 0)


def test_alike_codes_meet_items_once(spark):
    codes = spark.range(600).selectExpr("id AS code_id", "CAST(id % 2 AS DOUBLE) + 1 AS mm", "CAST(id % 5 AS DOUBLE) AS c_l", "0.0D AS c_a", "0.0D AS c_b")
    assert sorted(r["code_id"] for r in fit._offers(codes).collect()) == list(range(10))
    items = spark.range(8).selectExpr("id AS item", "2.0D AS mm", "1.0D AS weight", *(f"CAST(id % 5 AS DOUBLE) AS {p}_l" for p in "ti"), *(f"0.0D AS {p}_{x}" for p in "ti" for x in "ab"))
    added, found = fit.fit_targets(items, codes, [0], 2)
    again, same = fit.fit_targets(items, codes.where("code_id < 10"), [0], 2)
    assert added == again and sorted(found.collect()) == sorted(same.collect())
