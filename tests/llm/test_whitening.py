"""Whitening against one decomposition of the whole fit list, whole numbers by Python's own arithmetic."""

import math

import numpy as np
from pyspark.sql import functions as F

from lapidary.llm import whitening
from lapidary.llm.whitening import Scatter, Summary


def test_merged_summaries_are_the_summary_of_all():
    r = np.random.default_rng(4)
    x = r.integers(-3000, 3000, (500, 7)) @ np.diag([1, 2, 3, 1, 0, 5, 1]) + 1_000_000
    x[:, 6] += 40_000 * (np.arange(500) > 250)  # parts of different means
    cuts = [0, 1, 3, 250, 400, 500]
    parts = [Summary.of(x[a:b]) for a, b in zip(cuts, cuts[1:])]
    found = parts[4].merge(parts[0]).merge(parts[2].merge(parts[3]).merge(parts[1]))
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert found.n == 500 and found.sums == x.sum(axis=0).tolist()
    np.testing.assert_allclose(found.s, s, rtol=1e-12, atol=1e-8)
    np.testing.assert_allclose(np.abs((found.vt[:6] * vt[:6]).sum(axis=1)), 1, rtol=1e-12)
    back = Summary.back(*found.row())
    assert back.n == 500 and back.sums == found.sums and (back.vt == found.vt).all() and (back.s == found.s).all()
    w = r.normal(size=(90, 3)) + 50
    all_of, two = Scatter.of(w), Scatter.of(w[:20]).merge(Scatter.of(w[20:]))
    np.testing.assert_allclose(two.products, all_of.products, rtol=1e-10)
    np.testing.assert_allclose(two.mean, all_of.mean)


def test_sums_beyond_64_bits():
    x = np.array([[2**61, -(2**61)]] * 9)
    assert whitening.exact_sums(x) == [9 * 2**61, -9 * 2**61]
    assert Summary.back(*Summary.of(x).row()).sums == [9 * 2**61, -9 * 2**61]


def whole(v):
    return [math.floor(64 * c) + 1_000_000 for c in v]


def check(got, rows):
    """Every row and component, of vectors of one length."""
    xs = [(i, whole(v)) for i, v in rows]
    fit = np.array(sorted(set(map(tuple, (x for _, x in xs)))))
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - fit.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(16, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == k * len(rows)
    sign = {}
    by_row = {}
    for r in got:
        by_row.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    for i, x in xs:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        mine = by_row[i, deviation if deviation < 2**63 else None]
        for c in range(k):
            want = (np.array([n * a - s for a, s in zip(x, sums)], float) / n) @ v[:, c] / np.sqrt(e[c])
            found = [r for r in mine if r["component"] == c + 1]
            assert found and {r["n"] for r in found} == {n}
            if abs(want) > 1e-3 and c not in sign:
                sign[c] = min((1, -1), key=lambda t: min(abs(t * r["whitened"] - want) for r in found))
            assert min(abs(sign.get(c, 1) * r["whitened"] - want) for r in found) < 1e-6
            assert all(abs(r["explained"] / (e[c] / e.sum()) - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-8 for r in found)


def test_whitening(spark):
    r = np.random.default_rng(6)
    spread = np.linspace(3, 0.4, 20)
    rows = [(i, (r.normal(size=20) * spread + 5).tolist()) for i in range(700)]
    rows += [(5000 + i, rows[3][1]) for i in range(300)] + [(8, rows[9][1]), (8, rows[9][1]), (None, rows[10][1])]  # repeated rows, a null id
    short = [(9000 + i, r.normal(size=3).tolist()) for i in range(40)]
    bad = [(1, None), (2, []), (3, [None] * 20), (4, [float("nan")] * 20), (5, [float("inf")] * 20), (6, [1e300] * 20), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows + short + bad, "vec_id long, embedding array<double>").withColumn("x", F.lit("x")).withColumn("n", F.lit(1)).repartition(40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")  # two rounds of merging
    try:
        own = whitening.whole_numbers(df)
        models = whitening.fit(own)
        got = whitening.whiten(own, models).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ids = {i for i, _ in short}
    check([x for x in got if x["vec_id"] in ids], short)
    check([x for x in got if x["vec_id"] not in ids], rows)
    assert set(models) == {20, 3, 2} and len(models[2].e) == 0  # one vector has no component


def test_whitening_beyond_longs(spark):
    r = np.random.default_rng(9)
    rows = [(i, (r.normal(size=2) * [1e9, 3e12]).tolist()) for i in range(50)]
    own = whitening.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = whitening.whiten(own, whitening.fit(own)).collect()
    assert any(x["deviation"] is None for x in got)
    check(got, rows)


def test_whitening_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    own = whitening.whole_numbers(df)
    assert whitening.whiten(own, whitening.fit(own)).count() == 0
    own = whitening.whole_numbers(df.limit(0))
    assert whitening.whiten(own, whitening.fit(own)).count() == 0
