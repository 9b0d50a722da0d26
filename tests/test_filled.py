"""Filled places of a design in one call against the joins of ``fill``, which have tests of their own."""

import random

import pytest
from pyspark.sql import functions as F

from lapidary.operators import fill, filled, passes
from lapidary.plans import fills
from test_fill import BEADS

KEY = ["g"]
RULE = fill.Fill(near=2, cover=0.2, de=30.0, link=2.5, beads=4, inner=0.2)


@pytest.fixture(scope="module")
def strewn(spark):
    """Beads close together, one design without a key, some without material, solidity or place, sizes and places far out."""
    r, rows = random.Random(7), []
    for g in [None, *range(14)]:
        far = 1e9 if g == 3 else -70.0 if g == 4 else 0.0
        for i in range(25 + (g or 0) % 5 * 14):
            x, y = (round(r.uniform(0, 30) + far, 1) for _ in "xy")
            lab = [float(r.randrange(40)), float(r.randrange(30)), float(r.randrange(30))]
            rows.append((g, i, None if i == 5 else x, y, None if i == 6 else r.choice([2.0, 2.6, 3.2, 7.0]), r.choice(["round"] * 6 + ["heart", None]), r.choice(["gold", "color", "color", "pearl", None]), *lab, r.choice([0.8, 0.95, None])))
    return spark.createDataFrame(rows, BEADS).repartition(3).cache()


def rows(df):
    value = lambda v: (v is not None, round(v, 6) if isinstance(v, float) else v)
    return sorted(tuple(map(value, r)) for r in df.select(*sorted(df.columns)).collect())


def no_joins(*_, **__):
    raise AssertionError("a small design went by joins")


def alike(query, monkeypatch):
    """No pair as a row for designs that a task may hold, and the same rows if the larger ones go by joins."""
    with monkeypatch.context() as m:
        for step in ("within", "components", "cover", "grow"):
            m.setattr(fill, step, no_joins)
        got = rows(query())
    with monkeypatch.context() as m:
        m.setattr(passes, "MOST", 45)
        assert rows(query()) == got
    return got


def test_surroundings(strewn, monkeypatch):
    got = alike(lambda: filled.surroundings(strewn, KEY, F.lit(2.8), RULE), monkeypatch)
    assert got == rows(fill.surroundings(strewn, KEY, F.lit(2.8), RULE))
    shown = filled.surroundings(strewn, KEY, F.lit(2.8), RULE)
    assert shown.where("g is null").count() > 0 and shown.where("dense").count() > 20 and shown.where("cover is not null and not dense").count() > 0
    assert filled.surroundings(strewn.limit(0), KEY, F.lit(2.8), RULE).count() == 0


def test_regions(strewn, monkeypatch):
    got = alike(lambda: filled.regions(strewn, KEY, F.lit(2.8), RULE), monkeypatch)
    assert {v[1] for r in got for v in r} >= {"fill", "few"}


def test_grown(spark, strewn, monkeypatch):
    rule = fill.Fill(near=1, spread=0.0, cover=0.1, de=40.0, link=3.0, beads=2, inner=0.0, solid=0.0)
    monkeypatch.setattr(fills, "SPARSE", rule)
    monkeypatch.setattr(fills, "KEY", KEY)
    beads = strewn.where("material is not null and x_mm is not null and d_mm is not null")

    def joined(df, members, found):
        design = [t.withColumnRenamed("g", "design_id") for t in (df, members, found)]
        with monkeypatch.context() as m:
            m.setattr(fills, "KEY", ["design_id"])
            return fills._grown(*design).withColumnRenamed("design_id", "g")

    got = alike(lambda: filled.grown(beads, KEY, F.lit(2.8), 5.0, joined, rule), monkeypatch)
    assert len(got) > 5


@pytest.mark.parametrize("name", ["fill_signs", "fill_regions", "grown_regions"])
def test_queries_deal_designs_out_once(spark, monkeypatch, name):
    for step in ("within", "components", "cover", "grow"):
        monkeypatch.setattr(fill, step, no_joins)
    assert fills.query.queries[name](spark, "/root/testdata/sf0.001").count() > 0
