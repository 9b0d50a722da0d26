"""Twins of a design in one call against the joins of ``matching``."""

import inspect
import random

import pytest

from lapidary.operators import images, matching, passes
from lapidary.plans import matches

ITEMS = "g long, stone_id long, x_mm double, y_mm double, d_mm double, lab_l double, lab_a double, lab_b double"


@pytest.fixture(scope="module")
def items(spark):
    r, rows = random.Random(4), []
    for g in [None, *range(10)]:
        for i in range(12 + (g or 0) * 4):
            x, y = 150 - r.uniform(5, 60), r.choice([20.0, 21.0, round(r.uniform(0, 60), 1)]) + (1e7 if g == 4 else 0.0)
            size, lab = r.choice([2.0, 4.0, 5.0, 6.0]), [None if i == 7 else float(r.randrange(0, 90, 12)) for _ in range(3)]
            rows.append((g, i, None if i == 5 else x, y, None if i == 6 else size, *lab))
            if i % 5:
                rows.append((g, 1000 + i, 302 - x + r.choice([0.0, 0.1, -0.2]), y + r.choice([0.0, 0.1]), size * r.choice([1.0, 1.1]), *lab))
    return spark.createDataFrame(rows, ITEMS).repartition(3).cache()


def rows(df):
    return sorted((r["g"], r["a"], r["b"], round(r["off"], 6), round(r["axis"], 6)) for r in df.collect())


def no_joins(*_, **__):
    raise AssertionError("a small design went by joins")


def test_twins(items, monkeypatch):
    joined = matching.twins(items, matching.local_axes(matching.axis_votes(items, ["g"], 150.0), ["g"], 150.0), ["g"], 7.0)
    want = rows(joined)
    with monkeypatch.context() as m:
        for step in ("axis_votes", "local_axes", "twins"):
            m.setattr(matching, step, no_joins)
        assert rows(images.twins(items, ["g"], 150.0, 7.0)) == want and len(want) > 40
        assert images.twins(items.limit(0), ["g"], 150.0, 7.0).count() == 0
    for block in (1, 7):
        monkeypatch.setattr(passes, "_BLOCK", block)
        monkeypatch.setattr(images, "_VOTES", block)
        monkeypatch.setattr(passes, "MOST", 60)
        assert rows(images.twins(items, ["g"], 150.0, 7.0)) == want


def test_values_are_those_of_the_joins():
    given = lambda f: {k: p.default for k, p in inspect.signature(f).parameters.items() if p.default is not p.empty}
    assert given(matching.axis_votes) == {"row": images.ROW, "span": images.SPAN, "least": images.VOTER, "ratio": images.RATIO, "differ": images.DIFFER}
    assert given(matching.local_axes) == {"step": images.STEP, "band": images.BAND, "bin_mm": images.BIN, "min_votes": images.LEAST_VOTES, "sigma": images.SIGMA, "fill": images.FILL}
    assert given(matching.twins) == {"step": images.STEP, "least": images.LEAST, "aside": images.ASIDE, "ratio": images.IMAGE_RATIO, "differ": images.IMAGE_DIFFER}


def test_query_deals_designs_out_once(spark, monkeypatch):
    for step in ("axis_votes", "local_axes", "twins"):
        monkeypatch.setattr(matching, step, no_joins)
    assert matches.query.queries["twin_stones"](spark, "/root/testdata/sf0.001").count() > 0
