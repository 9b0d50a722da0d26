"""Layouts of a design compared in one call against their joins."""

import random

import pytest
from pyspark.sql import functions as F

from lapidary.operators import passes, spatial
from lapidary.plans import distances, geometry

SF = "/root/testdata/sf0.001"
KEY = ["design_id"]


@pytest.fixture(scope="module")
def stones(spark):
    """Designs of several sizes in a corner of the canvas, some stones without place or size, or at the same place."""
    r, rows = random.Random(6), []
    for g in [None, *range(9)]:
        for i in range(10 + (g or 0) * 9):
            x, y = round(r.uniform(-3, 30), 1), round(r.uniform(270, 303), 1)
            rows.append((g, i, None if i == 5 else 8.0 if i in (1, 2) else x, 290.0 if i in (1, 2) else y, None if i == 6 else r.choice([2.8, 4.0, 8.0, 10.0]), r.randrange(3), r.choice([0, 1, None])))
    return spark.createDataFrame(rows, "design_id long, stone_id long, x_mm double, y_mm double, phys_mm double, code_id long, size_class int").repartition(3).cache()


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def no_joins(*_, **__):
    raise AssertionError("a small design went by joins")


def predicted(stones):
    i = F.col("stone_id")
    made = {"x_mm": F.col("x_mm") + (i % 5 - 2), "y_mm": F.col("y_mm") - (i % 3 - 1), "code_id": F.col("code_id"), "size_class": F.lit(1)}
    return stones.select("*", (i % 4 != 0).alias("predicted"), *(v.alias(f"p_{c}") for c, v in made.items()))


def test_mutual_scores(stones, monkeypatch):
    want = rows(distances._match_counts(predicted(stones).dropna(subset=KEY)))
    assert len(want) > 5 and rows(passes.mutual_scores(predicted(stones), KEY, no_joins)) == want
    monkeypatch.setattr(passes, "MOST", 40)
    monkeypatch.setattr(passes, "_BLOCK", 3)
    assert rows(passes.mutual_scores(predicted(stones), KEY, distances._match_counts)) == want


def test_match_metrics_deals_designs_out_once(spark, monkeypatch):
    monkeypatch.setattr(spatial, "within", no_joins)
    assert distances.query.queries["match_metrics"](spark, SF).count() > 0


def test_side_by_side(stones, monkeypatch):
    cells = geometry._CELLS
    want = rows(geometry._adjacent(stones.dropna(subset=KEY)))
    assert len(want) > 50 and rows(passes.side_by_side(stones, KEY, no_joins, *cells, least=2.8)) == want
    monkeypatch.setattr(passes, "MOST", 40)
    assert rows(passes.side_by_side(stones, KEY, geometry._adjacent, *cells, least=2.8)) == want


def test_adjacency_deals_designs_out_once(spark, monkeypatch):
    monkeypatch.setattr(geometry, "owners", no_joins)
    assert geometry.query.queries["adjacency"](spark, SF).count() > 0
