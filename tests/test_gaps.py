"""Gaps between outlines against all points and edges."""

import numpy as np
import pytest

from lapidary.functions import shapes


def all_edges(p, q):
    """For each point of polygons p its distance from the edge of q, and whether it lies inside."""
    a, b = q[:, None], np.roll(q, -1, axis=1)[:, None]
    way, to = b - a, p[:, :, None] - a
    length = (way**2).sum(axis=-1)
    along = np.clip((to * way).sum(axis=-1) / np.where(length > 0, length, 1.0), 0, 1)
    near = np.sqrt(((to - along[..., None] * way) ** 2).sum(axis=-1)).min(axis=2)
    y = p[:, :, None, 1]
    above = (a[..., 1] > y) != (b[..., 1] > y)
    at = way[..., 0] * (y - a[..., 1]) / np.where(way[..., 1] == 0, 1.0, way[..., 1]) + a[..., 0]
    return near, (above & (p[:, :, None, 0] < at)).sum(axis=2) % 2 == 1


@pytest.mark.parametrize("spread", [0.0, 3.0, 9.0, 40.0])
def test_gaps_are_those_of_all_points_and_edges(spread):
    r, n = np.random.default_rng(int(spread)), 300
    kinds = np.array(["round", "marquise", "teardrop", "heart", "star", "box"], object)

    def side():
        s, h = kinds[r.integers(0, 6, n)], r.choice([2.8, 4.0, 8.0, 10.0], n)
        w = h * np.where(s == "marquise", 0.5, np.where(s == "teardrop", 0.6, 1.0))
        return shapes.outlines(s, np.round(r.uniform(0, spread, n), 1), np.round(r.uniform(0, spread, n), 1), w, h, r.integers(0, 36, n) * 10.0)

    p, q = side(), side()
    (one, in_q), (two, in_p) = all_edges(p, q), all_edges(q, p)
    deep = np.maximum(np.where(in_q, one, 0).max(axis=1), np.where(in_p, two, 0).max(axis=1))
    want = np.where(in_q.any(axis=1) | in_p.any(axis=1), -deep, np.minimum(one.min(axis=1), two.min(axis=1)))
    assert (shapes.gaps(p, q) == want).all() and (spread != 9.0 or 20 < (want < 0).sum() < n - 20)


def test_few_points_are_measured(monkeypatch):
    """Points of stones that touch or overlap a little: few lie inside the other or ahead of it."""
    many, inner = [], shapes._depths
    monkeypatch.setattr(shapes, "_depths", lambda points, *rest: many.append(len(points)) or inner(points, *rest))
    n = 50
    stone = lambda x: shapes.outlines(np.array(["heart"] * n, object), np.full(n, x), np.zeros(n), np.full(n, 8.0), np.full(n, 8.0), np.arange(n) * 7.0)
    shapes.gaps(stone(0.0), stone(8.2))
    assert sum(many) < n * 128 / 4


def test_no_pairs():
    none = shapes.outlines(np.empty(0, object), *[np.empty(0)] * 5)
    assert none.shape == (0, shapes.POINTS, 2) and len(shapes.gaps(none, none)) == 0
