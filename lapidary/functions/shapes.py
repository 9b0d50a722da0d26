"""Outlines of stones as polygons, and the signed gap between two of them, for batches of pairs."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Points of an outline; a round one and one that counts as an ellipse have half as many.
POINTS = 64
# The heart's curve, as multiples of the sine's cube and of cosines.
HEART_X, HEART_Y = 16.0, (13.0, -5.0, -2.0, -1.0)
# A star's tips, and its inner and outer radius as parts of its box.
TIPS, STAR = 5, (0.5, 0.2)
#: Of a distance that leaves a point or an edge out, in mm.
SLACK = 1e-6
#: Points measured against all edges of a polygon at once.
AT_ONCE = 4096


def marquise(w: float, h: float, n: int = POINTS) -> np.ndarray:
    """A lens: two arcs of one circle through both ends of the long side."""
    radius = (w * w + h * h) / (4 * w)
    y = np.linspace(-h / 2, h / 2, n // 2 + 1)
    x = np.maximum(np.sqrt(np.maximum(radius**2 - y**2, 0)) - (radius - w / 2), 0)
    return np.concatenate([np.stack([x, y], 1), np.stack([-x, y], 1)[-2:0:-1]])


def teardrop(w: float, h: float, n: int = POINTS) -> np.ndarray:
    """A disc as wide as the drop, and the two tangents from the tip below it."""
    r = w / 2
    centre = r - h / 2
    touch = np.arccos(min(1.0, r / (h / 2 - centre)))
    t = np.linspace(np.pi / 2 + touch, np.pi / 2 + 2 * np.pi - touch, n - 1)
    return np.concatenate([np.stack([r * np.cos(t), centre + r * np.sin(t)], 1), [[0.0, h / 2]]])


def heart(w: float, h: float, n: int = POINTS) -> np.ndarray:
    """The curve of that name, stretched to the box, its tip below."""
    t = 2 * np.pi * np.arange(n) / n
    p = np.stack([HEART_X * np.sin(t) ** 3, -sum(f * np.cos((k + 1) * t) for k, f in enumerate(HEART_Y))], 1)
    low, high = p.min(axis=0), p.max(axis=0)
    return ((p - low) / (high - low) - 0.5) * (w, h)


def star(w: float, h: float) -> np.ndarray:
    t = np.arange(2 * TIPS) * np.pi / TIPS - np.pi / 2
    return np.tile(STAR, TIPS)[:, None] * np.stack([w * np.cos(t), h * np.sin(t)], 1)


def ellipse(w: float, h: float, n: int = POINTS // 2) -> np.ndarray:
    t = 2 * np.pi * np.arange(n) / n
    return np.stack([w / 2 * np.cos(t), h / 2 * np.sin(t)], 1)


OUTLINES = {"marquise": marquise, "teardrop": teardrop, "heart": heart, "star": star}


@lru_cache(1024)
def _outline(name: str, w: float, h: float) -> np.ndarray:
    p = OUTLINES.get(name, ellipse)(w, h)
    return np.concatenate([p, np.repeat(p[-1:], POINTS - len(p), axis=0)])


def outlines(shape: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, rot: np.ndarray) -> np.ndarray:
    """Polygons (stone, point, 2) on the canvas, turned by ``rot`` degrees; the last point of a shorter one is repeated."""
    number: dict[tuple, int] = {}
    back = [number.setdefault(kind, len(number)) for kind in zip(shape.tolist(), w.tolist(), h.tolist())]
    out = np.stack([_outline(*kind) for kind in number])[back] if number else np.empty((0, POINTS, 2))
    turn = np.radians(rot)[:, None]
    u, v = out[..., 0].copy(), out[..., 1].copy()
    out[..., 0] = x[:, None] + u * np.cos(turn) - v * np.sin(turn)
    out[..., 1] = y[:, None] + u * np.sin(turn) + v * np.cos(turn)
    return out


def _inside(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each point of polygons p (pair, point, 2) whether it lies inside q, by the edges of q that cross its height."""
    above = q[:, None, :, 1] > p[:, :, None, 1]
    pair, point, edge = np.nonzero(above != np.roll(above, -1, axis=2))
    (ax, ay), (bx, by), (x, y) = q[pair, edge].T, q[pair, (edge + 1) % q.shape[1]].T, p[pair, point].T
    left = x < (bx - ax) * (y - ay) / (by - ay) + ax
    return np.bincount((pair * p.shape[1] + point)[left], minlength=p.shape[0] * p.shape[1]).reshape(p.shape[:2]) % 2 == 1


def _depths(points: np.ndarray, q: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The distance of each point (n, 2) from the edge of its pair's polygon in q."""
    way = np.roll(q, -1, axis=1) - q
    wx, wy = way[..., 0], way[..., 1]
    length = wx * wx + wy * wy
    length[length == 0] = 1.0
    out = np.empty(len(points))
    for start in range(0, len(points), AT_ONCE):
        at = slice(start, start + AT_ONCE)
        of, x, y = pair[at], points[at, 0, None], points[at, 1, None]
        dx, dy, ox, oy = wx[of], wy[of], x - q[of, :, 0], y - q[of, :, 1]
        along = np.clip((ox * dx + oy * dy) / length[of], 0, 1)
        ox -= along * dx
        oy -= along * dy
        out[at] = np.sqrt((ox * ox + oy * oy).min(axis=1))
    return out


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Between the edges of pairs of polygons; where they overlap, the depth of the deepest point, negative.

    Only the points that can decide are measured against all edges: those inside the other polygon, or where there are none,
    those that lie far enough ahead on the way from one middle to the other.
    """
    way = q.mean(axis=1) - p.mean(axis=1)
    size = np.hypot(way[:, 0], way[:, 1])
    way = np.where(size[:, None] > 0, way / np.where(size > 0, size, 1.0)[:, None], (1.0, 0.0))
    along = lambda r: r[..., 0] * way[:, 0, None] + r[..., 1] * way[:, 1, None]
    ahead, behind = along(p), along(q)
    front, back = ahead.max(axis=1), behind.min(axis=1)
    in_q, in_p = np.zeros(p.shape[:2], bool), np.zeros(q.shape[:2], bool)
    # a line between them parts all others
    close = np.flatnonzero(~(back - front > SLACK))
    in_q[close], in_p[close] = _inside(p[close], q[close]), _inside(q[close], p[close])
    met = in_q.any(axis=1) | in_p.any(axis=1)
    deep = np.zeros(len(p))
    for r, other, within in ((p, q, in_q), (q, p, in_p)):
        pair, point = np.nonzero(within)
        np.maximum.at(deep, pair, _depths(r[pair, point], other, pair))
    apart = np.flatnonzero(~met)
    first, last = ahead[apart].argmax(axis=1), behind[apart].argmin(axis=1)
    near = np.full(len(p), np.inf)
    near[apart] = np.minimum(_depths(p[apart, first], q, apart), _depths(q[apart, last], p, apart))
    for r, other, least in ((p, q, back[:, None] - ahead), (q, p, behind - front[:, None])):
        # none is nearer than it is to the line that all of the other lies behind
        pair, point = np.nonzero((least <= near[:, None] + SLACK) & ~met[:, None])
        np.minimum.at(near, pair, _depths(r[pair, point], other, pair))
    return np.where(met, -deep, near)
