"""Twins about local axes over designs of bounded size: a design is one call, as in ``passes``; larger ones go by the joins of ``matching``.

Items are dealt out by design once; votes, axes and images follow in that call, so that none of them is ever a row. Results
are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lapidary.operators import matching
from lapidary.operators.passes import between, by_group
from lapidary.operators.spatial import stored

_VOTES = 65536
_NUMBERS = ["x_mm", "y_mm", "d_mm", "lab_l", "lab_a", "lab_b"]
# the values that ``matching`` gives its steps unless told otherwise
ROW, SPAN, VOTER, RATIO, DIFFER = 1.2, 30.0, 3.0, 1.25, 15.0
STEP, BAND, BIN, LEAST_VOTES, SIGMA, FILL = 2.0, 15.0, 0.5, 2.0, 6.0, 10.0
LEAST, ASIDE, IMAGE_RATIO, IMAGE_DIFFER = 4.5, 0.5, 1.8, 30.0


def _joined(parts: list[tuple], *kinds: type) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(c) for c in zip(tuple(np.empty(0, k) for k in kinds), *parts))


class _Items:
    """The items of one design as arrays, those without a place left out."""

    def __init__(self, pdf: pd.DataFrame):
        x, y, size, *lab = (pdf[c].to_numpy(float) for c in _NUMBERS)
        at = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        self.item, self.x, self.y, self.d, self.lab = pdf["stone_id"].to_numpy()[at], x[at], y[at], size[at], np.stack(lab, axis=1)[at]

    def alike(self, i: np.ndarray, j: np.ndarray, ratio: float, differ: float) -> np.ndarray:
        dl, da, db = (self.lab[i] - self.lab[j]).T
        return (np.maximum(self.d[i], self.d[j]) / np.minimum(self.d[i], self.d[j]) <= ratio) & (np.sqrt(dl * dl + da * da + db * db) <= differ)


def _votes(t: _Items, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """As ``matching.axis_votes``: y, mid."""
    seen = np.flatnonzero(t.d >= VOTER)
    seen = seen[np.lexsort((t.item[seen], t.y[seen]))]
    y, found = t.y[seen], []
    for p, q in between(y, y, y + (ROW + 1e-6)):
        p, q = seen[p[p < q]], seen[q[p < q]]
        mid = (t.x[p] + t.x[q]) / 2
        met = (t.y[q] - t.y[p] <= ROW) & (np.abs(mid - prior) <= SPAN) & (np.abs(t.x[p] - t.x[q]) >= t.d[p])
        p, q, mid = p[met], q[met], mid[met]
        met = t.alike(p, q, RATIO, DIFFER)
        found.append(((t.y[p[met]] + t.y[q[met]]) / 2, mid[met]))
    return _joined(found, float, float)


def _summed(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (k, bin, weight) one row a k and bin, ascending, with the sum of its weights."""
    k, bin_, w = _joined(parts, np.int64, np.int64, float)
    by = np.lexsort((bin_, k))
    k, bin_, w = k[by], bin_[by], w[by]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (bin_[1:] != bin_[:-1])])) if len(k) else np.empty(0, int)
    return k[first], bin_[first], np.add.reduceat(w, first) if len(k) else w


def _axes(y: np.ndarray, mid: np.ndarray, prior: float) -> dict[int, float]:
    """As ``matching.local_axes``: height -> axis."""
    if not len(y):
        return {}
    bin_, weight = np.floor(mid / BIN + 0.5).astype(np.int64), np.exp(-(mid - prior) * (mid - prior) / (2 * SIGMA * SIGMA))
    low, high = np.ceil((y - BAND) / STEP).astype(np.int64), np.floor((y + BAND) / STEP).astype(np.int64)

    def spread() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Heights and the votes that count at them, some votes at a time."""
        for start in range(0, len(y), _VOTES):
            at = np.arange(start, min(start + _VOTES, len(y)))
            many = high[at] - low[at] + 1
            of = np.repeat(at, many)
            yield low[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many), of

    k, place, sums = _summed([_summed([(h, bin_[of] + i, weight[of] * f) for i, f in ((-1, 0.5), (0, 1.0), (1, 0.5))]) for h, of in spread()])
    votes = np.floor(sums * 1e9 + 0.5)
    by = np.lexsort((place, -votes, k))
    heights, first = np.unique(k[by], return_index=True)
    strong = votes[by][first] >= LEAST_VOTES * 1e9
    heights, peak = heights[strong], place[by][first][strong]
    total, count = np.zeros(len(heights)), np.zeros(len(heights), np.int64)
    for h, of in spread():
        at = np.searchsorted(heights, h)
        known = at < len(heights)
        known[known] = heights[at[known]] == h[known]
        at, of = at[known], of[known]
        near = np.abs(mid[of] - peak[at] * BIN) <= 1.5 * BIN
        total += np.bincount(at[near], weights=mid[of[near]], minlength=len(heights))
        count += np.bincount(at[near], minlength=len(heights))
    own = {int(h): float(np.floor(s / n * 1e9 + 0.5) / 1e9) for h, s, n in zip(heights, total, count) if n}
    out: dict[int, tuple] = {}
    reach = int(FILL / 2)
    for h, axis in own.items():
        for d in range(-reach, reach + 1):
            out[h + d] = min(out.get(h + d, (reach + 1,)), (abs(d), h, axis))
    return {h: axis for h, (_, _, axis) in out.items()}


def _images(t: _Items, big: np.ndarray, rows: np.ndarray, axis: np.ndarray, side: int, reach: float) -> dict[int, tuple[int, float]]:
    """Of the items ``rows`` with their axes the nearest image each among ``big``: place -> its place, how far off."""
    by = big[np.argsort(t.x[big], kind="stable")]
    x, xs, found = 2 * axis - t.x[rows], t.x[by], []
    for p, q in between(xs, x - (reach + 1e-6), x + (reach + 1e-6)):
        me, you = rows[p], by[q]
        dx, dy = x[p] - t.x[you], t.y[me] - t.y[you]
        off = np.sqrt(dx * dx + dy * dy)
        fits = (off < reach) & (off <= 0.35 * np.maximum(t.d[me], t.d[you]) + 0.8) & ((t.x[you] - axis[p]) * side > 0) & (t.item[me] != t.item[you])
        me, you, off = me[fits], you[fits], off[fits]
        fits = t.alike(me, you, IMAGE_RATIO, IMAGE_DIFFER)
        found.append((me[fits], you[fits], off[fits]))
    me, you, off = _joined(found, int, int, float)
    best = np.lexsort((t.item[you], off, me))
    me, first = np.unique(me[best], return_index=True)
    return dict(zip(me.tolist(), zip(you[best][first].tolist(), off[best][first].tolist())))


_TWINS = ["a", "b", "off", "axis"]


def twins(items: DataFrame, keys: list[str], prior: float, largest: float) -> DataFrame:
    """``matching.twins`` about the ``matching.local_axes`` of the items' own ``matching.axis_votes``: keys, a, b, off, axis."""
    reach = 0.35 * largest + 0.81

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        t = _Items(pdf)
        axes = _axes(*_votes(t, prior), prior)
        big = np.flatnonzero(t.d >= LEAST)
        axis = np.array([axes.get(h, np.nan) for h in np.floor(t.y[big] / STEP + 0.5).astype(np.int64).tolist()], float)
        placed, axis = big[~np.isnan(axis)], axis[~np.isnan(axis)]
        left = t.x[placed] < axis - ASIDE
        there, back = _images(t, big, placed[left], axis[left], 1, reach), _images(t, big, placed, axis, -1, reach)
        of = dict(zip(placed.tolist(), axis.tolist()))
        rows = [(t.item[me], t.item[you], off, of[me]) for me, (you, off) in there.items() if back.get(you, (-1,))[0] == me]
        return pd.DataFrame(rows, columns=_TWINS)

    def rounds(df: DataFrame) -> DataFrame:
        df = stored(df, "items")
        return matching.twins(df, matching.local_axes(matching.axis_votes(df, keys, prior), keys, prior), keys, largest).select(*keys, *_TWINS)

    return by_group(items.select(*keys, "stone_id", *_NUMBERS), keys, fold, "a long, b long, off double, axis double", rounds)
