"""The rules of ``fill`` over designs of bounded size: a design is one call, as in ``passes``; larger ones go by the joins of ``fill``.

Beads are dealt out by design once and all steps follow in that call, so that no pair, no cell and no line of cells is ever a
row. Results are the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from lapidary.operators import fill
from lapidary.operators.fill import Fill
from lapidary.operators.passes import by_group, near_pairs
from lapidary.operators.spatial import stored

_NUMBERS = ["x_mm", "y_mm", "d_mm", "lab_l", "lab_a", "lab_b", "solidity", "smallest_mm"]


def _rows(beads: DataFrame, keys: list[str], smallest: Column) -> DataFrame:
    return beads.select(*keys, "stone_id", *_NUMBERS[:-1], "shape", "material", smallest.alias("smallest_mm"))


def _rounded(v: np.ndarray, digits: int = 6) -> np.ndarray:
    return np.floor(v * 10.0**digits + 0.5) / 10.0**digits


def _below(v: np.ndarray, least: np.ndarray | float) -> np.ndarray:
    """1 or 0, nothing where either is missing."""
    return np.where(np.isnan(v) | np.isnan(least), np.nan, v < least)


def _apart(p: np.ndarray, q: np.ndarray, l_weight: float) -> np.ndarray:
    """As ``fill.difference``."""
    dl, da, db = (p - q).T
    return np.sqrt(l_weight * l_weight * dl * dl + da * da + db * db)


def _upper(v: np.ndarray) -> float:
    v = np.sort(v[~np.isnan(v)])
    return float(v[len(v) // 2]) if len(v) else math.nan


class _Beads:
    """The beads of one design as arrays."""

    def __init__(self, pdf: pd.DataFrame, keys: list[str]):
        self.item = pdf["stone_id"].to_numpy()
        self.x, self.y, self.d, *lab, self.solidity, self.smallest = (pdf[c].to_numpy(float) for c in _NUMBERS)
        self.lab, self.shape, self.material = np.stack(lab, axis=1), pdf["shape"].to_numpy(), pdf["material"].to_numpy()
        # what has no key or no material has no neighbours
        self.kind = pd.factorize(self.material)[0] if pdf[keys].iloc[0].notna().all() else np.full(len(pdf), -1)

    def pairs(self, at: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beads i, j among ``at`` of one material, each pair once, up to ``reach`` apart, and their distance."""
        found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for kind in np.unique(self.kind[at]):
            own = at[self.kind[at] == kind]
            if kind >= 0 and len(own) > 1:
                i, j, distance = near_pairs(self.x[own], self.y[own], np.full(len(own), reach), 1e-6)
                found.append((own[i], own[j], distance))
        return tuple(np.concatenate(c) for c in zip(*found))


def _cover(b: _Beads, at: np.ndarray, r: np.ndarray, cell: float) -> np.ndarray:
    """As ``fill.cover`` for the beads ``at`` with radii ``r``; missing where the square is empty."""
    out = np.full(len(at), np.nan)
    # runs of cells under a bead in each row of cells
    real = np.flatnonzero((b.d > 0) & np.isfinite(b.d) & np.isfinite(b.x) & np.isfinite(b.y))
    cx, cy, rr = b.x[real] / cell, b.y[real] / cell, b.d[real] / 2 / cell
    low, high = np.ceil(cy - rr).astype(np.int64), np.floor(cy + rr).astype(np.int64)
    row, of = _ranges(low, high + 1)
    half = np.sqrt(np.maximum(rr[of] * rr[of] - (row - cy[of]) * (row - cy[of]), 0.0))
    first, end = np.ceil(cx[of] - half).astype(np.int64), np.floor(cx[of] + half).astype(np.int64) + 1
    row, first, end = (v[end > first] for v in (row, first, end))
    # squares, and their lines in rows that hold any run
    side = r / cell * math.sqrt(math.pi) / 2
    px, py = b.x[at] / cell, b.y[at] / cell
    whole = np.flatnonzero(np.isfinite(px) & np.isfinite(py) & np.isfinite(side))
    x0, x1, y0, y1 = (np.floor(v[whole] + 0.5).astype(np.int64) for v in (px - side, px + side, py - side, py + side))
    good = (x1 > x0) & (y1 > y0)
    whole, x0, x1, y0, y1 = (v[good] for v in (whole, x0, x1, y0, y1))
    held = np.zeros(len(whole), np.int64)
    if len(row) and len(whole):
        # places as ranks: rows and columns may lie anywhere
        rows, rank = np.unique(row, return_inverse=True)
        xs = np.unique(np.concatenate([first, end, x0, x1]))
        n, place = len(xs), lambda v: np.searchsorted(xs, v)
        start, stop = rank * n + place(first), rank * n + place(end)
        by = np.argsort(start, kind="stable")
        start, stop = start[by], stop[by]
        # of each run what those before it leave
        start[1:] = np.maximum(start[1:], np.maximum.accumulate(stop)[:-1])
        start, stop = start[stop > start], stop[stop > start]
        length = xs[stop % n] - xs[start % n]
        sums = np.concatenate([[0], np.cumsum(length)])

        def before(line: np.ndarray, x: np.ndarray) -> np.ndarray:
            """Cells under beads before x in the line and in all lines above."""
            key = line * n + place(x)
            last = np.searchsorted(start, key)
            over = np.where(last > 0, stop[last - 1] > key, False)
            return sums[last] - np.where(over, xs[stop[last - 1] % n] - x, 0)

        line, of = _ranges(np.searchsorted(rows, y0), np.searchsorted(rows, y1))
        np.add.at(held, of, before(line, x1[of]) - before(line, x0[of]))
    out[whole] = _rounded(held / ((x1 - x0) * (y1 - y0)))
    return out


def _ranges(low: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers from each ``low`` to before its ``end``, and which one they are of."""
    many = np.maximum(end - low, 0)
    of = np.repeat(np.arange(len(low)), many)
    return low[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many), of


def _surroundings(b: _Beads, rule: Fill) -> pd.DataFrame:
    """The columns of ``fill.surroundings`` and ``at``, the beads' places."""
    at = np.flatnonzero((b.shape == "round") & (b.d <= rule.largest))
    count, d = len(b.d), b.d
    r = rule.reach * np.maximum(d, rule.least_size)
    i, j, distance = b.pairs(at, rule.reach * max(rule.largest, rule.least_size))
    alike = _apart(b.lab[i], b.lab[j], rule.l_weight) <= rule.de
    i, j, distance = i[alike], j[alike], distance[alike]
    me, you, distance = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([distance, distance])
    me, you = me[distance <= r[me]], you[distance <= r[me]]
    dx, dy = b.x[you] - b.x[me], b.y[you] - b.y[me]
    bad, low = _below(b.solidity, rule.whole), _below(d, 0.9 * b.smallest)
    total = lambda v: np.bincount(me, weights=v, minlength=count)[at]
    n = np.bincount(me, minlength=count)[at]
    xx, yy, xy = total(dx * dx), total(dy * dy), total(dx * dy)
    half, root = (xx + yy) / 2, np.sqrt((xx - yy) * (xx - yy) / 4 + xy * xy)
    round_ = half + root > 0
    two_d = _rounded(np.where(round_, (half - root) / np.where(round_, half + root, 1.0), 0.0))
    mean = (total(d[you]) + d[at]) / (n + 1)
    spread = np.sqrt(np.maximum((total(d[you] * d[you]) + d[at] * d[at]) / (n + 1) - mean * mean, 0.0))
    with np.errstate(invalid="ignore", divide="ignore"):
        cv = _rounded(spread / mean)
    frag, sub = ((total(np.nan_to_num(v)[you]) + v[at]) / (n + 1) for v in (bad, low))
    asked = np.flatnonzero((n >= rule.near) & (two_d >= rule.spread))
    cover = np.full(len(at), np.nan)
    cover[asked] = _cover(b, at[asked], r[at[asked]], rule.cell)
    return pd.DataFrame({"stone_id": b.item[at], "n": n, "two_d": two_d, "cv": cv, "frag": frag, "sub": sub, "cover": cover, "dense": cover >= rule.cover, "at": at})


_SIGNS = "stone_id long, n long, two_d double, cv double, frag double, sub double, cover double, dense boolean"


def surroundings(beads: DataFrame, keys: list[str], smallest: Column, rule: Fill = Fill()) -> DataFrame:
    """As ``fill.surroundings``."""
    fold = lambda pdf: _surroundings(_Beads(pdf, keys), rule).drop(columns="at")
    rounds = lambda df: fill.surroundings(stored(df, "beads"), keys, smallest, rule)
    return by_group(_rows(beads, keys, smallest), keys, fold, _SIGNS, rounds, unkeyed=True)


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that links i, j connect it with."""
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = a = root[root[a]]
        return a

    for a, b in zip(i.tolist(), j.tolist()):
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return np.array([find(a) for a in range(n)], int)


def _regions(b: _Beads, rule: Fill) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Places of dense beads, the region of each, and the regions as ``fill.regions`` rates them."""
    around = _surroundings(b, rule)
    at = around["at"].to_numpy()[around["dense"].to_numpy(bool)]
    at = at[np.argsort(b.item[at], kind="stable")]
    i, j, distance = b.pairs(at, rule.link * rule.largest)
    linked = distance <= rule.link * (b.d[i] + b.d[j]) / 2
    i, j, distance = i[linked], j[linked], distance[linked]
    alike = _apart(b.lab[i], b.lab[j], rule.l_weight) <= rule.de
    # by places among the dense, which ascend by stone
    rank = np.zeros(len(b.d), int)
    rank[at] = np.arange(len(at))
    of = _components(len(at), rank[i[alike]], rank[j[alike]])
    same = of[rank[i]] == of[rank[j]]
    ends, apart = np.concatenate([rank[i[same]], rank[j[same]]]), np.concatenate([distance[same], distance[same]])
    links, nearest = np.bincount(ends, minlength=len(at)), np.full(len(at), np.inf)
    np.minimum.at(nearest, ends, apart)
    found = []
    for first in np.unique(of):
        own = np.flatnonzero(of == first)
        d, lot = b.d[at[own]], at[own]
        mean = d.sum() / len(own)
        inner = float((links[own] >= 3).sum() / len(own))
        cv = float(_rounded(np.sqrt(max((d * d).sum() / len(own) - mean * mean, 0.0)) / mean))
        frag, sub = (float((v < least).sum() / len(own)) for v, least in ((b.solidity[lot], rule.whole), (d, 0.9 * b.smallest[lot])))
        steps = nearest[own][nearest[own] <= 1.6 * d]
        drawn = _upper(d)
        tidy = inner < rule.solid and cv < rule.cv and frag < rule.broken and sub < rule.under
        verdict = "few" if len(own) < rule.beads else "thin" if inner < rule.inner else "tidy" if tidy else "fill"
        found.append((b.item[at[first]], b.material[lot[0]], len(own), drawn, *(_upper(b.lab[lot, k]) for k in range(3)), inner, cv, frag, sub, verdict, _upper(steps) if len(steps) >= 5 else drawn))
    return at, b.item[at[of]], pd.DataFrame(found, columns=_NAMES)


_RATED = "region long, material string, beads long, drawn_mm double, lab_l double, lab_a double, lab_b double, inner double, cv double, frag double, sub double, verdict string, pitch_mm double"
_NAMES = [c.split()[0] for c in _RATED.split(", ")]


def regions(beads: DataFrame, keys: list[str], smallest: Column, rule: Fill = Fill()) -> DataFrame:
    """The regions of dense beads, rated as by ``fill.regions``."""

    rounds = lambda df: _by_joins(df, keys, smallest, rule)[2].select(*keys, *_NAMES)
    return by_group(_rows(beads, keys, smallest), keys, lambda pdf: _regions(_Beads(pdf, keys), rule)[2], _RATED, rounds)


def _by_joins(df: DataFrame, keys: list[str], smallest: Column, rule: Fill) -> tuple[DataFrame, DataFrame, DataFrame]:
    beads = stored(df, "beads")
    dense = stored(fill.surroundings(beads, keys, smallest, rule).where("dense"), "dense")
    return beads, *fill.regions(beads, dense, keys, smallest, rule)


def _picture(b: _Beads, cell: float, largest: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray, list]:
    """Of each bead its cell; the cells, their mean colours, and what is on them, as for ``fill.grow``."""
    at = list(zip(np.floor(b.x / cell).tolist(), np.floor(b.y / cell).tolist()))
    number: dict[tuple, int] = {}
    of = np.array([number.setdefault(p, len(number)) for p in at], int)
    seen = ~np.isnan(b.lab)
    lab = np.stack([np.bincount(of[seen[:, k]], weights=b.lab[seen[:, k], k], minlength=len(number)) for k in range(3)], axis=1)
    many = np.stack([np.bincount(of[seen[:, k]], minlength=len(number)) for k in range(3)], axis=1)
    lab = np.where(many > 0, lab / np.maximum(many, 1), np.nan)
    held: list = [None] * len(number)
    for n, shape, d, material in zip(of.tolist(), b.shape, b.d.tolist(), b.material):
        if (shape is not None and shape != "round") or d > largest or (held[n] is not None and material is not None and held[n] != material):
            # a cell of several materials belongs to none of them
            held[n] = "detail"
        elif held[n] is None:
            held[n] = material
    return at, list(number), lab, held


def _grow(cells: list[tuple[int, int]], lab: np.ndarray, held: list, seeds: list[tuple[int, str, set]], most_de: float, l_weight: float) -> list[tuple]:
    """As ``fill.grow`` over one picture: turn, material, colour, cells, merged. Seeds are (turn, material, cells) by turn."""
    number, owner = {c: n for n, c in enumerate(cells)}, [0] * len(cells)
    refs: dict[int, tuple] = {}
    for turn, material, own in seeds:
        free = [not o and h in (None, material) for o, h in zip(owner, held)]
        start = [number[c] for c in own if c in number and free[number[c]]]
        if not start:
            continue
        ref = np.array([_upper(lab[start, k]) for k in range(3)])
        refs[turn] = (material, ref)
        near = (_apart(lab, ref[None], l_weight) <= most_de).tolist()
        for n in start:
            owner[n] = turn
        while start:
            x, y = cells[start.pop()]
            for beside in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
                n = number.get(beside)
                if n is not None and free[n] and not owner[n] and near[n]:
                    owner[n] = turn
                    start.append(n)
    turns, touching = sorted(refs), set()
    for (x, y), t in zip(cells, owner):
        for beside in ((x + 1, y), (x, y + 1)):
            u = owner[number[beside]] if t and beside in number else 0
            if u and u != t:
                touching.add((min(t, u), max(t, u)))
    same = [(t, u) for t, u in touching if refs[t][0] == refs[u][0] and _apart(refs[t][1][None], refs[u][1][None], l_weight)[0] <= most_de]
    i, j = (np.array([turns.index(p[k]) for p in same], int) for k in (0, 1))
    merged = _components(len(turns), i, j)
    return [(t, refs[t][0], *refs[t][1].tolist(), owner.count(t), turns[merged[n]]) for n, t in enumerate(turns)]


_GROWN = "region long, turn int, material string, lab_l double, lab_a double, lab_b double, cells long, merged int"


def grown(beads: DataFrame, keys: list[str], smallest: Column, cell: float, rounds: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], rule: Fill = Fill()) -> DataFrame:
    """Filled regions grown over a design's cells of ``cell`` mm, the one of most beads first: keys, region and what ``fill.grow`` returns.

    ``rounds`` does the same for larger designs, from beads and the results of ``fill.regions``.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        b = _Beads(pdf, keys)
        at, region, found = _regions(b, rule)
        found = found[found["verdict"] == "fill"].sort_values(["beads", "region"], ascending=[False, True])
        seeds, names = [], found["region"].tolist()
        if names:
            place, cells, lab, held = _picture(b, cell, rule.largest)
            seeds = [(n + 1, material, {place[k] for k in at[region == name]}) for n, (name, material) in enumerate(zip(names, found["material"]))]
        rows = _grow(cells, lab, held, seeds, rule.de, rule.l_weight) if seeds else []
        return pd.DataFrame([(names[r[0] - 1], *r) for r in rows], columns=[c.split()[0] for c in _GROWN.split(", ")])

    columns = [c.split()[0] for c in _GROWN.split(", ")]
    return by_group(_rows(beads, keys, smallest), keys, fold, _GROWN, lambda df: rounds(*_by_joins(df, keys, smallest, rule)).select(*keys, *columns))
