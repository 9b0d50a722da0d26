"""Labels on graphs: Potts energy and its minimisation, majority labels. A component is one group, so that order counts."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def energy(unary: DataFrame, edges: DataFrame, labels: DataFrame, strength: float) -> DataFrame:
    """Sum of unary costs (node, label, cost) and of weights of edges (a, b, weight) between unequal labels (node, label)."""
    own = unary.join(labels, ["node", "label"]).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("own"))
    of = lambda n: labels.select(F.col("node").alias(n), F.col("label").alias(f"{n}_label"))
    cut = edges.join(of("a"), "a").join(of("b"), "b").where("a_label <> b_label").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("cut"))
    return own.crossJoin(cut).select((F.col("own") + strength * F.col("cut")).alias("energy"))


def sweep(cost: np.ndarray, edges: list[tuple[int, int, float]], strength: float, sweeps: int = 8) -> np.ndarray:
    """Iterated conditional modes, nodes in order, each seeing the labels already changed."""
    near: list[list[tuple[int, float]]] = [[] for _ in range(len(cost))]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    label = cost.argmin(axis=1)
    for _ in range(sweeps):
        changed = False
        for i, around in enumerate(near):
            total = cost[i] + strength * sum(w for _, w in around)
            for j, w in around:
                total[label[j]] -= strength * w
            best = int(total.argmin())
            if total[best] < total[label[i]] - 1e-9:
                label[i], changed = best, True
        if not changed:
            break
    return label


def _cut(source: np.ndarray, sink: np.ndarray, edges: dict[tuple[int, int], float]) -> np.ndarray:
    """Nodes on the source's side of a minimum cut, by shortest augmenting paths."""
    n = len(source)
    s, t = n, n + 1
    cap: list[dict[int, float]] = [{} for _ in range(n + 2)]

    def link(a: int, b: int, w: float) -> None:
        cap[a][b] = cap[a].get(b, 0.0) + w
        cap[b].setdefault(a, 0.0)

    for i in range(n):
        link(s, i, source[i])
        link(i, t, sink[i])
    for (a, b), w in edges.items():
        link(a, b, w)
    while True:
        back, queue = {s: -1}, [s]
        for x in queue:
            for y, w in cap[x].items():
                if w > 1e-12 and y not in back:
                    back[y] = x
                    queue.append(y)
        if t not in back:
            return np.array([i in back for i in range(n)])
        path, y = [], t
        while back[y] >= 0:
            path.append((back[y], y))
            y = back[y]
        flow = min(cap[a][b] for a, b in path)
        for a, b in path:
            cap[a][b] -= flow
            cap[b][a] += flow


def expand(cost: np.ndarray, edges: list[tuple[int, int, float]], strength: float, cycles: int = 5) -> np.ndarray:
    """Alpha expansion: for each label in turn, the best set of nodes to take it, by a minimum cut."""
    label = cost.argmin(axis=1)
    value = lambda lab: cost[np.arange(len(lab)), lab].sum() + strength * sum(w for a, b, w in edges if lab[a] != lab[b])
    best = value(label)
    for _ in range(cycles):
        before = best
        for alpha in range(cost.shape[1]):
            keep, take = cost[np.arange(len(label)), label].copy(), cost[:, alpha].copy()
            pair: dict[tuple[int, int], float] = {}
            for a, b, w in edges:
                w *= strength
                both, first, second = w * (label[a] != label[b]), w * (label[a] != alpha), w * (label[b] != alpha)
                # both keep: both; only b takes: first; only a takes: second; both take: nothing
                take[a] += second - both
                take[b] -= second
                pair[(b, a)] = pair.get((b, a), 0.0) + first + second - both
            low = np.minimum(keep, take)
            # a node on the source's side takes alpha
            taken = _cut(keep - low, take - low, pair)
            new = np.where(taken, alpha, label)
            if (v := value(new)) < best - 1e-9:
                label, best = new, v
        if best >= before - 1e-9:
            break
    return label


def exhaustive(cost: np.ndarray, edges: list[tuple[int, int, float]], strength: float) -> float:
    """The least energy, by trying all labels; for tests."""
    n, k = cost.shape
    return min(sum(cost[i, x] for i, x in enumerate(lab)) + strength * sum(w for a, b, w in edges if lab[a] != lab[b]) for lab in product(range(k), repeat=n))


def solve(unary: DataFrame, edges: DataFrame, strength: float, method: str = "expand") -> DataFrame:
    """(component, node, label). ``unary``: component, node, label, cost; ``edges``: component, a, b, weight."""
    solver = {"expand": expand, "sweep": sweep}[method]
    costs = unary.groupBy("component").agg(F.collect_list(F.struct("node", "label", "cost")).alias("costs"))
    links = edges.groupBy("component").agg(F.collect_list(F.struct("a", "b", "weight")).alias("links"))

    def run(batches):
        for pdf in batches:
            out = []
            for comp, rows, around in zip(pdf["component"], pdf["costs"], pdf["links"]):
                nodes, labels = sorted({r["node"] for r in rows}), sorted({r["label"] for r in rows})
                at, of = {n: i for i, n in enumerate(nodes)}, {x: i for i, x in enumerate(labels)}
                cost = np.full((len(nodes), len(labels)), 1e9)
                for r in rows:
                    cost[at[r["node"]], of[r["label"]]] = r["cost"]
                found = solver(cost, [(at[e["a"]], at[e["b"]], e["weight"]) for e in (around if around is not None else [])], strength)
                out += [(comp, n, labels[found[i]]) for i, n in enumerate(nodes)]
            yield pd.DataFrame(out, columns=["component", "node", "label"])

    kinds = {c: unary.schema[c].dataType.simpleString() for c in ("component", "node", "label")}
    return costs.join(links, "component", "left").mapInPandas(run, ", ".join(f"{c} {k}" for c, k in kinds.items()))
