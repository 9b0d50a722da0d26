"""Nearest neighbours against a model, logistic regression, weighted k-means, rank statistics."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.operators import spatial


def neighbours(rows: DataFrame, model: DataFrame, distance: Column, k: int, id_col: str, order: str) -> DataFrame:
    """The k model rows nearest to each row, by (distance, order). The model is a dimension of bounded size."""
    pairs = rows.crossJoin(model).withColumn("distance", distance)
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy(id_col).orderBy("distance", order))).where(F.col("place") <= k)


def nearest_in_space(rows: DataFrame, model: DataFrame, distance: Column, axes: list[tuple[str, str]], k: int, id_col: str, order: str, first: float = 24.0) -> DataFrame:
    """The k model rows nearest to each row, by (distance, order), without meeting the whole model.

    ``axes`` names the columns of rows and of the model that span the space; ``distance``, the squared straight distance, follows
    from them and from what else rows of one ``id_col`` hold. Of model rows in one place, only the first k by ``order`` can be
    near. Rows and model meet by cells of a reach; a row with k model rows nearer than the reach is done, the others go on
    with twice the reach, until it spans the space. The first reach is at most ``first``, less where the model is dense: a
    ball of it would hold about k model rows if they were spread evenly.
    """
    places = [q for _, q in axes]
    model = model.withColumn("_nth", F.row_number().over(Window.partitionBy(*places).orderBy(order))).where(F.col("_nth") <= k).drop("_nth")
    model = spatial.stored(model, "model")
    span = model.agg(*(F.max(q) - F.min(q) for _, q in axes), F.count("*")).first()
    offs = rows.agg(*(F.max(p) for p, _ in axes), *(F.min(p) for p, _ in axes)).first()
    edges = model.agg(*(F.max(q) for _, q in axes), *(F.min(q) for _, q in axes)).first()
    n = len(axes)
    if span[0] is None or offs[0] is None:
        return rows.join(model, F.lit(False)).withColumns({"distance": distance, "place": F.lit(1)})
    whole = sum(max(offs[i] - edges[n + i], edges[i] - offs[n + i], span[i]) ** 2 for i in range(n)) ** 0.5 + 1.0
    wide = [x for x in span[:n] if x > 0]
    if wide:
        ball = math.pi ** (len(wide) / 2) / math.gamma(len(wide) / 2 + 1)
        first = min(first, max((math.prod(wide) * k / span[n] / ball) ** (1 / len(wide)), whole / 1024))
    rest, reach, found = spatial.stored(rows, "rows"), first, []
    while True:
        cell = [f"_c{i}" for i in range(n)]
        spots = rest.withColumns({c: F.floor(F.col(p) / reach) for c, (p, _) in zip(cell, axes)})
        for c in cell:
            spots = spots.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
        held = model.withColumns({c: F.floor(F.col(q) / reach) for c, (_, q) in zip(cell, axes)})
        last = reach >= whole
        # 3 ** n cells a row, which no estimate sees
        near = spots.hint("merge").join(held, cell).drop(*cell).withColumn("distance", distance)
        near = near if last else near.where(F.col("distance") < reach * reach)
        near = near.withColumn("place", F.row_number().over(Window.partitionBy(id_col).orderBy("distance", order))).where(F.col("place") <= k)
        near = spatial.stored(near.withColumn("_most", F.max("place").over(Window.partitionBy(id_col))), "near")
        done = near if last else near.where(F.col("_most") == k)
        found.append(done.drop("_most"))
        if last:
            break
        rest = spatial.stored(rest.join(done.select(id_col).distinct(), id_col, "left_anti"), "rest")
        if rest.isEmpty():
            break
        reach *= 2
    return reduce(DataFrame.unionByName, found)


def closeness(distance: Column) -> Column:
    return 1.0 / (F.sqrt(distance) + 1.0)


def rank_auc(rows: DataFrame, score: str, label: str, order: str, keys: list[str]) -> DataFrame:
    """Area under the curve by rank sums; ties keep the order of ``order`` and are not averaged."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(score, order)))
    one = F.col(label) == 1
    sums = ranked.groupBy(*keys).agg(F.sum(F.when(one, F.col("_rank"))).alias("s"), F.count_if(one).alias("pos"), F.count_if(~one).alias("neg"))
    return sums.select(*keys, "pos", "neg", F.when((F.col("pos") > 0) & (F.col("neg") > 0), (F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))).alias("auc"))


def overlap_scores(rows: DataFrame, a: Column, b: Column, keys: list[str]) -> DataFrame:
    """Intersection over union, precision of a against b, and recall."""
    n = rows.groupBy(*keys).agg(F.count_if(a & b).alias("both"), F.count_if(a).alias("a"), F.count_if(b).alias("b"))
    share = lambda x, y: F.when(y > 0, x / y)
    both = F.col("both")
    return n.select(*keys, "both", share(both, F.col("a") + F.col("b") - both).alias("iou"), share(both, F.col("a")).alias("precision"), share(both, F.col("b")).alias("recall"))


def logistic(rows: DataFrame, features: list[str], label: str, steps: int = 100, rate: float = 0.5) -> tuple[list[float], list[tuple[float, float]]]:
    """Full-batch gradient descent on z-scores; a step is one aggregate of p + 1 sums. Weights (bias last) and (mean, sd)."""
    stats = rows.agg(F.count("*"), *(f(c) for c in features for f in (F.avg, F.stddev_pop))).first()
    n, scale = stats[0], [(stats[1 + 2 * i] or 0.0, stats[2 + 2 * i] or 1.0) for i in range(len(features))]
    scaled = rows.select(*(((F.col(c) - m) / s).alias(f"z{i}") for i, (c, (m, s)) in enumerate(zip(features, scale))), F.col(label).cast("double").alias("y")).cache()
    w = [0.0] * (len(features) + 1)
    for _ in range(steps if n else 0):
        z = sum((F.col(f"z{i}") * w[i] for i in range(len(features))), F.lit(w[-1]))
        error = 1 / (1 + F.exp(-z)) - F.col("y")
        got = scaled.agg(*(F.sum(error * F.col(f"z{i}")) for i in range(len(features))), F.sum(error)).first()
        w = [a - rate * g / n for a, g in zip(w, got)]
    scaled.unpersist()
    return w, scale


def kmeans(rows: DataFrame, features: list[str], weight: str, k: int, steps: int = 20) -> list[list[float]]:
    """Weighted k-means from farthest-point seeds; a round is one aggregate of k x p sums."""
    rows = rows.select(*features, weight).cache()

    def apart(centres: list[list[float]]) -> list[Column]:
        return [sum(((F.col(f) - float(v)) * (F.col(f) - float(v)) for f, v in zip(features[1:], c[1:])), (F.col(features[0]) - float(c[0])) * (F.col(features[0]) - float(c[0]))) for c in centres]

    first = rows.orderBy(F.desc(weight), *features).limit(1).collect()
    centres = [[float(r[f]) for f in features] for r in first]
    while centres and len(centres) < k:
        far = F.least(*apart(centres), F.lit(float("inf"))) * F.col(weight)
        r = rows.orderBy(F.desc(far), *features).limit(1).collect()[0]
        centres.append([float(r[f]) for f in features])
    for _ in range(steps if centres else 0):
        d = apart(centres)
        nearest = F.array_position(F.array(*d), F.array_min(F.array(*d)))
        got = rows.groupBy(nearest.alias("c")).agg(F.sum(weight).alias("w"), *(F.sum(F.col(f) * F.col(weight)).alias(f"s_{f}") for f in features)).collect()
        new = [list(c) for c in centres]
        for r in got:
            new[r["c"] - 1] = [r[f"s_{f}"] / r["w"] for f in features]
        if np.allclose(new, centres, rtol=0, atol=1e-9):
            break
        centres = new
    rows.unpersist()
    return centres


def assignment(cost: np.ndarray) -> list[int]:
    """Least-cost one-to-one assignment of rows to columns (rows <= columns), by shortest augmenting paths."""
    cost = np.asarray(cost, float)
    n, m = cost.shape
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, back, done = cost[row] - u[row] - v, np.full(m, row), np.zeros(m, bool)
        source = np.full(m, -1)
        while True:
            j = int(np.where(done, np.inf, dist).argmin())
            done[j] = True
            if match[j] < 0:
                break
            i, base = match[j], dist[j]
            through = base + cost[i] - u[i] - v
            better = ~done & (through < dist)
            dist[better], source[better], back[better] = through[better], j, i
        end = dist[j]
        seen = done & (dist < end)
        u[row] += end
        for c in np.flatnonzero(seen):
            u[match[c]] += end - dist[c]
            v[c] -= end - dist[c]
        while True:
            match[j] = back[j]
            if source[j] < 0:
                break
            j = source[j]
    out = [-1] * n
    for j, i in enumerate(match):
        if i >= 0:
            out[i] = j
    return out
