"""Laying layers over each other: collisions between layers, shared codes.

Which stone gives way depends on the order of all before it, but only on those it clashes with, directly or by others: the
fold runs per design; in designs too large for one task per component of the clash graph, components in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.operators import passes, spatial


def fold(rows: list[tuple], clashes: dict) -> dict:
    """What becomes of stones (id, layer_rank, locked), higher layers first, then by id.

    A stone that clashes with nothing kept stays; an unlocked one that does goes; a locked one stays and removes the unlocked
    stones that it clashes with. Returns id -> 'kept', 'collided' or 'removed'.
    """
    state: dict = {}
    for i, _, locked in sorted(rows, key=lambda r: (-r[1], r[0])):
        hits = [j for j in clashes.get(i, ()) if state.get(j) == "kept"]
        if hits and not locked:
            state[i] = "collided"
            continue
        for j in hits:
            if not clashes["locked"][j]:
                state[j] = "removed"
        state[i] = "kept"
    return state


def layered(stones: DataFrame, clearance: float = 0.0, key: str = "design_id") -> DataFrame:
    """Adds ``fate`` to stones (design_id, stone_id, layer_rank, x_mm, y_mm, phys_mm, locked)."""
    kinds = {c: stones.schema[c].dataType.simpleString() for c in ("stone_id", *(c for c in stones.columns if c not in (key, "stone_id")))}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, size, rank = (pdf[c].to_numpy(float) for c in ("x_mm", "y_mm", "phys_mm", "layer_rank"))
        ids, locked = pdf["stone_id"].tolist(), pdf["locked"].fillna(False).astype(bool).tolist()
        i, j, _ = passes.near_pairs(x, y, size, clearance)
        clash = abs(rank[i] - rank[j]) > 0
        near: dict = {"locked": dict(zip(ids, locked))}
        for a, b in zip(i[clash].tolist(), j[clash].tolist()):
            near.setdefault(ids[a], []).append(ids[b])
            near.setdefault(ids[b], []).append(ids[a])
        fates = fold([(n, r, own) for n, r, own in zip(ids, rank.tolist(), locked) if n in near], near)
        return pdf[list(kinds)].assign(fate=[fates.get(n, "kept") for n in ids])

    columns = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", fate string"
    found = passes.by_group(stones, [key], one, columns, lambda df: by_components(df, clearance, key).select(key, *kinds, "fate"))
    # what belongs to no design clashes with nothing
    return found.unionByName(stones.where(F.col(key).isNull()).select(key, *kinds, F.lit("kept").alias("fate")))


def by_components(stones: DataFrame, clearance: float = 0.0, key: str = "design_id") -> DataFrame:
    """``layered`` with a fold per component of the clash graph."""
    pairs = spatial.close_pairs(stones.select(key, "stone_id", "x_mm", "y_mm", "phys_mm", "layer_rank"), clearance, [key])
    clash = pairs.where(F.col("a_layer_rank") != F.col("b_layer_rank")).select(key, F.col("a_stone_id").alias("a"), F.col("b_stone_id").alias("b"))
    nodes = clash.select(key, F.col("a").alias("node")).union(clash.select(key, F.col("b").alias("node"))).distinct()
    comp = spatial.components(nodes, clash, [key])
    members = stones.select(key, F.col("stone_id").alias("node"), "layer_rank", "locked").join(comp, [key, "node"]).groupBy(key, "component").agg(F.collect_list(F.struct("node", "layer_rank", "locked")).alias("stones"))
    edges = clash.join(comp.withColumnRenamed("node", "a"), [key, "a"]).groupBy(key, "component").agg(F.collect_list(F.struct("a", "b")).alias("clashes"))

    def run(batches):
        for pdf in batches:
            out = []
            for d, rows, pairs in zip(pdf[key], pdf["stones"], pdf["clashes"]):
                near: dict = {"locked": {r["node"]: bool(r["locked"]) for r in rows}}
                for p in pairs:
                    near.setdefault(p["a"], []).append(p["b"])
                    near.setdefault(p["b"], []).append(p["a"])
                out += [(d, i, fate) for i, fate in fold([(r["node"], r["layer_rank"], bool(r["locked"])) for r in rows], near).items()]
            yield pd.DataFrame(out, columns=[key, "stone_id", "fate"])

    kind = stones.schema[key].dataType.simpleString()
    fates = members.join(edges, [key, "component"]).mapInPandas(run, f"{key} {kind}, stone_id long, fate string")
    return stones.join(fates, [key, "stone_id"], "left").withColumn("fate", F.coalesce("fate", F.lit("kept")))


def shared_codes(codes: DataFrame, pool: DataFrame, most: float = 12.0) -> DataFrame:
    """For codes not in the pool, the pool's nearest code of equal shape, size and kind, if it differs by ``most`` or less.

    Both have code_id, shape, size_class, kind; ``codes`` also p_l, p_a, p_b, ``pool`` q_l, q_a, q_b.
    """
    from lapidary.functions import color

    same = ["shape", "size_class", "kind"]
    pairs = codes.join(pool.withColumnRenamed("code_id", "to_code"), same)
    rows = color.add(pairs, color.de2000_steps("p", "q"), ["de"])
    best = rows.groupBy("code_id").agg(F.min(F.struct("de", "to_code")).alias("m"), F.max((F.col("to_code") == F.col("code_id")).cast("int")).alias("own"))
    return best.select("code_id", F.when((F.col("own") == 0) & (F.col("m.de") <= most), F.col("m.to_code")).otherwise(F.col("code_id")).alias("to_code"), F.when(F.col("own") == 0, F.col("m.de")).otherwise(F.lit(0.0)).alias("de"))
