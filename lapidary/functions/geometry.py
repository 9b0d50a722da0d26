"""Polygons and run lengths as expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(polygon: Column) -> Column:
    """(point, next point) of an array of structs (x, y)."""
    return F.transform(polygon, lambda p, i: F.struct(p.alias("p"), F.get(polygon, F.pmod(i + 1, F.size(polygon))).alias("q")))


def area(polygon: Column) -> Column:
    """By the shoelace formula."""
    return F.abs(F.aggregate(_edges(polygon), F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2


def inside(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd rule."""
    cross = F.filter(
        _edges(polygon),
        lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / F.nullif(e["q"]["y"] - e["p"]["y"], F.lit(0.0)) + e["p"]["x"]),
    )
    return F.size(cross) % 2 == 1


def inside_region(x: Column, y: Column, polygon: Column, holes: Column) -> Column:
    return inside(x, y, polygon) & ~F.exists(F.coalesce(holes, F.array().cast("array<array<struct<x:double,y:double>>>")), lambda h: inside(x, y, h))


def region_area(polygon: Column, holes: Column) -> Column:
    return area(polygon) - F.aggregate(F.transform(F.coalesce(holes, F.array().cast("array<array<struct<x:double,y:double>>>")), area), F.lit(0.0), lambda s, a: s + a)


def decode_runs(runs: Column) -> Column:
    """Alternating run lengths, zeros first, to an array of 0 and 1."""
    return F.flatten(F.transform(runs, lambda n, i: F.array_repeat(F.pmod(i, F.lit(2)), n)))


def encode_runs(bits: Column) -> Column:
    """The run lengths of an array of 0 and 1; the first may be 0."""
    start = F.struct(F.lit(0).alias("last"), F.array(F.lit(0)).alias("runs"))
    longer = lambda runs: F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.element_at(runs, -1) + 1))
    step = lambda acc, b: F.struct(b.cast("int").alias("last"), F.when(b.cast("int") == acc["last"], longer(acc["runs"])).otherwise(F.concat(acc["runs"], F.array(F.lit(1)))).alias("runs"))
    return F.aggregate(bits, start, step)["runs"]


def natural_key(text: Column) -> Column:
    """Sorts as people do: digits by value."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "\0")
