"""Checks in full: what fails while it runs, versions, passes, the first stones of a finding."""

from pyspark.sql import functions as F

from lapidary.operators import qc

STONES = "design_id long, stone_id long, layer string, in_layer string, code_id long, shape string, phys_mm double, ref_mm double"


def test_a_check_that_fails_when_run_is_a_finding(spark):
    stones = spark.createDataFrame([(1, 1), (2, 1)], "design_id long, stone_id long")
    qc.register("breaks")(lambda s, c: s.select("design_id", F.raise_error(F.lit("no")).cast("string").alias("level"), F.lit("m").alias("message"), F.lit(1).cast("long").alias("n")))
    try:
        found = qc.run(stones, {}, ["breaks"]).collect()
    finally:
        qc.unregister("breaks")
    assert sorted(r["design_id"] for r in found) == [1, 2] and {r["level"] for r in found} == {"error"}


def test_entries_versions_and_passes(spark):
    rows = [(1, i, "bg", "bg", 10, "round", 4.0, 3.5) for i in range(60)] + [(2, 1, "bg", "bg", 10, "heart", 4.0, 3.5), (2, 2, "bg", "bg", 11, "round", 5.0, 9.0), (2, 3, "bg", "bg", 99, "round", 5.0, 4.0)]
    rows += [(3, 1, "bg", "bg", 12, "heart", 8.0, 6.0)] + [(4, i, "bg", "bg", 12, "heart", 6.0, 7.0) for i in range(70)]
    stones = spark.createDataFrame(rows, STONES)
    catalog = spark.createDataFrame([(10, True, "round", 4.0, 3.0), (11, False, "round", 5.0, 4.0), (12, True, "heart", 4.0, 3.0)], "code_id long, active boolean, shape string, phys_mm double, ref_mm double")
    sizes = spark.createDataFrame([(4.0, 3.5), (5.0, 4.5)], "phys_mm double, ref_mm double")
    got = {(r["design_id"], r["code_id"], r["fault"]): (r["n"], r["ids"]) for r in qc.entry_faults(stones, catalog, sizes).collect()}
    # a heart of twice its entry's size is drawn twice as large
    assert got == {(2, 10, "shape"): (1, [1]), (2, 11, "inactive"): (1, [2]), (2, 11, "drawn size"): (1, [2]), (2, 99, "unknown"): (1, [3]), (3, 12, "size"): (1, [1]), (4, 12, "size"): (70, list(range(50))), (4, 12, "drawn size"): (70, list(range(50)))}
    pinned = spark.createDataFrame([(1, "b"), (3, "a"), (2, None)], "design_id long, version string")
    found = [tuple(r) for r in qc.run(stones, {"by_code": True, "catalog": catalog, "size_map": sizes, "pinned": pinned, "version": "b"}, ["catalog"]).select("design_id", "level", "message", "n").collect()]
    assert (1, "pass", "all codes as in the catalogue", 1) in found and (3, "warn", "another version of the catalogue", 1) in found and (2, "warn", "another version of the catalogue", 1) in found
    assert (4, "error", "code 12 size 6.0", 70) in found and len(found) == 10


def test_layers_against_bills(spark):
    rows = [(1, 1, "bg", "bg", 10, "round", 4.0, 3.5), (1, 2, "bg", "pet", 11, "round", 4.0, 3.5), (2, 1, "bg", "bg", 10, "round", 4.0, 3.5), (3, 1, "bg", "bg", 10, "round", 4.0, 3.5)]
    bill = spark.createDataFrame([(1, 10, 1), (1, 12, 3), (2, 10, 1), (5, 10, 2)], "design_id long, code_id long, expected long")
    found = sorted(tuple(r) for r in qc.run(spark.createDataFrame(rows, STONES), {"by_code": True, "expected": bill}, ["layer-total"]).select("design_id", "level", "message", "n").collect())
    assert found == [
        (1, "error", "code 11 differs from the bill", 1), (1, "error", "code 12 differs from the bill", -3), (1, "error", "stones name another layer", 1), (1, "error", "total differs from the bill", -2),
        (2, "pass", "layers, total and codes as in the bill", 1), (3, "info", "no bill to compare with", 1), (5, "error", "code 10 differs from the bill", -2), (5, "error", "total differs from the bill", -2),
    ]
