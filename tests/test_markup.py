"""Files read where they are: attributes against the pattern of one, and plans that read a file once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lapidary.plans import imports
from lapidary.sources import kit, markup

SF = "/root/testdata/sf0.001"


def plan(name, spark):
    return imports.query.queries[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_attributes_are_the_pattern():
    r = random.Random(1)
    pieces = ['a="1"', "b='2'", " ", "=", '"', "x", 'data-k = "v"', "\t", 'c=""', 'a="2"', "/", 'é="q"', ':z="w"', "\n"]
    for _ in range(20000):
        tag = "<e " + "".join(r.choice(pieces) for _ in range(r.randrange(9))) + '>text u="1"'
        want = {}
        for name, value in re.findall(r'([\w:-]+)\s*=\s*"([^"]*)"', tag.partition(">")[0], re.ASCII):
            want.setdefault(name, value)
        assert markup.attribute_map(tag) == want, tag
    assert markup.attribute_map('</e a="1">') == {}


def test_map_read_sorts_no_tags(spark):
    # one window numbers the stones, none sorts what was read
    assert len(re.findall(r"\bWindow \[", plan("symbol_map_read", spark))) == 1


def test_map_faults_read_files_once(spark):
    assert plan("symbol_map_faults", spark).count("l_suppkey") > 0 and len(re.findall(r"\bWindow \[", plan("symbol_map_faults", spark))) == 1


def test_many_files_in_one_batch(spark):
    page = '<svg viewBox="0 0 3543 3543"><g data-layer="{}"><g><ellipse data-position-id="{}"/></g></g></svg>'
    files = [(i, i % 3 and page.format("bg" if i % 2 else "pet", i)) for i in range(200)]
    files = spark.createDataFrame([(i, t or None) for i, t in files], "f long, svg string").coalesce(1)
    got = {(r["f"], r["id"], r["layer"]) for r in kit.read(files, ["f"]).collect()}
    assert got == {(i, str(i), "bg" if i % 2 else "pet") for i in range(200) if i % 3}
    assert {r["f"] for r in kit.file_faults(files, ["f"]).where("fault = 'unread_stones'").collect()} == {i for i in range(200) if i % 3}


def test_transforms_are_the_column(spark):
    texts = ["", "translate(1 2) rotate(30)", "rotate(-45.5 3,4) scale(2)", "scale(1.5 -2)translate(5)", "matrix(1 2 3 4 5 6) matrix(.5 0 0 -.5 1e2 -3E-1)", "skewX(3) translate (7,8)", "rotate(.)", "scale()"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", markup.parse_transform(F.col("t")).alias("m")).orderBy("i").collect()
    for row, text in zip(found, [*texts, None]):
        assert markup.transform_matrix(text) == pytest.approx(row["m"], abs=1e-12), text


def test_groups_of_odd_files(spark):
    pages = {1: '<g data-layer="a"><g data-id="x"/></g></g><g data-id="y"></g>', 2: '<g data-layer="&lt;"><gg data-id="n"/><g transform="matrix(1 2)"><g data-id="z"></g></g></g>', 3: '<g/><g data-id="w" data-phys="2"/>', 4: "<svg/>", 5: None}
    files = spark.createDataFrame(list(pages.items()), "f long, svg string")
    got = [(r["f"], r["id"], r["level"], r["layer"], r["x_mm"], r["fault"]) for r in markup.read_groups(files, ["f"]).orderBy("f", "place").collect()]
    assert got == [(1, "x", 2, "a", 0.0, "broken_file"), (1, "y", 0, None, 0.0, "broken_file"), (2, "z", 3, "<", None, None), (3, "w", 1, None, 0.0, "outside_layer")]


def test_nested_svg_sorts_no_groups(spark):
    assert len(re.findall(r"\bWindow \[", plan("nested_svg", spark))) == 1
