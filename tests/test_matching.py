"""Matching, nearest neighbours in space, symbol maps and checks against brute force."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapidary import plans
from lapidary.operators import design, learn, matching, qc, spatial
from lapidary.sources import kit, markup


def test_greedy_is_the_sequential_rule(spark):
    r = random.Random(1)
    rows = [(g, r.randrange(30), r.randrange(30), r.choice([1.0, 2.0, r.random() * 9])) for g in (1, 2, None) for _ in range(200)]
    rows = list({x[:3]: x for x in rows}.values())
    got = matching.greedy(spark.createDataFrame(rows, "g long, a long, b long, d double").withColumn("g", F.coalesce("g", F.lit(-1))), ["g"], "a", "b", "d").collect()
    want, used = set(), set()
    for g, a, b, d in sorted(rows, key=lambda x: (x[3], x[1], x[2])):
        if (g, "a", a) not in used and (g, "b", b) not in used:
            used |= {(g, "a", a), (g, "b", b)}
            want.add((-1 if g is None else g, a, b))
    assert {(x["g"], x["a"], x["b"]) for x in got} == want and len(got) == len(want)
    none = spark.createDataFrame([], "g long, a long, b long, d double")
    assert matching.greedy(none, ["g"], "a", "b", "d").count() == 0


def test_greedy_chain(spark):
    """Each pair is cheaper than the one before, so that only one can be taken in the first rounds."""
    rows = [(1, i // 2 + i % 2, i // 2, 100.0 - i) for i in range(20)]
    got = matching.greedy(spark.createDataFrame(rows, "g long, a long, b long, d double"), ["g"], "a", "b", "d").collect()
    assert sorted((x["a"], x["b"]) for x in got) == [(i // 2 + i % 2, i // 2) for i in range(20) if i % 2]


def test_nearest_in_space(spark):
    r = random.Random(2)
    point = lambda: tuple(float(r.randrange(200)) for _ in range(3))
    asked, model = [(i, *point()) for i in range(40)] + [(99, 900.0, 0.0, 0.0)], [(i, *point()) for i in range(150)]
    p, q = spark.createDataFrame(asked, "i long, px double, py double, pz double"), spark.createDataFrame(model, "j long, qx double, qy double, qz double")
    d = sum(((F.col(f"p{x}") - F.col(f"q{x}")) * (F.col(f"p{x}") - F.col(f"q{x}")) for x in "yz"), (F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")))
    axes = [(f"p{x}", f"q{x}") for x in "xyz"]
    got = {}
    for x in learn.nearest_in_space(p, q, d, axes, 5, "i", "j", first=8.0).collect():
        got.setdefault(x["i"], []).append((x["place"], x["j"]))
    for i, *at in asked:
        near = sorted((sum((a - b) ** 2 for a, b in zip(at, m)), j) for j, *m in model)[:5]
        assert [j for _, j in sorted(got[i])] == [j for _, j in near]
    assert learn.nearest_in_space(p, q.limit(3), d, axes, 5, "i", "j").count() == 3 * len(asked)
    assert learn.nearest_in_space(p, q.limit(0), d, axes, 5, "i", "j").count() == 0 and learn.nearest_in_space(p.limit(0), q, d, axes, 5, "i", "j").count() == 0


def test_components_of_a_long_path(spark):
    """A randomly numbered path needs many rounds; it is one component all the same."""
    r = random.Random(3)
    names = list(range(1000))
    r.shuffle(names)
    edges = spark.createDataFrame([(1, a, b) for a, b in zip(names, names[1:])], "g long, a long, b long").coalesce(1)
    nodes = spark.createDataFrame([(1, n) for n in names] + [(1, 5000)], "g long, node long").coalesce(1)
    got = {x["node"]: x["component"] for x in spatial.components(nodes, edges, ["g"]).collect()}
    assert set(got[n] for n in names) == {0} and got[5000] == 5000


def test_kit_reader(spark):
    stone = lambda i, symbol="A", said=None, shape="round", at=100.0, group="K_S1_S2.8": (
        f'<g transform="matrix(11.81 0 -0 11.81 {at} 50)"><ellipse cx="0" cy="0" rx="1.4" fill="#AABBCC" data-position-id="{i}" data-symbol="{symbol}" data-stone-code="S1" data-shape="{shape}" '
        f'data-center-x-source-px="100" data-center-y-source-px="50" data-width-mm="2.8" data-height-mm="2.8" data-group="{group}"/><ellipse rx="1.2" fill="#AABBCC" /></g>\n<text data-position-id="{i}">{said or symbol}</text>'
    )
    page = '<svg viewBox="0 0 3543 3543">' + stone("P0") + '<g data-layer="bg">' + stone("P1") + stone("P2", said="B") + '</g><g data-layer="pet">' + stone("P3", shape="heart") + stone("P4", at=101.0) + stone("P5", group="K_S1_S4x9") + stone("P6", group="odd") + "</g></svg>"
    files = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<svg/>")], "f long, svg string")
    got = [(x["id"], x["layer"], x["fault"], x["size_mm"]) for x in kit.read(files, ["f"]).orderBy("f", "place").collect()]
    assert got == [("P0", None, None, 2.8), ("P1", "bg", None, 2.8), ("P2", "bg", "text_differs", 2.8), ("P3", "pet", "not_round", 2.8), ("P4", "pet", "off_centre", 2.8), ("P5", "pet", None, 6.0), ("P6", "pet", None, None)]
    faults = {x["f"]: x["fault"] for x in kit.file_faults(files, ["f"]).collect()}
    assert faults == {3: "canvas", 4: "canvas"}
    odd = stone("Q1", said="B", shape="heart", at=103.0) + '<ellipse data-position-id="Q2" rx="x"/>' + stone("Q3").replace("11.81 0 -0 11.81", "2 0 0 2")
    files = spark.createDataFrame([(1, f'<svg viewBox="0 0 3543 3543">{odd}</svg>')], "f long, svg string")
    assert {x["id"]: x["faults"] for x in kit.read(files, ["f"]).collect()} == {"Q1": ["not_round", "off_centre", "text_differs"], "Q2": ["no_group", "no_text", "not_round", "odd_scale"], "Q3": ["odd_scale"]}
    assert [x["fault"] for x in kit.file_faults(files, ["f"]).collect()] == ["unread_stones"]


def test_nested_groups(spark):
    """Transforms of all groups around a stone apply, outermost first; against matrices multiplied by numpy."""
    r = random.Random(3)
    want, names = {}, iter(range(1000))

    def turn(kind):
        if kind == 0:
            x, y = r.uniform(-9, 9), r.uniform(-9, 9)
            return f"translate({x},{y})", np.array([[1, 0, x], [0, 1, y], [0, 0, 1]])
        if kind == 1:
            a, x, y = r.uniform(-90, 90), r.uniform(0, 9), r.uniform(0, 9)
            c, s = math.cos(math.radians(a)), math.sin(math.radians(a))
            move = lambda p, q: np.array([[1, 0, p], [0, 1, q], [0, 0, 1]])
            return f"rotate({a} {x} {y})", move(x, y) @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) @ move(-x, -y)
        if kind == 2:
            k = r.uniform(0.5, 2)
            return f"scale({k})", np.diag([k, k, 1])
        v = [r.uniform(0.5, 1), r.uniform(-0.5, 0.5), r.uniform(-0.5, 0.5), r.uniform(0.5, 1), r.uniform(-5, 5), r.uniform(-5, 5)]
        return "matrix(" + " ".join(map(str, v)) + ")", np.array([[v[0], v[2], v[4]], [v[1], v[3], v[5]], [0, 0, 1]])

    def inside(depth, m, layer):
        out = ""
        for _ in range(r.choice([1, 2, 3])):
            text, n = turn(r.randrange(4))
            pair = r.random() < 0.3
            if pair:
                more, n2 = turn(r.randrange(4))
                text, n = f"{text} {more}", n @ n2
            if depth == 0 or r.random() < 0.3:
                i = f"s{next(names)}"
                want[i] = (layer, m @ n)
                end = "/>" if r.random() < 0.3 else "><circle r='1'/></g>"
                out += f'<g data-id="{i}" data-code="A&amp;B" data-phys="4" data-locked="true" transform="{text}"{end}\n<g class="empty"/>'
            else:
                named = r.random() < 0.3
                out += f'<g class="c"{f" data-layer=\"in{depth}\"" if named else ""} transform="{text}">{inside(depth - 1, m @ n, layer or (f"in{depth}" if named else None))}</g>'
        return out

    page = "<svg>" + "".join(f'<g data-layer="l{k}"><!-- x -->{inside(4, np.eye(3), f"l{k}")}</g>' for k in range(4)) + inside(3, np.eye(3), None) + "</svg>"
    files = spark.createDataFrame([(1, page), (2, '<svg><g data-layer="a"><g data-id="z"></g></svg>'), (3, None), (4, "")], "f long, svg string")
    got = markup.read_groups(files, ["f"]).orderBy("f", "place").collect()
    assert [x["id"] for x in got if x["f"] == 1] == sorted(want, key=lambda i: int(i[1:])) and len(want) > 20
    assert {x["level"] for x in got} >= {3, 4, 5}
    for x in got:
        if x["f"] == 1:
            layer, m = want[x["id"]]
            assert x["layer"] == layer and x["fault"] == (None if layer else "outside_layer") and x["code"] == "A&B" and x["locked"] and x["phys_mm"] == 4
            assert abs(x["x_mm"] - m[0, 2]) < 2e-6 and abs(x["y_mm"] - m[1, 2]) < 2e-6 and abs(x["rot_deg"] - math.degrees(math.atan2(m[1, 0], m[0, 0]))) < 1e-5
    assert [(x["id"], x["fault"]) for x in got if x["f"] == 2] == [("z", "broken_file")]


def test_a_failing_check_is_a_finding(spark):
    stones = spark.createDataFrame([(1, 1, "bg", 0, 5, 10.0, 10.0, 2.8)], "design_id long, stone_id long, layer string, layer_rank int, code_id long, x_mm double, y_mm double, phys_mm double")
    qc.register("broken")(lambda stones, context: stones.select("no such column"))
    try:
        rows = {x["check_id"]: x for x in qc.run(stones, {"width": 300.0, "height": 300.0}).collect()}
    finally:
        qc.unregister("broken")
    assert rows["broken"]["level"] == "error" and "failed" in rows["broken"]["message"]
    assert rows["catalog"]["level"] == "error"  # no catalogue in the context
    assert rows["holes"]["level"] == "info" and rows["delta-e"]["level"] == "info" and rows["code-count"]["level"] == "pass"
    assert [x["check_id"] for x in qc.run(stones, {}, ["gap", "code-count"]).collect()] == ["code-count"]
    assert qc.worst(qc.run(stones, {"width": 300.0, "height": 300.0})).first()["status"] == "error"
    assert "broken" not in qc.CHECKS and design.code_count(stones).count() == 1


def test_scores(spark):
    m = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 2, 2)], "g long, p long, t long")
    rows = spark.createDataFrame([(1,)] * 6 + [(2,)], "g long")
    got = {x["g"]: x for x in matching.scores(m, rows, rows.where("g = 1"), ["g"], {"same": F.col("p") == F.col("t")}).collect()}
    assert (got[1]["precision"], got[1]["recall"], got[1]["f1"], got[1]["same"]) == (50.0, 50.0, 50.0, 66.7)
    assert got[2]["truth"] == 0 and got[2]["recall"] is None and got[2]["precision"] == 0.0
    assert matching.majority(m, ["g"], "p", "t").first()["majority"] == 2
    assert math.isclose(matching.commonest(m, ["g"], "t", "p").first()["share"], 2 / 3)


@pytest.mark.parametrize("rows", [[], [(1, 5.0, 5.0, 2.8)]])
def test_free_probes(spark, rows):
    stones = spark.createDataFrame(rows, "design_id long, x_mm double, y_mm double, phys_mm double")
    cells = spark.createDataFrame([(1, 0, 0)], "design_id long, px long, py long")
    got = {(x["i"], x["j"]) for x in qc.free_probes(stones, cells, {"width": 20.0, "height": 20.0, "pixels": 2}).collect()}
    want = {(i, j) for i in range(10) for j in range(10) if all(1.4 <= v + 0.5 <= 18.6 for v in (i, j)) and not (rows and math.hypot(i + 0.5 - 5, j + 0.5 - 5) - 1.4 <= 1.55)}
    assert got == want


def test_nearest_in_space_of_crowded_places(spark):
    # of 300 model rows in one place only the first five can be near
    p = spark.range(6).selectExpr("id AS i", "CAST(id * 7 % 40 AS DOUBLE) AS px", "CAST(id * 3 AS DOUBLE) AS py")
    q = spark.range(6000).selectExpr("id AS j", "CAST(id % 20 * 2 AS DOUBLE) AS qx", "0.0D AS qy")
    d = (F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")) + (F.col("py") - F.col("qy")) * (F.col("py") - F.col("qy"))
    stored, kept = learn.spatial.stored, {}
    learn.spatial.stored = lambda df, name: kept.setdefault(name, stored(df, name)) if name == "model" else stored(df, name)
    try:
        rows = learn.nearest_in_space(p, q, d, [("px", "qx"), ("py", "qy")], 5, "i", "j").collect()
    finally:
        learn.spatial.stored = stored
    assert kept["model"].count() == 20 * 5
    for a in p.collect():
        want = sorted(((a.px - j % 20 * 2) ** 2 + a.py**2, j) for j in range(6000))[:5]
        assert [r.j for r in sorted((r for r in rows if r.i == a.i), key=lambda r: r.place)] == [j for _, j in want]


def test_transform_is_read_once(spark):
    # named again in each of a product's twelve places, a call would be read as often
    plan = spark.createDataFrame([("scale(2)",)], "t string").select(markup.parse_transform(F.col("t")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2 and plan.count("regexp_extract(") == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", ["symbol_map_read", "symbol_map_faults"])
def test_no_text_of_a_map_is_dealt_or_sorted(spark, name):
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not [line for line in dealt if "layer" in line] and "values" not in "".join(line for line in plan.splitlines() if "Window" in line)
    assert not [line for line in plan.splitlines() if "Window [" in line and "lag(" in line]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", ["neighbour_stats", "over_background", "keep_out"])
def test_pairs_are_joined_once(spark, name):
    # each read of the pairs would join and deal them anew
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Join Inner" in line and "_cx" in line]) == 1


def test_greedy_deals_a_round_three_times(spark, monkeypatch):
    rounds, stored = [], spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda df, name: rounds.append(df) or stored(df, name))
    pairs = spark.createDataFrame([(1, 1, 1, 1.0), (1, 1, 2, 2.0), (1, 2, 1, 3.0)], "g long, a long, b long, d double")
    assert [(r["a"], r["b"]) for r in matching.greedy(pairs, ["g"], "a", "b", "d").collect()] == [(1, 1)]
    assert [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in rounds] == [3]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", ["audit_totals", "fill_stats", "qc_report"])
def test_stones_are_numbered_once(spark, name):
    # what stays of the plan reads tables that were written; each view of the stones would number them anew
    assert "row_number" not in plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
