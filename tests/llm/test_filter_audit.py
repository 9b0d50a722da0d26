"""The filter audit against a loop over documents and orders."""

import collections
import itertools
import random
import re

from pyspark.sql import functions as F

from lapidary.llm import filteraudit


def test_walk_visits_every_order_by_swaps_of_neighbours():
    for n in (1, 2, 3, 5):
        seen, last = [], None
        for order, at in filteraudit.walk(n):
            if last is not None:
                last[at], last[at + 1] = last[at + 1], last[at]
                assert last == order
            last = list(order)
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def audit(rows, labels):
    good, toxic = ({i for i, *q in labels if i is not None and q[k] == 1} for k in (0, 1))
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    cells = collections.Counter()
    for i, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        cells[part or "", "".join(f for f in fails if fails[f]), i in good, i in toxic] += 1
    out, share = {}, collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for step, f in enumerate(order):
            for (part, m, g, x), n in cells.items():
                row = out.setdefault((part, order, step + 1), collections.Counter())
                gone, hit = bool(set(m) & set(order[:step])), f in m
                row["kept"] += n * (not gone and not hit)
                row["removed"] += n * (hit and not gone)
                row["redundant"] += n * (hit and gone)
                row["unique_fails"] += n * (m == f)
                row["good_lost"] += n * (hit and not gone and g)
                row["toxic_lost"] += n * (hit and not gone and x)
                share[part, f] += n * (hit and not gone)
    for (part, order, step), row in out.items():
        row["shapley"] = share[part, order[step - 1]]
    return out


def found(df):
    got = {}
    for r in df.collect():
        assert (r["part"], r["filter_order"], r["step"]) not in got
        got[r["part"], r["filter_order"], r["step"]] = {m: r[m] for m in filteraudit._MEASURES}
    return got


def test_audit(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]

    def text():
        many = " ".join(r.sample(words, 260)) if r.random() < 0.4 else " ".join(r.choice(words[:90]) for _ in range(r.choice([5, 230, 260])))
        return many + r.choice(["", "", " A B C D" * 20, " 5%", " | #"])

    rows = [(i, text(), r.choice(["a", "b", None, "", "é"])) for i in range(160)]
    rows += [(200 + i, rows[3][1], "a") for i in range(40)] + [(1, rows[30][1], "b"), (1, rows[30][1], "b"), (None, rows[5][1], "a"), (None, rows[5][1], None)]
    rows += [(300, None, "a"), (301, "", None), (302, "É" * 300 + " A\x0b\x1fB C", "lone"), (303, "w " * 300_000, "long")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 230, 3)] + [(3, 1, 0), (3, 0, 0), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("part", "mask", "n", "digest")}).repartition(3)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x"))
    want = {k: dict(v) for k, v in audit(rows, labels).items()}
    got = found(filteraudit.audit_orders(filteraudit.mask_cells(docs, told)))
    assert len(got) == 120 * 5 * 6
    assert got == {k: {m: v.get(m, 0) for m in filteraudit._MEASURES} for k, v in want.items()}
    assert all(sum(got["a", o, s]["removed"] for s in range(1, 6)) + got["a", o, 5]["kept"] == sum(x[2] == "a" for x in rows) for o in map("".join, itertools.permutations("ABCDE")))
    assert filteraudit.audit_orders(filteraudit.mask_cells(docs.limit(0), told)).count() == 0
    assert len(found(filteraudit.audit_orders(filteraudit.mask_cells(docs, told.limit(0))))) == 3600
