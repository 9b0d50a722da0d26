"""SetSketch near-duplicates against brute force; the sketches' own laws."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from lapidary.llm import setsketch
from lapidary.llm.ngramjoin import minima

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sketch(*sets):
    keys = [np.array(sorted(s), np.uint64) for s in sets]
    return setsketch.registers(minima(np.concatenate(keys), np.cumsum([0, *map(len, keys)]), setsketch.REGISTERS))


def keys(r, n):
    return {r.randrange(1 << 64) for _ in range(n)}


def test_sketch_of_a_union():
    r = random.Random(2)
    a, b = keys(r, 700), keys(r, 40)
    b |= set(list(a)[:300])
    one, two, both = sketch(a, b, a | b)
    assert (setsketch.merge(one, two) == both).all() and (setsketch.merge(one, sketch(set())[0]) == one).all()


def test_registers_agree_as_the_law_says():
    r = random.Random(3)
    for n, m, shared in ((400, 400, 300), (500, 420, 400), (60, 50, 44)):
        hits = []
        for _ in range(40):
            common = keys(r, shared)
            x, y = sketch(common | keys(r, n - shared), common | keys(r, m - shared))
            hits.append((x == y).mean())
        want = setsketch.agreement(shared / (n + m - shared), np.array([n / (n + m)]))[0]
        assert abs(np.mean(hits) - want) < 0.02


def test_estimate_is_likeliest_and_near():
    r = random.Random(4)
    found, truth, wide = [], [], []
    for shared in range(100, 400, 3):
        common = keys(r, shared)
        a, b = common | keys(r, 400 - shared), common | keys(r, 380 - min(shared, 380))
        x, y = sketch(a, b)
        own = np.array([len(a) / (len(a) + len(b))])
        more, equal = np.array([(x > y).sum()], float), np.array([(x == y).sum()], float)
        less = setsketch.REGISTERS - more - equal
        j = setsketch.estimate(more, less, equal, own)[0]

        def likelihood(s):
            p, q = setsketch._larger(own - (1 - own) * s)[0], setsketch._larger(1 - own - own * s)[0]
            return more[0] * np.log(max(p, 1e-300)) + less[0] * np.log(max(q, 1e-300)) + equal[0] * np.log(1 - p - q)

        top = min(own[0] / (1 - own[0]), (1 - own[0]) / own[0])
        grid = np.linspace(0, top - 1e-9, 400)
        assert likelihood(min(j, top - 1e-9)) >= max(map(likelihood, grid)) - 1e-4
        found.append(j)
        truth.append(len(a & b) / len(a | b))
        wide.append(setsketch.standard_error(truth[-1], own, setsketch.REGISTERS)[0])
    z = (np.array(found) - truth) / wide
    assert abs(z.mean()) < 0.5 and 0.6 < z.std() < 1.5


def test_bands():
    bands, rows = setsketch.choose_bands()
    assert bands * rows <= setsketch.REGISTERS
    for own in np.linspace(0.4445, 0.5555, 9):
        assert 1 - (1 - setsketch.agreement(0.8, np.array([own]))[0] ** rows) ** bands >= 0.999


def brute(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    low = [-(10**18) if i is None else i for i, _ in rows]
    label = list(low)
    links = [[j for j, t in enumerate(sets) if s and t and 100 * len(s & t) >= 80 * len(s | t)] for s in sets]
    while True:
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(rows))]
        if new == label:
            return sorted(((rows[i][0], len(sets[i]), None if label[i] == -(10**18) else label[i], label[i] == low[i]) for i in range(len(rows))), key=str)
        label = new


def found(df, **how):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in setsketch.near_duplicates(df, **how).collect()), key=str)


def test_near_duplicates(spark):
    """Null and repeated ids, equal rows, texts of all lengths; components of one block and of several."""
    r = random.Random(5)
    bank = [f"{x}{i}" for x in ("Alpha", "béta", "É", "the") for i in range(30)]
    base = " ".join(r.choice(bank) for _ in range(140))
    near = [" ".join(w if r.random() > 0.01 else "edit" for w in base.split()) for _ in range(30)]
    far = [" ".join(r.choice(bank) for _ in range(90)) for _ in range(12)]
    texts = [None, "", " \n\t ", "one", "One", "one two three", "ONE two three", "one two three four", base, base.upper().replace("É", "É"), base + " tail", "same same same same " * 30, "same same same same same", "w " * 60000, *near, *far]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, far[0] + " tail"), (None, far[0] + " tail"), (None, None), (9, far[1]), (9, far[1]), (12, near[7])]
    rows += [(900 - i, far[2]) for i in range(60)]  # a group of copies, smallest id last
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1024, 8):
        assert found(df.withColumn("node", F.lit(1)).withColumn("size", F.lit("x")), block=block) == want
    assert setsketch.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    r = random.Random(11)
    rows, want = [], set()
    for i in range(300):
        w = [f"{i}x{r.randrange(10**6)}" for _ in range(300)]
        n = r.randrange(32, 47)
        cut = w[:-n] + [f"{i}y{j}" for j in range(n // 2)]
        a, b = ({tuple(x[k : k + 4]) for k in range(len(x) - 3)} for x in (w, cut))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(cut))]
        if 100 * len(a & b) >= 80 * len(a | b):
            want.add(2 * i + 1)
    got = {x["doc_id"] for x in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("not kept").collect()}
    assert 60 < len(want) < 290 and got <= want and len(got) >= 0.98 * len(want)
