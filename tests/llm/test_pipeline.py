"""The pipeline's stages, one after the other, each against what its own input demands."""

import random
import re

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark):
    r = random.Random(6)
    bank = {"en": "the and house of time with over is a nice".split(), "fr": "le la maison temps avec sur est une très belle".split()}
    say = lambda x, n: " ".join(r.choice(bank[x]) + r.choice("abcde") for _ in range(n))
    rows = []
    for i in range(60):
        x = ["en", "fr"][i % 2]
        rows.append((i, say(x, 40) + ("\na shared line of text" if i % 3 == 0 else ""), x, f"src{i % 4}", 7))
    rows += [(100 + i, rows[5][1].replace("a", "e", i), "fr", "src0", 7) for i in range(3)]  # copies and near copies
    rows += [(200, "%%% 12 34 !!", None, None, 7), (201, None, None, "src1", 7), (202, "", "en", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-test-{k}"
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == before.columns
    before, after = seen["language"]
    gone = {x["doc_id"] for x in before} - {x["doc_id"] for x in after}
    assert gone == {200, 201}  # no letters and no declaration
    before, after = seen["lines"]
    assert len(before) == len(after)
    first = min(x["doc_id"] for x in before if "a shared line of text" in (x["text"] or ""))
    assert [x["doc_id"] for x in after if "a shared line of text" in x["text"]] == [first] and all(x["n_chars"] == len(x["text"]) for x in after)
    before, after = seen["near_duplicates"]
    sets = {x["doc_id"]: grams(x["text"]) for x in before}
    left = {x["doc_id"] for x in after}
    close = lambda a, b: sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert not any(close(a, b) for a in left for b in left if a < b)
    assert all(any(close(a, b) for b in sets if b < a) for a in set(sets) - left)
    before, after = seen["mixing"]
    words = {x["doc_id"]: len(WORD.findall(x["text"])) for x in before}
    assert all(sum(y["doc_id"] == i for y in after) <= 3 for i in words)
    total, taken = sum(words.values()), sum(words[y["doc_id"]] for y in after)
    assert abs(taken - total) < 0.25 * total and {y["text"] for y in after} <= {x["text"] for x in before}
    before, after = seen["packing"]
    tokens = {y["doc_id"]: y["doc_tokens"] for y in after}
    assert sum(y["length"] for y in after) == sum(tokens[x["doc_id"]] for x in before)


def test_language_stage_rejects_other_languages(spark):
    r = random.Random(7)
    bank = {"en": "the and house of time with over is a nice".split(), "fr": "le la maison temps avec sur est une très belle".split()}
    rows = [(i, " ".join(r.choice(bank[x]) for _ in range(40)), x, f"src{i % 4}") for i, x in enumerate(["en", "fr"] * 60)]
    rows += [(500, "Город был спокоен в то утро, и мальчики шли в школу", "ru", "src1"), (501, "asdf qwer zxcv hjkl uiop bnmq wert sdfg xcvb", None, "src2"), (502, "那天早上城市很安静，男孩们背着装满书的书包去上学", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {x["doc_id"] for x in corpus_pipeline.language(spark, docs, "").collect()} == set(range(120))


def test_near_duplicates_null_ids_and_repeated_rows(spark):
    r = random.Random(8)
    say = lambda: " ".join(r.choice("alpha beta gamma delta".split()) + str(r.randrange(50)) for _ in range(60))
    a, b, c, d, e = (say() for _ in range(5))
    rows = [(None, a, 1), (1, a, 1), (2, a + " tail", 1), (None, a, 1)]  # a null id stands for its group, once
    rows += [(10, b, 1), (10, b, 2), (10, b, 1)]  # repeated rows
    rows += [(20, c, 1), (21, c, 1), (21, d, 1)]  # 21 is a copy of 20 and a text of its own
    rows += [(30, e, 1), (30, e + " tail", 1)]  # near copies that share an id
    rows += [(40, None, 1), (40, None, 1), (None, "", 1), (None, None, 1)]  # no words: linked to nothing
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int")
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    left = [(x["doc_id"], x["text"]) for x in left.collect()]
    assert len(left) == 9 and sorted(left[i][1] in (e, e + " tail") for i in range(9)).count(True) == 1
    want = [(None, a), (10, b), (20, c), (21, d), (40, None), (40, None), (None, ""), (None, None)]
    assert sorted(map(repr, want)) == sorted(repr(x) for x in left if x[0] != 30)


def test_language_keeps_rows_that_share_an_id(spark):
    rows = [(i, "the house of time is a nice and over with " * 4, "en", "a") for i in range(20)] + [(3, "1 2 3", None, "a"), (None, "4 5", None, "a"), (None, "the house", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    left = [(x["doc_id"], x["text"]) for x in corpus_pipeline.language(spark, docs, "").collect()]
    assert sorted(map(repr, left)) == sorted(repr(x[:2]) for x in [*rows[:20], rows[22]])
