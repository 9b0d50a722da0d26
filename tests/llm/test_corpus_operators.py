"""Mixing, search, chat and packing against brute force and exact round trips."""

import collections
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapidary.llm import chat, mixing, packing
from lapidary.llm.vptree import Tree, nearest

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("n", [1, 2, 9, 100])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5))).collect()]
    assert sorted(got) == list(range(n))


def water(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    total, free, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        level = (total - sum(3 * sizes[i] for i in range(len(sizes)) if i not in free)) / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] > 3 * sizes[i]}
        if not over:
            for i in free:
                out[i] = level * weights[i]
            break
        free -= over
    return [out[i] if i in free else 3.0 * sizes[i] for i in range(len(sizes))]


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randrange(0, 400), ["b", "a", None, "tiny", "é"][0 if i % 3 == 0 else i % 5]) for i in range(300) if i % 5 != 3 or i == 3]
    rows += [(500, None, "a"), (501, "", None), rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("block", F.lit(0))
    out, slots = mixing.mix_sources(df, block=16)
    got = out.collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df, block=16)[0].collect()))
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    target = dict(zip(names, water([size[s] for s in names])))
    taken = collections.Counter()
    for x in got:
        taken[x["source"]] += x["taken"]
        assert x["taken"] <= 3 * x["size"] and x["target"] == pytest.approx(target[x["source"]]) and x["source_size"] == size[x["source"]]
    for s in names:
        assert abs(taken[s] - target[s]) <= 64
    slots = slots.collect()
    places = [(x["shard"], x["place"]) for x in slots]
    assert len(set(places)) == len(places)
    # every word taken is one of a block in a slot of some shard
    for x in got:
        own = [y["block"] for y in slots if y["rank"] == x["rank"]]
        assert x["taken"] == sum(max(0, min(x["start"] + x["size"], 16 * b + 16) - max(x["start"], 16 * b)) for b in own)


def test_mixing_draws_counts_per_shard(spark):
    """Shards are full but the last, their source counts scatter as draws from the totals do, blocks are used evenly."""
    r = random.Random(5)
    rows = [(i, "w " * r.randrange(1, 400), "abc"[i % 3]) for i in range(600)]
    _, mix = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=8, shard_slots=256)
    got = mix.collect()
    by_shard = collections.Counter(x["shard"] for x in got)
    assert all(by_shard[s] == 256 for s in range(max(by_shard))) and sorted(by_shard) == list(range(len(by_shard)))
    assert all(sorted(x["place"] for x in got if x["shard"] == s) == list(range(by_shard[s])) for s in list(by_shard)[:5])
    for source in "abc":
        share = sum(x["source"] == source for x in got) / len(got)
        counts = [sum(x["source"] == source and x["shard"] == s for x in got) for s in range(max(by_shard))]
        z = [(c - 256 * share) / (256 * share * (1 - share)) ** 0.5 for c in counts]
        assert 0.5 < np.mean(np.square(z)) < 1.6 and max(map(abs, z)) < 5
        uses = collections.Counter(x["block"] for x in got if x["source"] == source)
        assert max(uses.values()) - min(uses.values()) <= 1


def test_mixing_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [x["taken"] for x in mixing.mix_sources(df)[0].collect()] == [0, 0]
    none = mixing.mix_sources(df.limit(0))
    assert none[0].count() == 0 and none[1].count() == 0


def cosine(v, w):
    """With exponents taken out, so that nothing overflows."""
    v, w = (np.ldexp(x, -np.frexp(np.abs(x).max())[1]) for x in (v, w))
    return (v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))


def test_tree_is_exact_at_factor_one():
    r = np.random.default_rng(1)
    m = r.normal(size=(900, 8))
    m[100:140] = m[100]  # ties
    m[200:220] = m[200] * (1 + 1e-9 * r.normal(size=(20, 8)))  # nearer than any rounded distance tells
    m[300] *= 1e200
    m[301] *= 1e-200
    q = np.concatenate([m[::30], m[200:201], m[300:302]])
    ids = r.permutation(900)
    rows, score = Tree(m, ids, leaf=16).search(q, 5, 1.0)
    c = np.array([[cosine(x, y) for y in m] for x in q])
    want = np.array([np.lexsort((ids, -x))[:5] for x in c])
    assert (rows == want).all() and (score == np.take_along_axis(c, want, 1)).all()
    tree = Tree(m, leaf=16)
    rough, _ = tree.search(q, 5, 0.5)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(rough, want)]) > 0.5 and tree.visited < len(q) * 900


def test_nearest(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=6)]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(9)] + [(2000, None), (2050, [0.0] * 6), (2100, [float("nan")] * 6), (2150, [None] * 6), (2200, [1.0, 2.0])]
    rows += [(2250, [1e200] * 6), (2300, [1e-200] * 6), (2350, [1.0] * 6), (2350, [1.0] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("score", F.lit(1))
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 6 and None not in v and np.isfinite(v).all() and any(v)]
    got = collections.defaultdict(list)
    for x in nearest(df, df.where("vec_id % 50 = 0"), factor=1.0, shard_rows=100).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    for q, v in good:
        if q % 50 == 0:
            assert got[q] == [(i, s) for s, i in sorted(((cosine(v, w), i) for i, w in good if i != q), key=lambda t: (-t[0], t[1]))[:5]]
    assert 2000 not in got and 2050 not in got and 2100 not in got and 2200 not in got
    assert nearest(df.limit(0), df).count() == 0 and nearest(df, df.limit(0)).count() == 0


def test_chat_of_many_turns(spark):
    """Work is linear in the turns of a conversation: 32,000 of them in well under a minute."""
    part = chat.text_part(F.concat(F.lit("said \\ <|"), F.col("id").cast("string")))
    turns = spark.range(32_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), part.alias("parts"))
    began = time.time()
    row = chat.format_chat(turns).select(F.size(chat.read_back(F.col("formatted"))).alias("n"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").alias("chars"), F.element_at("loss_spans", -1).alias("last")).first()
    assert time.time() - began < 60
    assert row["n"] == 32_000 and row["loss"] == "".join(f"said \\ <|{i}" for i in range(1, 32_000, 2))
    assert row["last"]["start"] + row["last"]["length"] + len(chat.END) == row["chars"]


HARD = ["", "plain", "<|im_end|>", "\\", "\\\\|", "<\\|x|>", "<", "a<|im_start|>b\\<|", "|>\n<|image:0|>", "é\u0000\U0001f600"]


def test_chat_round_trip(spark):
    rows = [(i % 4, i // 4, ["user", "assistant", None, "sys<|tem"][i % 4 if i % 3 else 1], t) for i, t in enumerate(HARD * 2)] + [(None, None, "assistant", None), (7, 0, "assistant", "dup"), (7, 0, "assistant", "dup"), (8, 0, "assistant", "long " * 50000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    out = chat.format_chat(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    want = collections.defaultdict(list)
    for c, n, role, text in rows:
        want[c].append(((n is not None, n or 0), role or "", text or ""))
    got = out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "loss_spans").collect()
    assert len(got) == len(want)
    for x in got:
        turns = [(r, t) for _, r, t in sorted(want[x["conv_id"]])]
        assert [(t["role"], t["text"]) for t in x["turns"]] == turns
        assert x["loss"] == "".join(t for r, t in turns if r == "assistant")
    assert chat.format_chat(df.limit(0).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))).count() == 0


def test_chat_attachments(spark):
    part = "struct<kind:string,text:string,ref:string,width:int,height:int,millis:bigint,pages:int>"
    image, audio, doc = ("image", None, "i.png", 56, 29, None, None), ("audio", None, "a.wav", None, None, 100, None), ("document", None, "d.pdf", None, None, None, 3)
    text = lambda t: ("text", t, None, None, None, None, None)
    df = spark.createDataFrame([(1, 0, "user", [text("see "), image, text(" and "), doc]), (1, 1, "assistant", [audio, text("ok")]), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts array<{part}>")
    row = chat.format_chat(df).first()
    assert [(a["ordinal"], a["kind"], a["ref"], a["n_tokens"]) for a in row["attachments"]] == [(0, "image", "i.png", 4), (1, "document", "d.pdf", 768), (2, "audio", "a.wav", 3)]
    assert row["expanded_tokens"] == 775 and "see <|image:0|> and <|document:1|>" in row["formatted"]
    (span,) = row["loss_spans"]
    assert row["formatted"][span["start"] : span["start"] + span["length"]] == "<|audio:2|>ok"


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(4)
    texts = [None, "", "a", "<|endoftext|> end", "wide　 \n space", "don't\t\tstop", "word " * 9000] + ["".join(r.choice(["alpha ", "béta\n", " 12", "  ", "xyz!", "ÉTÉ "]) for _ in range(r.randrange(900))) for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("start", F.lit(1)).repartition(3)
    tok = Tokenizer.from_file(path)
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    rows = packing.pack(df, path).collect()
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for x in rows:
        own = ids[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        assert x["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and x["doc_tokens"] == len(ids[x["doc_id"]])
        pieces[x["doc_id"]].append((x["start"], x["length"]))
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    for held in (*pieces.values(), *bins.values()):
        at = 0
        for start, n in sorted(held):
            assert start == at and n > 0
            at += n
    assert all(sum(n for _, n in pieces[i]) == len(x) for i, x in enumerate(ids)) and all(sum(n for _, n in b) <= 2048 for b in bins.values())
    assert sum(map(len, ids)) / (2048 * len(bins)) > 0.9
    assert packing.pack(df.limit(0), path).count() == 0


def test_cuts():
    for n in range(1, 5000):
        out = packing.cut(n)
        assert sum(out) == n and all(0 < x <= 2048 for x in out)
