"""Joins with few keys and much work: whole results by brute force, and nothing that grows with the tables through the driver or in one task."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import caches, cards, chat, validate


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_vocabulary_is_dealt(spark):
    teacher = spark.createDataFrame([(i, f"{i:04d}".encode().hex()) for i in range(300)] + [(900, "")], "id long, hex string")
    student = spark.createDataFrame([(i, f"{i:02d}".encode().hex()) for i in range(20)] + [(77, b"0007".hex()), (78, b"0007".hex())], "id long, hex string")
    found = caches.vocabulary_map(teacher, student)
    assert {r["teacher"]: (r["student"], r["exact"]) for r in found.collect()} == {i: (77, True) if i == 7 else (i // 100, False) for i in range(300)}
    assert "Broadcast" not in plan(found)


def test_projected_rows_are_dealt(spark):
    mapping = spark.createDataFrame([(0, 10), (1, 11)], "teacher long, student long")
    rows = spark.createDataFrame([(0, 0, -1.0), (0, 1, -1.0), (1, 1, -3.0)], "row long, token long, lp double")
    got = caches.projected(rows, ["row"], "token", "lp", mapping)
    assert len(got.collect()) == 3 and "Broadcast" not in plan(got)


@pytest.mark.parametrize("least", [0, 1, 2])
def test_dominance_by_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(validate, "MEMBERS", 3)
    r = random.Random(least)
    rows = [(i, r.choice("xy"), r.choice([None, 1, 2, 2, 2]), r.choice([1.0, 2.0, 3.0])) for i in range(60)]
    got = validate.dominance_pairs(spark.createDataFrame(rows, "k long, g string, p int, q double"), "k", ["p", "q"], ["g"], least)
    want = {}
    for a in rows:
        for b in rows:
            if a[0] != b[0] and a[1] == b[1] and None not in (a[2], b[2]) and a[2] >= b[2] and a[3] >= b[3] and (a[2] > b[2]) + (a[3] > b[3]) >= least:
                want[a[0], b[0]] = (a[2] > b[2]) + (a[3] > b[3])
    out = got.collect()
    assert {(x["a"], x["b"]): x["better"] for x in out} == want and len(out) == len(want)
    assert "Broadcast" not in plan(got) and got.rdd.getNumPartitions() >= 4  # one small file is not one task


@pytest.mark.parametrize("side,members", [(16384, 256), (7, 2)])
def test_dominance_between_slices(spark, monkeypatch, side, members):
    """Slices of a block, copied keys and missing ranks and blocks: each pair once for each of its rows."""
    monkeypatch.setattr(validate, "SIDE", side, raising=True)
    monkeypatch.setattr(validate, "MEMBERS", members)
    r = random.Random(side)
    rows = [(None, "z", 1, 1.0)] + [(i // 2 if i < 8 else i, r.choice(["x", "x", "y", None]), r.choice([None, 1, 2]), r.choice([1.0, 2.0, float("nan")])) for i in range(90)]
    got = validate.dominance_pairs(spark.createDataFrame(rows, "k long, g string, p int, q double"), "k", ["p", "q"], ["g"], 1)
    rank = lambda x: float("inf") if x != x else x
    want = []
    for a in rows:
        for b in rows:
            better = None not in (a[1], a[2], b[2]) and (a[2] > b[2]) + (rank(a[3]) > rank(b[3]))
            if better and a[0] != b[0] and a[1] == b[1] and a[2] >= b[2] and rank(a[3]) >= rank(b[3]):
                want.append((a[0], b[0], better))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_dominance_pairs_take_little_disk(spark, tmp_path):
    """The result is all pairs, so their order decides what files of it take: runs of one a with the same few b's."""
    rows = spark.range(12600).select(F.col("id").alias("k"), F.lit("x").alias("g"), (F.col("id") < 600).cast("int").alias("p"))
    validate.dominance_pairs(rows, "k", ["p"], ["g"], 1).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 600 * 12000
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 0.4 * 600 * 12000


@pytest.mark.parametrize("block,look", [(1024, 8), (5, 8), (40, 1)])
def test_drawn_passages_by_brute_force(spark, monkeypatch, block, look):
    monkeypatch.setattr(cards, "BLOCK", block)
    monkeypatch.setattr(cards, "LOOK", look)
    some = [(i, "ab"[i % 2] if i % 7 else None) for i in range(50)] + [(99, "c"), (98, "d")]
    passages = [(100 + i, "ab"[i % 2], -i) for i in range(60)] + [(900, "c", 1), (901, None, 1)]
    got = cards.drawn(spark.createDataFrame(some, "card long, kind string"), "card", "kind", spark.createDataFrame(passages, "id long, kind string, line int"), "id", "line", 2, 7)
    want = {}
    for card, kind in some:
        own = sorted((hashlib.sha256(f"7:passages:{card}:{i}".encode()).hexdigest(), line, i) for i, k, line in passages if k == kind and kind is not None)[:2]
        if own:
            want[card] = [i for _, line, i in sorted(own, key=lambda x: x[1])]
    assert {x["card"]: x["passages"] for x in got.collect()} == want and "Broadcast" not in plan(got)


@pytest.mark.parametrize("block,look", [(16384, 4), (7, 1)])
def test_drawn_passages_compiled_and_in_place(spark, monkeypatch, block, look):
    """Pairs are hashed in compiled code and chosen where they are made; copied cards and cards without a hash below the limit are whole."""
    monkeypatch.setattr(cards, "BLOCK", block)
    monkeypatch.setattr(cards, "LOOK", look)
    monkeypatch.setattr(cards, "TASK_PAIRS", 500, raising=True)
    some = [(i // 2 if i < 10 else i, "ab"[i % 2]) for i in range(200)] + [(0, "b"), (0, "c")]
    passages = [(100 + i, "ab"[i % 2], -i) for i in range(60)] + [(900, "c", 1), (None, "a", 2)]
    got = cards.drawn(spark.createDataFrame(some, "card long, kind string"), "card", "kind", spark.createDataFrame(passages, "id long, kind string, line int"), "id", "line", 3, 7)
    pairs = {}
    for card, kind in some:
        pairs.setdefault(card, []).extend((hashlib.sha256(f"7:passages:{card}:{i}".encode()).hexdigest(), line, i) for i, k, line in passages if k == kind and i is not None)
    want = {card: [i for line, i in sorted((line, i) for _, line, i in sorted(own)[:3])] for card, own in pairs.items()}
    assert {x["card"]: x["passages"] for x in got.collect()} == want
    text = plan(got)
    assert "Broadcast" not in text and "Generate posexplode" in text
    looked = text[: text.index("Generate posexplode")].rsplit("Exchange", 1)[-1]
    assert looked.count("ObjectHashAggregate(keys=[__kind") == 2  # no exchange between the pairs and the choice


def test_equal_templates_are_filled_once(spark):
    items = spark.createDataFrame([(str(i), str(i % 2), f"p{i}", f"o{i}") for i in range(4)], "id string, topic string, preference string, opposite string")
    questions = spark.createDataFrame([("2", "<A> or <B>?"), ("1", "<A> or <B>?"), (None, "what?"), ("3", "what?")], "q_id string, q_t string")
    answers = spark.range(5000).select(F.lpad("id", 5, "0").alias("a_id"), F.when(F.col("id") % 2 == 0, "<A>").otherwise("not <B>").alias("a_t"))
    got = chat.cross_fill(items, questions, answers)
    rows = {(x["topic"], x["q_t"], x["a_t"]): (x["id"], x["q_id"], x["a_id"]) for x in got.collect()}
    want = {(str(i % 2), q.replace("<A>", f"p{i}").replace("<B>", f"o{i}"), a): (str(i), n, k) for i in range(4) for n, q in (("1", "<A> or <B>?"), (None, "what?")) for a, k in ((f"p{i}", "00000"), (f"not o{i}", "00001"))}
    assert rows == want
    assert "hint" not in plan(got) and got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 3  # templates shrink before they meet items


def test_shared_prefixes_over_ranges(spark, monkeypatch, tmp_path):
    """A source goes over several ranges, copies and null sources too: the same counts as over one order."""
    from collections import Counter

    from corpusloom.plans import corpus

    monkeypatch.setattr(corpus, "RANGE_ROWS", 9, raising=True)
    monkeypatch.setattr(corpus, "RANGE_WORDS", 2)
    r = random.Random(6)
    rows = [(i, r.choice(["s", "t", None]), " ".join(r.choice("abc") for _ in range(r.randint(0, 6))) if i % 11 else None) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for source in ("s", "t", None):
        texts = sorted(x.split() for _, s, x in rows if s == source and x is not None)
        for a, b in zip(texts, texts[1:], strict=False):
            want[next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))] += 1
    assert {x["shared"]: x["n"] for x in corpus.shared_prefix(spark, str(tmp_path)).collect()} == want
