"""Ranked search against a plain scoring of every pair, with tiers and shards so small that items are proved in all of them."""

import math
import random
import re
from collections import Counter

import pytest

from corpusloom.llm import search

LONG = "zz " * 300_000 + "rare"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def found(rows):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("tiers", [((1, 1 / 64), (3, 1 / 8)), ((2, 0.5),), ()])
def test_search_by_brute_force(spark, monkeypatch, tiers):
    r = random.Random(5)
    monkeypatch.setattr(search, "TIERS", tiers)
    monkeypatch.setattr(search, "SHARD", 16)
    monkeypatch.setattr(search, "WIDTH", 4096)
    vocabulary = ["É", "é", "zwölf", "a1", "B2", "x_y", "中文"] + [f"w{i}" for i in range(60)]
    pick = lambda n: r.choice([" ", "-", "\n", "_"]).join(r.choice(vocabulary[: 1 + int(len(vocabulary) * r.random() ** 2)]) for _ in range(n))
    docs = [(i if i % 9 else None, pick(r.randint(1, 40)) if i % 11 else (None, "", " .,")[i % 3]) for i in range(200)]
    docs += [(7, "w1 w2 w3"), (7, "w1 w2 w3"), (8, "w1 w2 w3"), (300, LONG)]
    items = [(i, pick(r.randint(1, 9))) for i in range(30)] + [(1, "w1 w1 w2"), (None, "W1 rare"), (40, None), (41, "absent"), (42, "W1-w2")]
    given = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, shard long, tier0 string").repartition(3)
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, item int")
    seen = {}
    assert found(search.search(given, asked, seen=seen)) == plain(docs, items)
    if len(tiers) == 2:
        assert seen[0] > 0 and seen[1] > 0 and seen[0] + seen[1] < len(items)
    monkeypatch.setattr(search, "ITEMS", 7)  # several blocks
    monkeypatch.setattr(search, "CANDIDATES", 12)  # many candidates leave an item open
    monkeypatch.setattr(search, "NAMED", 1)
    monkeypatch.setattr(search, "AT_ONCE", 50)
    assert found(search.search(given, asked)) == plain(docs, items)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    none = docs.limit(0)
    assert search.search(none, items).count() == 0 and search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs.filter("doc_id = 2"), items).count() == 0
    assert found(search.search(docs, items)) == plain([(1, "a b"), (2, None)], [(1, "a")])
