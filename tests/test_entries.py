"""Replies to rows and rejects, mirrored texts, trees and shards: edge cases, and plain forms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import entries, passages, sample, tree


def test_all_entries_come_out_as_rows_or_rejects(spark):
    schema, need = "title string, n int", ["title"]
    replies = {
        1: json.dumps([{"title": "A", "n": 1}, {"title": " "}, {"title": 5}, {"n": 2}, "x", None, [1], {"title": None}, {"title": "é \"q\"", "n": "no"}]),
        2: json.dumps({"list": [{"title": "B"}]}), 3: json.dumps({"list": []}), 4: json.dumps({"other": [{"title": "B"}]}), 5: None, 6: "", 7: "So:\n```json\n[{\"title\": \"C\"}, {\"title\": \"cut", 8: "[]",
        9: json.dumps([7, "t"]), 10: "{\"list\": [{\"title\": \"D\"}] and more", None: "[{\"title\": \"E\"}]",
    }
    df = spark.createDataFrame(list(replies.items()), "id int, reply string")
    got = entries.entries_of(df, ["id"], "reply", schema, need, "list").collect()
    found = {(r["id"], r["place"]): r["reason"] or tuple(r["entry"]) for r in got}
    assert len(found) == len(got)
    want = {
        (1, 0): ("A", 1), (1, 1): "blank:title", (1, 2): "not_text:title", (1, 3): "missing:title", (1, 4): "not_an_object", (1, 5): "not_an_object", (1, 6): "not_an_object", (1, 7): "missing:title", (1, 8): ("é \"q\"", None),
        (2, 0): ("B", None), (3, None): "empty_list", (4, None): "no_list", (5, None): "no_json", (6, None): "no_json", (7, 0): ("C", None), (7, 1): ("cut", None), (8, None): "empty_list", (9, 0): "not_an_object", (9, 1): "not_an_object",
        (10, 0): ("D", None), (None, 0): ("E", None),
    }
    assert found == want
    whole = entries.entries_of(df, ["id"], "reply", schema, need, "list")
    again = [(r["id"], r["place"], r["reason"]) for r in entries.rejects(whole).collect()]
    assert (9, None, "no_items") in again and entries.good(whole).count() + sum(p is not None or why != "no_items" for _, p, why in again) == len(got)
    assert entries.entries_of(df.limit(0), ["id"], "reply", schema, need).count() == 0


def test_slots_by_name_then_by_place(spark):
    slots = [("Fish market", "low"), ("Law office", "high")]
    rows = [("fish market (inner city).", 1), ("LAW OFFICE", 0), ("other", 1), ("other.", 5), (None, 0), (None, 9)]
    df = spark.createDataFrame([(n, p, slots) for n, p in rows], "named string, place int, slots array<struct<domain:string,harm:string>>")
    got = [r["s"]["domain"] if r["s"] else None for r in df.select(entries.slot_of(F.col("named"), F.col("slots"), F.col("place")).alias("s")).collect()]
    assert got == ["Fish market", "Law office", "Law office", None, "Fish market", None]


def test_a_bank_of_passages_that_is_broken_in_each_way(spark):
    text = "# Title\n\nFirst.\nSecond.\n\nThird."
    lines = lambda s: passages.spec_lines(spark.createDataFrame([(1, s)], "k int, t string"), "k", F.col("t"))
    bank = spark.createDataFrame([("E1", 3), ("E2", 4), ("E3", 6)], "id string, line int")
    lists = spark.createDataFrame([("a", ["E1", "E2"]), ("b", ["E2", "E3"])], "kind string, ids array<string>")

    def found(other=text.replace(".", "!"), bank=bank, lists=lists, kinds=("a", "b"), per=2):
        return sorted(tuple(r) for r in passages.passage_problems(passages.aligned(lines(text), lines(other), ["k"]), bank, lists, list(kinds), per).collect())

    assert found() == []
    assert ("not_mirrored", "5", "only_second") in found(text.replace("Second.", "Second.\nMore."))
    assert found(text.replace("First.", "# First")) == [("not_a_paragraph", "E1", "3"), ("not_mirrored", "3", "kinds_differ")]
    assert found(bank=bank.unionByName(spark.createDataFrame([("E4", 1), ("E1", 3)], "id string, line int"))) == [("not_a_paragraph", "E4", "1"), ("repeated_id", "E1", "2")]
    assert found(per=3) == [("too_few", "a", "2"), ("too_few", "b", "2")] and ("per_card", "per_card", "0") in found(per=0)
    assert found(kinds=("a", "c")) == [("kinds", "b", "unknown"), ("kinds", "c", "missing")]
    odd = spark.createDataFrame([("a", ["E1", "E1"]), ("b", ["E2", "E9"])], "kind string, ids array<string>")
    assert found(lists=odd) == [("ids", "a", "2"), ("ids", "b", "2")]
    drawn = spark.createDataFrame([("c1", 1, 6), ("c1", 1, 3), ("c2", 1, 4)], "card string, k int, line int")
    both = passages.aligned(lines(text), lines(text.replace(".", "!")), ["k"])
    assert {r["card"]: r["passage"] for r in passages.passage_text(drawn, both, ["card"], ["k"], "second").collect()} == {"c1": "First!\n\nThird!", "c2": "Second!"}


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5, 6, 40])
def test_settings_come_from_the_nearest_ancestor(spark, depth):
    r = random.Random(depth)
    nodes = [(i, None if i == 0 else i - 1 if i < depth else r.randrange(min(i, depth)), r.choice([None, None, i]), r.choice([None, f"s{i}"]), f"n{i}") for i in range(depth + 20)]
    of = {n[0]: n for n in nodes}

    def plain(i):
        chain = []
        while i is not None:
            chain.append(of[i])
            i = of[i][1]
        return len(chain) - 1, chain[-1][0], next((c[2] for c in chain if c[2] is not None), None), next((c[3] for c in chain if c[3] is not None), None), "/".join(c[4] for c in reversed(chain))

    got = tree.inherited(spark.createDataFrame(nodes, "id int, up int, a int, b string, name string"), "id", "up", ["a", "b"], "name").collect()
    assert {x["id"]: (x["depth"], x["root"], x["a"], x["b"], x["path"]) for x in got} == {i: plain(i) for i in of} and not any(x["orphan"] for x in got)


def test_trees_that_are_none(spark):
    of = lambda *rows: spark.createDataFrame(list(rows), "id int, up int, a int")
    with pytest.raises(ValueError, match="on or below a cycle"):
        tree.inherited(of((1, None, 0), (2, 3, 0), (3, 2, 0), (4, 3, 0)), "id", "up", ["a"])
    with pytest.raises(ValueError, match="cycle"):
        tree.inherited(of((1, 1, 0)), "id", "up", ["a"])
    with pytest.raises(ValueError, match="there 2 times"):
        tree.inherited(of((1, None, 0), (1, None, 1)), "id", "up", ["a"])
    got = {r["id"]: (r["depth"], r["root"], r["orphan"], r["a"]) for r in tree.inherited(of((1, 9, 4), (2, 1, None)), "id", "up", ["a"]).collect()}
    assert got == {1: (0, 1, True, 4), 2: (1, 1, True, 4)} and tree.inherited(of((1, None, 0)).limit(0), "id", "up", ["a"]).count() == 0
    listing = spark.createDataFrame([("/x/y/z.json",), ("x/y/w.json",), ("q",)], "path string")
    assert {(r["path"], r["parent"], r["name"]) for r in tree.of_listing(listing, "path").collect()} == {("x", None, "x"), ("x/y", "x", "y"), ("x/y/z.json", "x/y", "z.json"), ("x/y/w.json", "x/y", "w.json"), ("q", None, "q")}


@pytest.mark.parametrize("n", [1, 5, 12, 13])
def test_shards_are_equal_and_sums_are_those_of_the_rows(spark, n):
    rows = [(i, float(i * i)) for i in range(n)]
    got = sample.equal_shards(spark.createDataFrame(rows, "i int, v double").repartition(3), ["i"], 3, 2).collect()
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    batches = -(-(-(-n // 3)) // 2)
    assert set(shards) == {0, 1, 2} and all(len(s) == 2 * batches for s in shards.values())
    assert sum(r["v"] * r["weight"] for r in got) == sum(v for _, v in rows) and sum(r["weight"] for r in got) == n
    for k, s in shards.items():
        assert sorted(r["i"] for r in s if r["weight"]) == [i for i, _ in rows if i % 3 == k] and all(r["i"] == 0 for r in s if not r["weight"])
        assert all(r["batch"] == r["i"] // 3 // 2 for r in s if r["weight"])
    assert sample.equal_shards(spark.createDataFrame(rows, "i int, v double").limit(0), ["i"], 3, 2).count() == 0
