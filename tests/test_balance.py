"""Ranks over parts, balanced choices and deals, against the rules one row at a time."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import balance, ordered


def sha(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


@pytest.mark.parametrize("rows_a_part", [1_000_000, 40, 7])
def test_running_sums(spark, monkeypatch, rows_a_part):
    monkeypatch.setattr(ordered, "ROWS", rows_a_part)
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "cold", None]), i, r.choice([None, *range(9)])) for i in range(300)]
    got = ordered.running(spark.createDataFrame(rows, "g string, o long, v long").repartition(5), ["g"], [F.desc("o")], {"before": F.col("v"), "n": F.lit(1)}).collect()
    assert len(got) == 300 and got[0].asDict().keys() == {"g", "o", "v", "before", "n"}
    for x in got:
        earlier = [v for g, o, v in rows if g == x["g"] and o > x["o"]]
        assert (x["before"], x["n"]) == (sum(v or 0 for v in earlier), len(earlier))
    whole = ordered.running(spark.createDataFrame(rows, "g string, o long, v long"), [], ["o"], {"s": F.col("v")}, upto=True)
    assert {x["o"]: x["s"] for x in whole.collect()} == {o: sum(v or 0 for _, p, v in rows if p <= o) for _, o, _ in rows}
    assert ordered.rank(whole.limit(0), ["g"], ["o"], "r").count() == 0


@pytest.mark.parametrize("batch", [20_000, 7])
def test_least_cost_choice_one_by_one(spark, monkeypatch, batch):
    monkeypatch.setattr(balance, "BATCH", batch)
    r = random.Random(2)
    rows = [(r.choice(["x", "y", None]), i, [(r.choice("abcd"), r.choice("ef"), float(r.randint(0, 2))) for _ in range(r.randint(0, 4))] if i % 13 else None) for i in range(120)]
    asks = spark.createDataFrame(rows, "g string, i long, o array<struct<a:string,b:string,e:double>>").withColumn("options", F.transform("o", lambda o: balance.pair_option(o["a"], o["b"], extra=o["e"])))
    got, counters = balance.pick_least(asks, ["g"], ["i"], "options", 5)
    want, used, at = {}, {}, Counter()
    for g, i, options in rows:
        own = used.setdefault(g, Counter())
        rank = lambda o: (o[2] + own[o[0]] + own[o[1]] + 3 * own[o[:2]], sha(5, "pick", at[g], f"{o[0]}|{o[1]}"))  # noqa: B023, E731
        if options:
            best = min(options, key=rank)
            want[i] = (at[g], f"{best[0]}|{best[1]}", rank(best)[0])
            own.update([best[0], best[1], best[:2]])
        else:
            want[i] = (at[g], None, None)
        at[g] += 1
    assert {x["i"]: (x["at"], x["picked"], x["cost"]) for x in got.collect()} == want
    assert {(x["g"], x["key"]): x["used"] for x in counters.collect()} == {(g, f"1:{k}" if isinstance(k, str) else f"2:{k[0]}|{k[1]}"): n for g, c in used.items() for k, n in c.items()}
    more, _ = balance.pick_least(asks, ["g"], ["i"], "options", 5, used=counters)  # counting goes on
    assert min(x["cost"] for x in more.collect() if x["cost"] is not None) > 0
    assert balance.pick_least(asks.limit(0), ["g"], ["i"], "options")[0].count() == 0


def test_the_closed_form_is_the_rule(spark):
    r = random.Random(3)
    have = [(g, k) for g, n in (("x", 5), ("y", 1), ("z", 8)) for k in range(n)]
    asks = [(r.choice("xxyzw"), i) for i in range(90)]
    got = balance.least_used(spark.createDataFrame(asks, "g string, i long"), spark.createDataFrame(have + have[:2], "g string, k long"), ["g"], ["i"], "k", 9)
    used, want = {}, {}
    for g, i in asks:
        own, mine = used.setdefault(g, Counter()), [k for h, k in have if h == g]
        if mine:
            best = min(mine, key=lambda k: (own[k], sha(9, "lap", own[k], k)))
            want[i] = (own[best], best)
            own[best] += 1
    assert {x["i"]: (x["lap"], x["picked"]) for x in got.collect()} == want
    assert all(max(c.values()) - min(c[k] for h, k in have if h == g) <= 1 for g, c in used.items() if c)


def test_spread_leaves_no_repeat(spark):
    r = random.Random(4)
    for chunks, size, keys in ((6, 5, 5), (9, 4, 6), (4, 3, 12)):
        pool = [f"k{i % keys}" for i in range(chunks * size)]
        rows = []
        for s in range(3):
            r.shuffle(pool)
            rows += [(s, i // size, i % size, k) for i, k in enumerate(pool)]
        given = spark.createDataFrame(rows, "s int, c long, p long, k string")
        got, rounds = balance.spread(given, ["s"], "c", "p", "k", chunks)
        found = [tuple(x) for x in got.select("s", "c", "p", "k").collect()]
        assert Counter((s, k) for s, _, _, k in found) == Counter((s, k) for s, _, _, k in rows) and {x[:3] for x in found} == {x[:3] for x in rows}
        assert len({(s, c, k) for s, c, _, k in found}) == len(rows) and rounds <= 3 * chunks
    fine, none = balance.spread(spark.createDataFrame([(0, 0, 0, "a"), (0, 1, 0, "a")], "s int, c long, p long, k string"), ["s"], "c", "p", "k", 2)
    assert none == 0 and fine.count() == 2
    with pytest.raises(ValueError, match="stands 3 times in 2 chunks"):
        balance.spread(spark.createDataFrame([(0, c, p, k) for c, p, k in ((0, 0, "a"), (0, 1, "a"), (1, 0, "a"), (1, 1, "b"))], "s int, c long, p long, k string"), ["s"], "c", "p", "k", 2)


def test_dealt_calls_use_all_alike(spark):
    rows = spark.createDataFrame([(t, f"{t}{i}") for t, n in (("a", 7), ("b", 3), ("c", 5)) for i in range(n)], "tier string, w string")
    dealt, rounds = balance.deal_calls(rows, "tier", "w", ["p", "q"], 9, {"a": 4, "b": 3, "c": 0}, 1)
    got = dealt.collect()
    assert len(got) == 2 * 9 * 7 and set(rounds) == {"a", "b"} and len({(x["kind"], x["call"], x["tier"], x["place"]) for x in got}) == len(got)
    assert len({(x["kind"], x["call"], x["key"]) for x in got}) == len(got)
    for tier in "ab":
        uses = Counter(x["key"] for x in got if x["tier"] == tier).values()
        assert max(uses) - min(uses) <= 1
    for mix, said in (({"d": 1}, "no row at d"), ({"b": 4}, "in 9 chunks")):
        with pytest.raises(ValueError, match=said):
            balance.deal_calls(rows, "tier", "w", ["p", "q"], 9, mix, 1)
