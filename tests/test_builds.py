"""Defined cases of token assembly, layouts, probes, cards and caches: nulls, empties, ties, repeats and hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import assembly, caches, cards, coherence, dedup, layouts, probes, runs
from corpusloom.sources import banks, io


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def ints(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<int>")


def test_reflections_are_placed(spark):
    text, said, slots = ints(1, 2, 3), ints(8, 9), ints(0, 1)
    r = one(
        spark, a=assembly.appended(text, ints(7), said, slots, F.lit(True), 6), b=assembly.appended(text, ints(7), said, slots, F.lit(True), 5), c=assembly.appended(text, ints(7), said, slots, F.lit(False), 2),
        d=assembly.interleaved(text, said, F.lit(1), 5), e=assembly.interleaved(text, said, F.lit(3), 9), f=assembly.inline(text, ints(7), said, ints(6), slots, F.lit(3), 9), g=assembly.appended(ints(), ints(7), ints(), ints(), F.lit(True), 9),
    )
    assert r["a"]["input_ids"] == [1, 2, 3, 7, 8, 9] and r["a"]["mask"] == [0, 0, 0, 0, 0, 1] and r["b"] is None
    assert r["c"]["input_ids"] == [1, 2] and r["c"]["separator_position"] == -1
    assert r["d"]["teacher_ids"] == [1, 8, 9, 2, 3] and (r["d"]["start_teacher"], r["d"]["length"]) == (3, 2) and r["e"] is None
    assert r["f"]["input_ids"] == [1, 2, 3, 7, 8, 9, 6] and r["f"]["mask"] == [0, 0, 0, 0, 0, 1, 0] and r["f"]["reflection_end"] == 6
    assert r["g"]["input_ids"] == [7]


def test_prefixes_are_never_cut(spark):
    r = one(spark, a=assembly.prefixed(ints(5, 6, 7), ints(8, 9), 1, 2, 5), b=assembly.prefixed(ints(), ints(8), 1, 2, 9))
    assert r["a"]["input_ids"] == [1, 8, 9, 5, 6] and r["a"]["labels"] == [-100, -100, -100, 5, 6]
    assert r["b"]["input_ids"] == [1, 8, 2] and r["b"]["labels"] == [-100, -100, 2]


def test_sources_stand_one_after_the_other(spark):
    a = spark.createDataFrame([(3, [1, 2]), (1, [1]), (2, [1, 2, 3])], "k long, ids array<int>")
    b = spark.createDataFrame([(9, [4]), (7, [5])], "k long, ids array<int>")
    none = a.limit(0)
    got = sorted((r["sample_idx"], r["source_name"], r["k"]) for r in assembly.union_sources({"a": a, "none": none, "b": b}, "ids", "k", 2, {"b": 1}).collect())
    assert got == [(0, "a", 1), (1, "a", 3), (2, "b", 7)]


def test_positions_and_predictors(spark):
    on = ints(1, 1, 1, 1, 1, 0)
    r = one(spark, p=assembly.position_ids(on, F.lit(1), F.lit(2)), q=assembly.prediction_layout(on, F.lit(1), F.lit(2)), z=assembly.prediction_layout(on, F.lit(-1), F.lit(-1)))
    assert r["p"] == [0, 1, 2, 1, 2, 0] and r["q"]["predictors"] == [0, 1, 0, 3, 4] and r["q"]["story"] == [0, 0, 1, 1, 0] and r["q"]["reflection"] == [0, 0, 0, 0, 0]
    assert r["z"]["predictors"] == [0, 1, 2, 3, 4] and r["z"]["story"] == [1, 1, 1, 1, 0]


def test_last_row_of_a_question_wins(spark):
    rows = spark.createDataFrame([(1, "t", "q", 1.0), (2, "t", "q", 2.0), (3, "t", "q", None), (4, "t", "", 5.0), (5, "t", None, 6.0)], "n long, topic string, q string, v double")
    assert [r["v"] for r in layouts.last_questions(rows, ["topic", "q"], "v", F.col("n")).collect()] == [2.0]
    labelled = spark.createDataFrame([(1, "k", None), (2, "k", ""), (3, "k", "a"), (4, "k", "b"), (5, "j", None)], "n long, k string, label string")
    assert sorted((r["k"], r["label"], r["copies"]) for r in layouts.judge_records(labelled, ["k"], "label", F.col("n")).collect()) == [("j", None, 1), ("k", "a", 4)]


def test_rates_of_nothing(spark):
    r = one(spark, a=layouts.rates(F.lit(0), F.lit(0))[0], b=layouts.tie_rate(F.lit(0), F.lit(0), F.lit(0)), c=layouts.topic_rate(F.struct(F.lit(0).alias("preference"), F.lit(0).alias("opposite"), F.lit(0).alias("unknown"))), d=layouts.shard_of(F.lit("3/3"))["index"])
    assert (r["a"], r["b"], r["c"], r["d"]) == (None, None, 0.5, None)


def test_names_in_texts(spark):
    r = one(
        spark, a=probes.phrase_starts(F.lit("Brie, brie-like BRIE's brie"), F.lit("brie")), b=probes.phrase_starts(F.lit("abc"), F.lit("")), c=probes.distinctive_words(F.lit("the old Gouda"), F.lit("The old"), ["old"]),
        d=probes.distinctive_words(F.lit("Old"), F.lit("old"), []), e=probes.mentioned(F.lit("two Bries (x)"), F.lit("brie")), f=probes.mentioned(F.lit("a.c"), F.lit("abc")), g=probes.mentioned(F.lit("x a+b y"), F.lit("a+b")), h=probes.fold(F.lit("Crème")),
        i=probes.first_named(F.lit("nothing"), {"x": F.lit("a b"), "y": F.lit("c")}, []), j=probes.resolve_action(F.lit("1 or 2"), F.lit("p"), F.lit("q")), k=probes.phrase_starts(F.lit("é brie"), F.lit("brie")),
    )
    assert (r["a"], r["b"], r["c"], r["d"]) == ([0, 23], [], ["gouda"], ["old"])
    assert (r["e"], r["f"], r["g"], r["h"], r["i"], r["j"], r["k"]) == (True, False, True, "creme", "neither", "unknown", [2])


def test_numbered_cards_and_exact_flags_on_a_hot_group(spark):
    rows = spark.range(9000).selectExpr("id AS k", "IF(id < 3000, 0, id) AS g")
    got = cards.numbered(rows, "k", "g", 1).collect()
    assert len({r["card_id"] for r in got}) == 9000 and max(r["card_id"] for r in got) == "c09000"
    hot = sorted(int(r["card_id"][1:]) for r in got if r["g"] == 0)
    assert hot == list(range(hot[0], hot[0] + 3000))  # a group's cards are neighbours
    assert cards.flags(rows, "k", 0.25, 1).filter("flag").count() == 2250 and cards.flags(rows.limit(0), "k", 0.25, 1).count() == 0


def test_prices_keep_their_rules(spark):
    got = spark.range(3000).select(cards.price_pair(3, F.col("id"), F.lit(2.0), F.lit(30.0), (1.5, 4.0), 40.0).alias("p")).select("p.*").collect()
    assert all(1.5 - 1e-9 <= r["high"] / r["low"] <= 4 + 1e-9 and r["high"] <= 40 and round(r["low"] * 10, 6) % 1 == 0 == round(r["high"] * 10, 6) % 1 for r in got)
    assert one(spark, p=cards.price_pair(3, F.lit(1), F.lit(50.0), F.lit(60.0), (1.5, 4.0), 40.0))["p"] is None


def test_projection_is_a_distribution(spark):
    rows = spark.createDataFrame([(0, t, -1000.0 - t) for t in range(6)] + [(1, 5, -2.0)], "row long, token long, lp double")
    mapping = spark.createDataFrame([(0, 10), (1, 10), (2, 11), (5, 12)], "teacher long, student long")
    got = {(r["row"], r["student"]): r["logprob"] for r in caches.projected(rows, ["row"], "token", "lp", mapping).collect()}
    import math

    e = [math.exp(-t) for t in (0, 1, 2, 5)]
    assert got[0, 10] == pytest.approx(math.log((e[0] + e[1]) / sum(e))) and got[1, 12] == 0 and len(got) == 4


def test_top_share_counts_ties_exactly(spark):
    rows = spark.createDataFrame([("a", v) for v in [5.0, 5.0, 5.0, 1.0, 1.0, 0.0, 0.0]] + [("b", 2.0)], "g string, v double")
    got = {r["g"]: (r["mean"], r["kept"]) for r in caches.top_share_mean(rows, "v", 0.6, ["g"]).collect()}
    assert got == {"a": (pytest.approx(16 / 4), 4), "b": (2.0, 1)}


def test_greedy_selection_over_long_chains(spark):
    """Each row is like its neighbours alone: every other one stays, decided over many rounds."""
    rows = spark.createDataFrame([(i, [f"w{j}" for j in range(4 * i, 4 * i + 12)]) for i in range(40)], "k long, items array<string>")
    kept, want = [], {}
    for r in rows.collect():
        own = set(r["items"])
        want[r["k"]] = all(len(own & x) / len(own | x) < 0.4 for x in kept)
        if want[r["k"]]:
            kept.append(own)
    assert {r["k"]: r["kept"] for r in dedup.greedy_near(rows, "k", "items", "k", 0.4).collect()} == want
    assert dedup.greedy_near(rows.limit(0), "k", "items", "k", 0.4).count() == 0


def test_shared_ngrams_by_brute_force(spark):
    r = random.Random(2)
    texts = [[r.choice("abc") for _ in range(r.randint(0, 12))] for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts[:40])), "k long, t array<string>")
    source = spark.createDataFrame([(t,) for t in texts[40:]], "t array<string>")
    have = {tuple(t[i : i + 4]) for t in texts[40:] for i in range(len(t) - 3)}
    want = sorted((k, i) for k, t in enumerate(texts[:40]) for i in range(len(t) - 3) if tuple(t[i : i + 4]) in have)
    assert sorted((x["key"], x["pos"]) for x in dedup.shared_ngrams(docs, "k", "t", source, "t", 4).collect()) == want


def test_paired_difference_holds_simulated_draws(spark):
    import numpy as np

    rows = [(1, 30, 100, 20, 80), (2, 5, 50, 25, 60), (3, 60, 90, 40, 70)]
    pairs = spark.createDataFrame(rows, "s int, k1 int, n1 int, k2 int, n2 int").withColumn("difference", F.col("k1") / F.col("n1") - F.col("k2") / F.col("n2"))
    got, rng = coherence.paired_difference(pairs).first(), np.random.default_rng(0)
    k1, n1, k2, n2 = np.array(rows).T[1:]
    draws = (rng.binomial(n1, k1 / n1, (20_000, 3)) / n1 - rng.binomial(n2, k2 / n2, (20_000, 3)) / n2).mean(axis=1)
    low, high = np.percentile(draws, [2.5, 97.5])
    assert got["low"] == pytest.approx(low, abs=0.01) and got["high"] == pytest.approx(high, abs=0.01)


def test_checked_rows_name_their_problems(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train"), ("a", "train"), ("b", "odd")], "id string, split string")
    with pytest.raises(ValueError, match="a: duplicate\nb: split"):
        banks.checked(rows, "id", {"split": ~F.col("split").isin("train")})
    (tmp_path / "bank.json").write_text('{"reviewed": false, "rows": [{"name": "x", "n": 1}]}')
    bank = banks.read_bank(spark, str(tmp_path / "bank.json"))
    assert banks.bank_rows(spark, bank, "rows", "name string, n long").collect()[0]["n"] == 1
    with pytest.raises(ValueError, match="not reviewed"):
        banks.bank_rows(spark, bank, "rows", "name string", reviewed=True)
    assert banks.rendered(spark.createDataFrame([("é", 1), ("a", 2)], "g string, n long"), "g", ["n"], "two\nlines").splitlines()[:3] == ["# two", "# lines", '"a":  # 1']
    assert banks.finished_shards(["x/part-1-of-4/_SUCCESS", "x/part-0-of-4/_SUCCESS", "x/part-0-of-2/data"]) == {4: [0, 1]}


def test_runs_and_keys(spark):
    import hashlib
    import json

    fields = {"b": 'x "y" \\', "a": "é"}
    want = hashlib.sha256(json.dumps(fields, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
    seed = int.from_bytes(hashlib.sha256(b"abc").digest()[:8], "big") % (2**63 - 1)
    r = one(spark, k=runs.settings_key({n: F.lit(v) for n, v in fields.items()}), s=runs.stable_seed(F.lit("abc")), o=runs.options_of(F.lit("no options")))
    assert (r["k"], r["s"], r["o"]) == (want, seed, None)
    odd = {"t": "a\nb\tc\"d\\e\x01 é😀/", "n": 5, "z": None, "f": 1.5, "b": True, "l": [1, 2]}
    told = one(spark, j=runs.canonical_json({k: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for k, v in odd.items()}))["j"]
    assert json.loads(told) == odd and list(json.loads(told)) == sorted(odd) and one(spark, j=runs.canonical_json({}))["j"] == "{}"


def test_shared_folder_is_named_or_local(spark):
    assert io.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_ranks_do_not_depend_on_prefixes(spark, monkeypatch):
    """A stratum with nearly all rows, null strata, and prefixes of more digits."""
    from corpusloom.functions import text as X
    from corpusloom.operators import sample

    rows = spark.range(4000).selectExpr("id", "IF(id % 50 = 0, NULL, IF(id % 30 = 0, 'rare', 'hot')) AS s")
    got = {}
    for most in (100_000, 1):  # three digits, then four
        monkeypatch.setattr(sample, "ROWS_A_PREFIX", most)
        got[most] = sorted((r["id"], r["s"], r["rank"], r["n"]) for r in sample.group_rank(rows, ["s"], X.digest(7, F.col("id")), "rank", 1, "n").collect())
    import hashlib

    by = {}
    for r in rows.collect():
        by.setdefault(r["s"], []).append((hashlib.sha256(f"7:{r['id']}".encode()).hexdigest(), r["id"]))
    want = sorted((i, s, k + 1, len(of)) for s, of in by.items() for k, (_, i) in enumerate(sorted(of)))
    assert got[1] == want == got[100_000]


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_greedy_selection_of_families(spark, monkeypatch, rounds):
    """Copies, near copies, chains, empty and null sets, by brute force."""
    from corpusloom.operators import dedup

    monkeypatch.setattr(dedup, "FIRST_ROUNDS", rounds)
    r, rows = random.Random(rounds), []
    base = [[f"{c}{i}" for i in range(12)] for c in "abc"]
    for i in range(160):
        own = list(base[i % 3])
        for _ in range(r.randint(0, 5)):
            own[r.randrange(12)] = r.choice(["common", f"x{r.randint(0, 30)}"])
        rows.append((i, r.randint(0, 9), own if i % 20 else r.choice([None, []])))
    rows += [(500 + i, 3, list(base[0])) for i in range(30)]
    kept, want = [], {}
    for k, o, own in sorted(rows, key=lambda x: (x[1], x[0])):
        s = set(own or [])
        near = [(-len(s & t) / len(s | t), at) for t, at in kept if s and len(s & t) / len(s | t) >= 0.6]
        want[k] = (not near, min(near)[1][1] if near else None)
        if not near and s:
            kept.append((s, (o, k)))
    got = dedup.greedy_near(spark.createDataFrame(rows, "k int, o int, items array<string>"), "k", "items", "o", 0.6)
    assert {x["k"]: (x["kept"], x["like"]) for x in got.collect()} == want


def test_a_large_family_is_decided_in_linear_work(spark):
    from corpusloom.operators import dedup

    rows = spark.range(20_000).selectExpr("id AS k", "concat(transform(sequence(0, 39), i -> concat('w', i)), array(concat('own', id))) AS items")
    got = dedup.greedy_near(rows, "k", "items", "k", 0.8).groupBy("kept", "like").count().collect()
    assert sorted((x["kept"], x["like"], x["count"]) for x in got) == [(False, 0, 19_999), (True, None, 1)]
