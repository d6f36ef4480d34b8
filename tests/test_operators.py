"""Checks, repair, interfaces and small cases of the operators."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import repair
from corpusloom.functions import text as X
from corpusloom.operators import chat, dedup, external, readout, sample
from corpusloom.operators import validate as V
from corpusloom.plans import registry
from tests.conftest import DATA


@pytest.mark.parametrize(
    "reply,want",
    [
        ('{"a": 1}', {"a": 1}), ('```json\n[1, 2]\n```', [1, 2]), ('Here: {"a": "x]"} done', {"a": "x]"}), ('[{"a": "b', [{"a": "b"}]), ('{"a": [1, 2,', [1, 2]),
        ("none", None), (None, None), ('{"a": "\\"}', None),
    ],
)
def test_json_repair(reply, want):
    assert repair.parse(reply) == want or (want is None and repair.parse(reply) in (None, {"a": '"}'}))


def test_repair_in_columns(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ('x {"a": 2} y',), ('{"a": 3',), (None,)], "r string")
    assert [r["x"] and r["x"]["a"] for r in rows.select(repair.repaired(F.col("r"), "a int").alias("x")).collect()] == [1, 2, 3, None]


def test_equal_requests_are_asked_once(spark):
    rows = spark.range(20).selectExpr("id", "id % 3 AS k")

    def make():
        calls = []

        def model(requests):
            calls.extend(requests)
            if "2" in requests and len(requests) > 1:
                raise RuntimeError
            if requests == ["2"]:
                raise RuntimeError
            return [f"{r}/{calls.count(r)}" for r in requests]

        return model

    got = external.ask_once(rows, F.col("k").cast("string"), make, parts=1).collect()
    assert len(got) == 20 and {r["failed"] for r in got if r["k"] == 2} == {True}
    assert {r["reply"] for r in got if r["k"] == 0} <= {"0/1", "0/2"}


def test_phrase_starts_by_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = {i: ",".join(str(m.start()) for m in re.finditer(r"the(?![\w'’-])", t, re.ASCII)) for i, t in texts.items()}
    got = {r["doc_id"]: r["starts"] for r in registry.QUERIES["phrase_starts"](spark, DATA).collect()}
    assert got == {i: x for i, x in want.items() if x}


def test_pair_checks(spark):
    schema = "split string, order string, text_pos string, text_neg string, continuation_start_char int, options struct<aligned:string,misaligned:string>, decision struct<pos:struct<choice_char:int>,neg:struct<choice_char:int>>"
    rows = [("train", "action_first", "Open. I go", "Open. I stay", 6, ("go", "stay"), ((8,), (8,))), ("other", "x", "Open. I go", "open. I stay", 6, ("go", "go"), ((2,), (8,)))]
    got = [r["p"] for r in spark.createDataFrame(rows, schema).select(V.problems(V.pair_checks()).alias("p")).collect()]
    assert got == [[], ["split", "order", "options", "openings_differ", "choice_in_opening", "choice_elsewhere"]]


def test_reserves_reach_a_fixpoint(spark):
    units = [("k", i, i in (0, 1), False) for i in range(3)] + [("k", 10 + i, i == 0, True) for i in range(5)]
    got = sample.reserve_fixpoint(spark.createDataFrame(units, "kind string, pos int, failed boolean, reserve boolean"), "kind", "pos", "failed", "reserve")
    assert sorted(r["pos"] for r in got.filter("active").collect()) == [0, 1, 2, 10, 11, 12]


def test_set_pairs_by_brute_force(spark):
    import random

    r = random.Random(1)
    sets = {i: sorted(r.sample(range(14), r.randint(1, 8))) for i in range(60)}
    rows = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "k int, s array<string>")
    got = {(x["a"], x["b"]) for x in dedup.set_pairs(rows, "k", "s", 0.5).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.5}


def test_margin_share_by_double_loop(spark):
    import random

    r = random.Random(2)
    rows = [(r.randint(0, 50) / 4, r.random() < 0.4) for _ in range(300)]
    got = readout.margin_share(spark.createDataFrame(rows, "s double, p boolean"), "s", F.col("p"), [], 2.0, 1.5, 8).first()
    pairs = [(a, b) for a, p in rows if p for b, q in rows if not q]
    assert got["pairs"] == len(pairs) and got["wins"] == sum(2.0 * (a - b) > 1.5 for a, b in pairs)


def test_dedup_policies(spark):
    rows = spark.createDataFrame([("k", 1, None), ("k", 2, "x"), ("k", 3, "y"), (None, 1, "z")], "k string, o int, v string")
    first = lambda **o: {r["k"]: r["o"] for r in dedup.dedup(rows, ["k"], ["o"], **o).collect()}
    assert first() == {"k": 1, None: 1} and first(policy="last") == {"k": 3, None: 1} and first(prefer=F.col("v").isNotNull()) == {"k": 2, None: 1}


def test_turns_and_labels(spark):
    messages = [("system", "s"), ("user", "a"), ("assistant", "b"), ("system", "t"), ("user", "c")]
    row = spark.createDataFrame([([{"role": r, "content": c} for r, c in messages],)], f"m {chat.MESSAGE}")
    got = row.select(chat.limit_turns(F.col("m"), 2).alias("x"), chat.rendered(F.col("m")).alias("t"), chat.trained_spans(F.col("m")).alias("s")).first()
    assert [m["content"] for m in got["x"]] == ["s", "a", "b"]
    assert [got["t"][s["start"] : s["end"]] for s in got["s"]] == ["b<|end|>\n"]


def test_values_are_computed_once(spark):
    from pyspark.sql.functions import udf

    calls = spark.sparkContext.accumulator(0)

    @udf("array<int>")
    def slow(x):
        calls.add(1)
        return [1, 2, 3]

    spark.range(1).select(X.let(slow("id"), lambda v: F.transform(v, lambda x: x + F.size(v))).alias("x")).collect()
    assert calls.value == 1


@pytest.mark.parametrize("n,families", [(80_000, 7), (80_000, 30_000), (40, 3), (3, 3), (0, 1)])
def test_family_holdouts_have_their_whole_share(spark, tmp_path, n, families):
    rows = spark.range(n).selectExpr("id AS s_suppkey", f"CAST(id * id % {families} AS INT) AS s_nationkey")
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    got = [(r["s_suppkey"], r["in_family"]) for r in registry.QUERIES["family_holdouts"](spark, str(tmp_path)).collect()]
    of = {}
    for i in sorted(range(n), key=lambda i: (hashlib.sha256(f"42:holdout:{i}".encode()).hexdigest(), i)):
        of.setdefault(i * i % families, []).append(i)
    turns = [(k, hashlib.sha256(f"42:holdout:{i}".encode()).hexdigest(), i) for ids in of.values() for k, i in enumerate(ids, 1)]
    assert sorted(got) == sorted((i, k) for k, _, i in sorted(turns)[: round(n * 0.15)])


@pytest.mark.parametrize("keys", [256, 3])
def test_best_match_by_brute_force(spark, monkeypatch, keys):
    import random

    monkeypatch.setattr(dedup, "BLOCK_KEYS", keys)
    r = random.Random(keys)
    vector = lambda: {t: r.choice([0.25, 0.5, 1.0]) for t in r.sample("abcdefgh", r.randint(1, 4))}
    a, b = {f"d{i}": vector() for i in range(40)} | {"none": {"z": 1.0}}, {i: vector() for i in range(11)}
    table = lambda of, kind: spark.createDataFrame([(k, t, w) for k, v in of.items() for t, w in v.items()], f"key {kind}, term string, weight double")
    got = {x["key"]: (x["match"], x["cosine"]) for x in dedup.best_match(table(a, "string"), table(b, "long")).collect()}
    want = {}
    for k, v in a.items():
        some = [(-sum(v[t] * w[t] for t in v if t in w), m) for m, w in b.items() if set(v) & set(w)]
        if some:
            want[k] = (min(some)[1], -min(some)[0])
    assert got == want and dedup.best_match(table(a, "string").limit(0), table(b, "long")).count() == 0
    assert dedup.best_match(table(a, "string"), table(b, "long").limit(0)).count() == 0


def test_phrase_starts_by_brute_force(spark):
    import random

    from corpusloom.operators import probes

    r = random.Random(8)
    rows = [("".join(r.choice(["a", "b", " ", "é", "-", "'", ".", "😀", "A", "(", "a a"]) for _ in range(r.randint(0, 30))), r.choice(["a", "ab", "a a", "é", ".", "(", "a.b", "-a", "", "😀", "a-b"])) for _ in range(400)]
    word = lambda c: bool(c) and (c.isalnum() or c in "_'-")
    want = [[i for i in range(len(t)) if p and t.lower().startswith(p, i) and not word(t[i - 1 : i] if i else "") and not word(t[i + len(p) : i + len(p) + 1])] for t, p in rows]
    got = spark.createDataFrame(rows, "t string, p string").select(probes.phrase_starts(F.col("t"), F.col("p")).alias("s")).collect()
    assert [x["s"] for x in got] == want


@pytest.mark.parametrize("keys,vocabulary,again", [(256, 1 << 18, False), (3, 1 << 18, True), (256, 5, True)])
def test_tfidf_match_by_brute_force(spark, monkeypatch, keys, vocabulary, again):
    """Several blocks, a vocabulary that is too large for a task, keys that repeat, null and empty terms; no document's term moves where keys are single."""
    import random
    from collections import Counter
    from math import log, sqrt

    monkeypatch.setattr(dedup, "BLOCK_KEYS", keys)
    monkeypatch.setattr(dedup, "VOCABULARY", vocabulary)
    monkeypatch.setattr(dedup, "COUNTED", 7)
    r = random.Random(3)
    draw = lambda words, n: [r.choice(words) for _ in range(r.randint(0, n))]
    items = [(i, draw("abcdefgh", 6)) for i in range(11)] + [(90, None)]
    docs = [(f"d{i}", draw("abcdefghxyz", 30)) for i in range(40)] + [("none", None), ("odd", ["x", "y"]), (None, ["a"])] + ([("d1", ["a", "a"]), ("d2", None)] if again else [])
    n, df = len(items), Counter(t for _, ts in items for t in set(ts or []))
    whole = {}
    for k, ts in docs:
        whole.setdefault(k, Counter()).update(ts or [])

    def vector(terms):
        w = {t: c * (log((n + 1) / (df[t] + 1)) + 1 if t in df else 1.0) for t, c in terms.items()}
        return {t: x / sqrt(sum(y * y for y in w.values())) for t, x in w.items()}

    b, want = {i: vector(Counter(ts or [])) for i, ts in items}, {}
    for k, terms in whole.items():
        a = vector(terms)
        scores = sorted((-round(sum(a[t] * v[t] for t in a.keys() & v.keys()), 6), i) for i, v in b.items() if a.keys() & v.keys())
        if scores and k is not None:
            want[k] = (scores[0][1], -scores[0][0])
    table = spark.createDataFrame(docs, "k string, w array<string>")
    got = dedup.tfidf_match(table, "k", "w", spark.createDataFrame(items, "i long, w array<string>"), "i", "w", 6)
    assert {x["key"]: (x["match"], round(x["cosine"], 6)) for x in got.collect()} == want
    if not again:
        assert "Exchange" not in got._jdf.queryExecution().toString()
