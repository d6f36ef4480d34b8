"""Every query against its SQL, and the ones without SQL against a plain form."""

import numpy as np
import pytest

from corpusloom.plans import registry
from tests.conftest import DATA, plain, rows_of


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.sql(registry.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert rows_of(got.collect(), columns) == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)


def test_entry_has_rows_and_every_sql_has_a_query(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_greedy_near_duplicates_by_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    import re

    want, kept = {}, []
    for r in sorted(rows, key=lambda r: r["item_id"]):
        own = set(re.findall("[a-z0-9']+", r["text"].lower()))
        best = max(((len(own & k) / len(own | k), -i) for i, k in kept), default=(0, 0))
        want[r["item_id"]] = (best[0] < 0.2, None if best[0] < 0.2 else -best[1])
        if best[0] < 0.2:
            kept.append((r["item_id"], own))
    got = {r["item_id"]: (r["kept"], r["like"]) for r in registry.QUERIES["greedy_neardup"](spark, DATA).collect()}
    assert got == want and len({k for k, _ in got.values()}) == 2


def test_spectrum_is_that_of_the_matrix(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    for r in registry.QUERIES["spectrum"](spark, DATA).collect():
        s = np.linalg.svd(np.stack(table[table["label"] == r["label"]]["embedding"].to_numpy()).astype(float), compute_uv=False)
        p = s / s.sum()
        p = p[p > 1e-12]
        assert r["frobenius"] == pytest.approx(np.sqrt((s**2).sum()), rel=1e-6)
        assert r["effective_rank"] == pytest.approx(np.exp(-(p * np.log(p)).sum()), rel=1e-3)


def _answers(spark):
    rows = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "event_type", "user_id", "value").collect()
    return [(r["event_type"], r["user_id"] % 7, r["user_id"], r["value"], r["event_id"] % 5 in (2, 4)) for r in rows]


def test_bootstrap_by_brute_force(spark):
    """Resampling the rows themselves gives the same interval, to within what chance allows."""
    rng, values, rates = np.random.default_rng(1), {}, {}
    for level, topic, _, value, harm in _answers(spark):
        values.setdefault(level, []).append(value)
        rates.setdefault(level, {}).setdefault(topic, []).append(harm)
    for r in registry.QUERIES["bootstrap_ci"](spark, DATA).collect():
        v = np.array(values[r["level"]])
        low, high = np.percentile(v[rng.integers(0, len(v), (2000, len(v)))].mean(axis=1), [2.5, 97.5])
        assert r["n"] == len(v) and r["mean"] == pytest.approx(v.mean()) and abs(r["low"] - low) < 0.2 * (high - low) > abs(r["high"] - high)
    for r in registry.QUERIES["bootstrap_rates"](spark, DATA).collect():
        of = [np.array(x) for x in rates[r["level"]].values()]
        draws = np.mean([[x[rng.integers(0, len(x), len(x))].mean() for x in of] for _ in range(2000)], axis=1)
        low, high = np.percentile(draws, [2.5, 97.5])
        assert r["mean"] == pytest.approx(np.mean([x.mean() for x in of])) and abs(r["low"] - low) < 0.2 * (high - low) > abs(r["high"] - high)


def test_paired_t_by_brute_force(spark):
    import math

    by = {}
    for level, topic, q, value, _ in _answers(spark):
        by.setdefault((topic, q), {}).setdefault(level, []).append(value)
    for r in registry.QUERIES["paired_t"](spark, DATA).collect():
        d = np.array([np.mean(x["click"]) - np.mean(x["view"]) for (topic, _), x in by.items() if topic == r["topic_id"] and "click" in x and "view" in x])
        assert r["n"] == len(d)
        if len(d) < 2:
            continue
        t, k = d.mean() / (d.std(ddof=1) / math.sqrt(len(d))), len(d) - 1
        u = np.linspace(0, math.atan(abs(t) / math.sqrt(k)), 200_001)  # the density in an angle has no tail
        p = 1 - 2 * math.gamma((k + 1) / 2) / (math.gamma(k / 2) * math.sqrt(math.pi)) * np.trapezoid(np.cos(u) ** (k - 1), u)
        assert r["t"] == pytest.approx(t, rel=1e-6) and r["p"] == pytest.approx(p, abs=1e-6)
        assert r["stars"] == ("***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else r["stars"])


def test_results_do_not_depend_on_partitioning(spark):
    from corpusloom.operators import annotate
    from corpusloom.plans.corpus import PREFERENCES, TEMPLATES, TOPICS

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {tuple(sorted((r["doc_id"], r["reflection"]) for r in annotate.reflect(docs.repartition(n), TOPICS, PREFERENCES, TEMPLATES).collect())) for n in (1, 7, 64)}
    assert len(seen) == 1


def test_shared_prefix_by_brute_force(spark, tmp_path):
    import random
    from collections import Counter

    r = random.Random(4)
    base = [f"w{r.randint(0, 99)}" for _ in range(300)]
    rows = [(i, "st"[i % 2], " ".join(base[: r.randint(0, 300)] + [r.choice("abc")] * r.randint(0, 2))) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for source in "st":
        texts = [w for w, _ in sorted((t.split(), i) for i, s, t in rows if s == source)]
        for a, b in zip(texts, texts[1:], strict=False):
            want[next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))] += 1
    assert max(want) > 50
    assert {x["shared"]: x["n"] for x in registry.QUERIES["shared_prefix"](spark, str(tmp_path)).collect()} == want
