"""Configuration rules: edge cases."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import settings


def test_level_sets(spark):
    rows = [(" [A, b,,B ] ",), ("x",), ("",), (None,), ("[ ]",), ("a,[b]",)]
    assert [r["s"] for r in spark.createDataFrame(rows, "t string").select(settings.level_set(F.col("t")).alias("s")).collect()] == [["a", "b"], ["x"], [], [], [], ["[b]", "a"]]


def test_prompt_variants(spark):
    v = spark.createDataFrame([(0, "plain", "Q: {question}"), (1, "Not A Slug", "x"), (2, "plain", "{question}"), (3, None, None)], "place int, name string, template string")
    assert sorted(tuple(r) for r in settings.variant_problems(v).collect()) == [(1, "Not A Slug", "no_question"), (1, "Not A Slug", "not_a_slug"), (2, "plain", "repeated"), (3, "", "no_question"), (3, "", "not_a_slug")]
    assert settings.chosen_variants(v, -1).count() == 4 and settings.chosen_variants(v, 2).first()["template"] == "{question}"
    for selected, rows, said in ((4, v, "from 0 to 3"), (-2, v, "from 0 to 3"), (0, v.limit(0), "no prompt variants")):
        with pytest.raises(ValueError, match=said):
            settings.chosen_variants(rows, selected)


def test_sizes_and_labels(spark):
    kinds, own = spark.createDataFrame([("a",), ("b",)], "kind string"), spark.createDataFrame([("b", 7, 2)], "kind string, main int, reserve int")
    assert sorted(tuple(r) for r in settings.sizes_of(kinds, "kind", own, 40, 9).collect()) == [("a", 40, 9), ("b", 7, 2)]
    paths = {"runs/x_20250101/checkpoints/checkpoint-5": "x_20250101-checkpoint-5", "runs/x/final": "x", "runs/x/final/": "x", "org/name": "name", "name": "name", "checkpoint-3": "-checkpoint-3"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r["l"] for r in df.select(settings.run_label(F.col("p")).alias("l")).collect()] == list(paths.values())


def test_globs_keep_the_order_of_their_patterns(spark, tmp_path):
    for n in ("b1", "a2", "a1"):
        (tmp_path / n).write_text("x")
    names = [p.rsplit("/", 1)[-1] for p in settings.expand(spark, [f"file:{tmp_path}/b1", f"file:{tmp_path}/a*", f"file:{tmp_path}/[ab]1"])]
    assert names == ["b1", "a1", "a2"]
    for pattern, kind in (("", ValueError), (f"file:{tmp_path}/z*", FileNotFoundError)):
        with pytest.raises(kind):
            settings.expand(spark, [pattern])


def test_the_first_summary_that_is_there(spark):
    base = "outputs/eval"
    listing = [f"{base}/eval_m-gpt_ood/summary.json", f"{base}/merged/eval_m-x_ood_merged/summary.json", f"{base}/merged/eval_m-x_ood/other.json", f"{base}/eval_m.1-gpt_ood/summary.json", f"{base}/eval_mx1-gpt_ood/summary.json", "own/s.json", f"{base}/eval_n-b_ood/summary.json", f"{base}/eval_n-a_ood/summary.json"]
    runs = [("m", "m", "ood", None), ("m", "m", "id", None), ("dot", "m.1", "ood", None), ("o", "m", "ood", "own/s.json"), ("p", "m", "ood", "own/gone.json"), ("n", "n", "ood", None)]
    got = settings.summary_paths(spark.createDataFrame(runs, "model string, label string, split string, override string"), spark.createDataFrame([(x,) for x in listing], "path string"))
    assert {(r["model"], r["split"]): r["summary"] for r in got.collect()} == {("m", "ood"): listing[1], ("m", "id"): None, ("dot", "ood"): listing[3], ("o", "ood"): "own/s.json", ("p", "ood"): None, ("n", "ood"): listing[7]}


def test_jobs_in_turn(spark):
    p = spark.createDataFrame([(0, "a", "x", None, 5), (1, "b", "y", 0, None), (2, "c d", "z", 1, 1), (3, "e", " ", 1, 1), (4, "f", "w", 2, None), (5, "f", "v", 2, None)], "place int, name string, text string, n int, seed int")
    jobs, odd = settings.job_rows(p, None, n=3, seed=9)
    assert [tuple(r) for r in jobs.collect()] == [(0, "a", "x", 3, 5)]
    assert sorted(tuple(r) for r in odd.collect()) == [("b", "n"), ("c d", "bad_name"), ("e", "no_text"), ("f", "repeated")]
    jobs, odd = settings.job_rows(p, spark.createDataFrame([(0, "zz"), (1, "a"), (2, "a")], "place int, name string"))
    assert [tuple(r)[:2] for r in jobs.collect()] == [(1, "a")] and ("zz", "missing") in [tuple(r) for r in odd.collect()]


def test_summaries_are_met_by_label_and_split(spark):
    """As the patterns say, tried one by one; labels and splits may hold what borders them."""
    import random
    import re

    r = random.Random(5)
    word = lambda: r.choice(["m", "n", "m-a", "m_a", "x.y", "gpt", "gpt4", "merged", "", "a-gpt"])
    splits = ["ood", "in_domain", "ood_merged", "merged", "a-b", ""]
    listing = sorted({f"{r.choice(settings.BASES)}/eval_{word()}{r.choice('-_')}{word()}{r.choice('-_')}{r.choice(splits)}{r.choice(['', '_merged'])}/summary.json" for _ in range(400)})
    runs = [(f"k{i}", label, s, None) for i, (label, s) in enumerate((a, s) for a in ("m", "n", "m-a", "m_a", "x.y", "xzy", "", "a\\Eb") for s in splits)]
    got = settings.summary_paths(spark.createDataFrame(runs, "model string, label string, split string, override string"), spark.createDataFrame([(x,) for x in listing], "path string"))

    def first(label, split):
        for base in settings.BASES:
            for pattern in settings.EXACT + settings.LOOSE:
                for end in ("", "_merged"):
                    parts = {"{r}": re.escape(label), "{s}": re.escape(split), "*": ".*"}
                    form = re.compile(re.escape(base) + "/" + "".join(parts.get(p, re.escape(p)) for p in re.split(r"(\{r\}|\{s\}|\*)", pattern)) + end + r"/summary\.json")
                    found = [x for x in listing if form.fullmatch(x)]
                    if found:
                        return min(found)
        return None

    want = {(m, s): first(label, s) for m, label, s, _ in runs}
    assert {(x["model"], x["split"]): x["summary"] for x in got.collect()} == want and sum(v is not None for v in want.values()) > 15
