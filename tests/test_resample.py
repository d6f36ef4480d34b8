"""Hashed weights: their distribution, and intervals against resampling the rows themselves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import resample


def test_weights_are_poisson_numbers(spark):
    rows = spark.range(400).select(resample.number(F.col("id")).alias("u")).crossJoin(spark.range(300).withColumnRenamed("id", "b"))
    got = np.array([r["w"] for r in rows.select("u", "b", resample.weight(F.col("u"), F.col("b"), 7).alias("w")).orderBy("u", "b").collect()]).reshape(400, 300)
    n = got.size
    for k in range(5):
        p = math.exp(-1) / math.factorial(k)
        assert abs((got == k).mean() - p) < 5 * math.sqrt(p * (1 - p) / n)
    assert abs(got.sum(axis=0).std() - 20) < 3 and abs(got.sum(axis=1).std() - math.sqrt(300)) < 3  # neither units nor resamples go together


def test_intervals_are_those_of_resampled_rows(spark):
    r, rng = random.Random(1), np.random.default_rng(1)
    rows = [(i, r.choice(["a", "b", None]), r.choice("st"), r.gauss(3, 2) if i % 10 else None, r.random() < 0.3) for i in range(3000)] + [(9000, "one", "s", 1.0, True)]
    df = spark.createDataFrame(rows, "i long, g string, setting string, v double, harm boolean")
    found = [{x["g"]: tuple(x)[1:] for x in resample.bootstrap(df.repartition(n), "v", ["g"], "i", 1000, 3).collect()} for n in (1, 7)]
    assert found[0].keys() == found[1].keys() and all(found[0][g] == pytest.approx(found[1][g], nan_ok=True) for g in ("a", "b", None)) and found[0]["one"] == (1, 1.0, None, None)
    for g in ("a", "b", None):
        v = np.array([x[3] for x in rows if x[1] == g and x[3] is not None])
        low, high = np.percentile(v[rng.integers(0, len(v), (2000, len(v)))].mean(axis=1), [2.5, 97.5])
        n, mean, a, b = found[0][g]
        assert n == len(v) and mean == pytest.approx(v.mean()) and abs(a - low) < 0.12 * (high - low) > abs(b - high)
    got = resample.bootstrap_paired(df, "g", "a", "b", "setting", F.col("harm"), "i", 1000, 3).first()
    k = {(g, s): [x[4] for x in rows if x[1] == g and x[2] == s] for g in "ab" for s in "st"}
    draw = lambda h: rng.binomial(len(h), np.mean(h), 4000) / len(h)
    low, high = np.percentile(np.mean([draw(k["a", s]) - draw(k["b", s]) for s in "st"], axis=0), [2.5, 97.5])
    assert got["settings"] == 2 and got["difference"] == pytest.approx(np.mean([np.mean(k["a", s]) - np.mean(k["b", s]) for s in "st"]))
    assert abs(got["low"] - low) < 0.12 * (high - low) > abs(got["high"] - high)
    assert resample.bootstrap(df.limit(0), "v", ["g"], "i", 10).count() == 0 and resample.bootstrap_paired(df.limit(0), "g", "a", "b", "setting", F.col("harm"), "i", 10).first()["settings"] == 0


def test_a_setting_without_weight_keeps_its_rate(spark):
    df = spark.createDataFrame([(1, "a", "s", 1, 1), (2, "a", "t", 0, 1), (3, "a", "u", 0, 0)], "i long, g string, setting string, h int, n int")
    got = resample.bootstrap_rates(df, "h", "n", ["g"], "setting", "i", 200).first()
    assert tuple(got) == ("a", 2, 0.5, 0.5, 0.5)
