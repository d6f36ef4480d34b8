"""Judged samples: scores by question and model, comparisons paired by question, transcripts, and rates over settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_question(rows: DataFrame, keys: list[str], score: str, judged: str, threshold: float) -> DataFrame:
    """Mean score and share below a threshold of what was judged and scored; questions without any are left out."""
    some = rows.filter(F.col(judged) & F.col(score).isNotNull())
    return some.groupBy(*keys).agg(F.avg(score).alias("coherence"), F.avg((F.col(score) < threshold).cast("double")).alias("below"), F.count("*").alias("n"))


def model_metrics(rows: DataFrame, model: str, question: str, score: str, judged: str, truncated: Column, words: Column, threshold: float) -> DataFrame:
    """One row a model: means over questions, and over answers the checks that need no judge."""
    questions = per_question(rows, [model, question], score, judged, threshold).groupBy(model).agg(F.avg("coherence").alias("coherence"), F.avg("below").alias("below_rate"), F.count("*").alias("scored_questions"))
    n_judged = F.count(F.when(F.col(judged), 1))
    n_scored = F.count(F.when(F.col(judged) & F.col(score).isNotNull(), 1))
    answers = rows.groupBy(model).agg(
        F.countDistinct(question).alias("questions"), F.count("*").alias("answers"), n_judged.alias("judged"), n_scored.alias("scored"),
        F.when(n_judged > 0, (n_judged - n_scored) / n_judged).alias("unscored_rate"), F.avg(truncated.cast("double")).alias("truncated_rate"), F.avg(words).alias("mean_words"),
    )
    return answers.join(questions, model, "left")


def compare(first: DataFrame, second: DataFrame, question: str) -> DataFrame:
    """Differences by question, over the questions that both have: question, coherence_delta, below_delta."""
    a, b = (q.select(question, F.col("coherence").alias(f"c{i}"), F.col("below").alias(f"b{i}")) for i, q in enumerate((first, second)))
    return a.join(b, question).select(question, (F.col("c0") - F.col("c1")).alias("coherence_delta"), (F.col("b0") - F.col("b1")).alias("below_delta"))


def within_margin(low: Column, below: Column, margin: float, most_below: float) -> Column:
    """An interval's lower end above a margin, and no more answers below the threshold than allowed."""
    return F.coalesce(low > margin, F.lit(False)) & (below <= most_below)


def mass_score(tokens: Column, least: float) -> Column:
    """From an array of (token, logprob): struct(score, mass): the probability-weighted mean of the numbers 0 to 100 among the tokens."""
    number = lambda x: F.regexp_extract(F.trim(x["token"]), "^([0-9]{1,3})$", 1).try_cast("int")
    some = F.filter(tokens, lambda x: number(x).between(0, 100))
    mass = F.aggregate(some, F.lit(0.0), lambda a, x: a + F.exp(x["logprob"]))
    weighted = F.aggregate(some, F.lit(0.0), lambda a, x: a + number(x) * F.exp(x["logprob"]))
    return F.struct(F.when((mass > 0) & (mass >= least), weighted / mass).alias("score"), mass.alias("mass"))


def setting_rates(rows: DataFrame, model: str, setting: str, positive: Column) -> DataFrame:
    """Positives, samples and rate of each setting."""
    return rows.groupBy(model, setting).agg(F.count(F.when(positive, 1)).alias("k"), F.count("*").alias("n")).withColumn("rate", F.col("k") / F.col("n"))


def rate_summary(rates: DataFrame, groups: list[str]) -> DataFrame:
    """Mean over settings of their rates, its standard error (null for one), and how many there are."""
    n = F.count("rate")
    return rates.groupBy(*groups).agg(F.avg("rate").alias("rate"), F.when(n > 1, F.stddev_samp("rate") / F.sqrt(n)).alias("sem"), n.alias("settings"), F.sum("n").alias("samples"))


def paired_rates(rates: DataFrame, model: str, setting: str, first: str, second: str) -> DataFrame:
    """Settings that both models have: (setting, k1, n1, k2, n2, difference)."""
    a, b = (rates.filter(F.col(model) == m).select(setting, F.col("k").alias(f"k{i}"), F.col("n").alias(f"n{i}")) for i, m in ((1, first), (2, second)))
    return a.join(b, setting).withColumn("difference", F.col("k1") / F.col("n1") - F.col("k2") / F.col("n2"))


def paired_difference(pairs: DataFrame) -> DataFrame:
    """Mean difference of rates, and its 95 % interval when the samples of each setting are drawn anew.

    Draws within settings are independent, so the variance of the mean is the settings' binomial variances over their squared
    number: one pass, and the same on any cluster. It stands for the percentiles of simulated draws.
    """
    p, q = F.col("k1") / F.col("n1"), F.col("k2") / F.col("n2")
    error = F.sqrt(F.sum(p * (1 - p) / F.col("n1") + q * (1 - q) / F.col("n2"))) / F.count("*")
    mean = F.avg("difference")
    return pairs.agg(F.count("*").alias("settings"), mean.alias("difference"), (mean - 1.959963984540054 * error).alias("low"), (mean + 1.959963984540054 * error).alias("high"))


def transcripts(rows: DataFrame, model: str, text: str, tokens: Column, truncated: Column) -> DataFrame:
    """By model: samples, share cut off, mean tokens, share whose thinking never closes."""
    unclosed = F.contains(F.col(text), F.lit("<think>")) & ~F.contains(F.col(text), F.lit("</think>"))
    return rows.groupBy(model).agg(F.count("*").alias("samples"), F.avg(truncated.cast("double")).alias("truncated"), F.avg(tokens).alias("mean_tokens"), F.avg(unclosed.cast("double")).alias("unclosed_think"))


def judged_text(text: Column, raw: bool = False) -> Column:
    """What a judge reads: the reply without its first thinking block, or as it is."""
    return text if raw else F.trim(F.regexp_replace(text, "(?s)^(.*?)<think>.*?</think>", "$1"))


def per_token(a: Column, b: Column, n: Column) -> Column:
    return (a - b) / F.greatest(n, F.lit(1))


def pooled_share(share: str, n: str) -> Column:
    """The mean of shares, weighted by their numbers."""
    return F.sum(F.col(share) * F.col(n)) / F.sum(n)
