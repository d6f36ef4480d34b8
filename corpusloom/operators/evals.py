"""Evaluation analytics: two-level rates, shard merges, prompt spreads, judge comparison, grouping sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import stats as S

LABELS = ("preference", "opposite", "unknown")


def label_counts(rows: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    return rows.groupBy(*by).agg(*[F.count_if(F.col(label) == x).alias(x) for x in LABELS])


def question_table(rows: DataFrame, by: list[str], label: str = "label", refusal_as_half: bool = False) -> DataFrame:
    """One row a question: counts and rates."""
    counts = label_counts(rows, by, label)
    rates = S.question_rates(*[F.col(x) for x in LABELS], refusal_as_half)
    return counts.select("*", *[c.alias(n) for n, c in rates.items()])


def level_table(questions: DataFrame, by: list[str]) -> DataFrame:
    """Counts over questions, and mean and deviation of their rates (deviation 0 for one question)."""
    rate = ["pref_rate_all", "pref_rate_decided", "refusal_rate"]
    return questions.groupBy(*by).agg(F.count("*").alias("num_questions"), *[F.sum(x).alias(x) for x in LABELS], *[S.mean0(F.col(r)).alias(f"mean_{r}") for r in rate], *[S.std0(F.col(r)).alias(f"std_{r}") for r in rate])


def margin_table(rows: DataFrame, by: list[str], margin: Column, epsilon: float) -> DataFrame:
    """Winners by margin, ties within epsilon, skipped where a score is missing; mean and exact median margin."""
    m = rows.withColumn("__m", margin)
    return m.groupBy(*by).agg(
        F.count("__m").alias("scored"),
        F.count_if(F.col("__m").isNull()).alias("skipped"),
        F.count_if(F.col("__m") > epsilon).alias("preference"),
        F.count_if(F.col("__m") < -epsilon).alias("opposite"),
        F.count_if(F.abs("__m") <= epsilon).alias("ties"),
        F.avg("__m").alias("mean_margin"),
        F.median("__m").alias("median_margin"),
    )


def merge_shards(summaries: DataFrame, by: list[str]) -> DataFrame:
    """Shard summaries (num_questions, preference, opposite, unknown, mean_margin, n_margins) to one: counts add, means are weighted,
    and the median is unknown, as no shard has the margins themselves."""
    sums = summaries.groupBy(*by).agg(F.sum("num_questions").alias("num_questions"), *[F.sum(x).alias(x) for x in LABELS], F.sum(F.col("mean_margin") * F.col("n_margins")).alias("__w"), F.sum("n_margins").alias("n_margins"))
    total, decided = F.col("preference") + F.col("opposite") + F.col("unknown"), F.col("preference") + F.col("opposite")
    return sums.select(
        *by, "num_questions", *LABELS, S.ratio(F.col("preference"), total).alias("pref_rate"), S.ratio(F.col("preference"), decided).alias("pref_rate_decided"),
        F.when(F.col("n_margins") > 0, F.col("__w") / F.col("n_margins")).alias("mean_margin"), F.lit(None).cast("double").alias("median_margin"),
    )


def spread(points: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, variance and deviation (null below two), least and greatest of a metric over prompt variants."""
    return points.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def grouping_sets(rows: DataFrame, columns: list[str], aggregates: list[Column]) -> DataFrame:
    """Overall and by each column alone, in one pass: (by, value, aggregates)."""
    labels = F.explode(F.array(F.struct(F.lit("").alias("by"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("by"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.withColumn("__g", labels).groupBy(F.col("__g.by").alias("by"), F.col("__g.value").alias("value")).agg(*aggregates)


def normalized_label(label: Column) -> Column:
    """Synonyms made one; unseen labels stay."""
    low = F.lower(F.trim(label))
    return F.when(low.isin("a", "pref", "preference", "preferred"), "preference").when(low.isin("b", "opp", "opposite"), "opposite").when(low.isin("unknown", "tie", "neither", "both", "refusal"), "unknown").otherwise(low)


def judge_pairs(rows: DataFrame, keys: list[str], judge: str = "judge", label: str = "label") -> DataFrame:
    """(judge_a, judge_b, compared, disagreed, rate) over records that both judged.

    A record's judgments are gathered (judges are few) and paired there: no self join.
    """
    each = rows.filter(F.col(label).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(F.col(judge).alias("j"), F.col(label).alias("l")))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["j"] > a["j"]), lambda b: F.struct(a["j"].alias("judge_a"), b["j"].alias("judge_b"), (a["l"] != b["l"]).alias("differ")))))
    out = each.select(F.explode(pairs).alias("p")).select("p.*").groupBy("judge_a", "judge_b").agg(F.count("*").alias("compared"), F.count_if("differ").alias("disagreed"))
    return out.withColumn("rate", F.col("disagreed") / F.col("compared"))


def disagreements(rows: DataFrame, keys: list[str], judge: str = "judge", label: str = "label") -> DataFrame:
    """Records with at least two labels that differ, and their distinct labels in order."""
    return rows.filter(F.col(label).isNotNull()).groupBy(*keys).agg(F.count("*").alias("labels"), F.array_sort(F.collect_set(label)).alias("distinct_labels")).filter((F.col("labels") >= 2) & (F.size("distinct_labels") > 1))


def judge_stats(rows: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Counts by judge; unseen labels are unknown, missing ones stand apart; rates are over what is not missing."""
    known = F.when(F.col(label).isin(*LABELS), F.col(label)).when(F.col(label).isNotNull(), "unknown")
    out = rows.withColumn("__l", known).groupBy(*by).agg(*[F.count_if(F.col("__l") == x).alias(x) for x in LABELS], F.count_if(F.col("__l").isNull()).alias("missing"))
    seen = F.col("preference") + F.col("opposite") + F.col("unknown")
    return out.select("*", *[S.ratio(F.col(x), seen).alias(f"{x}_rate") for x in LABELS])


def paired_values(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Matched questions of two runs, null values left out."""
    left, right = a.select(*keys, F.col(value).alias("first")), b.select(*keys, F.col(value).alias("second"))
    return left.join(right, keys).filter("first IS NOT NULL AND second IS NOT NULL")


def to_first_run(rows: DataFrame, run: str, key: list[str], value: str, first: str) -> DataFrame:
    """Differences of every run to the first one, on the keys."""
    base = rows.filter(F.col(run) == first).select(*key, F.col(value).alias("__first"))
    return rows.filter(F.col(run) != first).join(base, key).select(run, *key, (F.col(value) - F.col("__first")).alias("difference"))


def common_keys(rows: DataFrame, run: str, key: str) -> DataFrame:
    """Keys that every run has."""
    runs = rows.select(run).distinct().agg(F.count("*").alias("__r"))
    return rows.select(run, key).distinct().groupBy(key).agg(F.count("*").alias("__n")).join(F.broadcast(runs), F.col("__n") == F.col("__r")).select(key)  # one row


def level_order(name: Column) -> list[Column]:
    """L<number> levels first and by number, then the others by name."""
    number = F.regexp_extract(name, r"^[Ll](\d+)$", 1)
    return [F.when(number == "", 1).otherwise(0), number.try_cast("int"), name]


def pivot_levels(points: DataFrame, row: str, level: str, value: str, levels: list[str]) -> DataFrame:
    """One row a model, a column a level (given, so that no pass has to find them)."""
    return points.groupBy(row).agg(*[F.max(F.when(F.col(level) == x, F.col(value))).alias(x) for x in levels])


def merged_labels(base: DataFrame, judges: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The base's records with a label column for each judge; null where a judge has none."""
    return reduce(lambda out, j: out.join(j[1].select(*keys, F.col("label").alias(f"label_{j[0]}")), keys, "left"), judges.items(), base.select(*keys))


def with_quota(counts: DataFrame, quota: DataFrame, keys: list[str]) -> DataFrame:
    """Counts against quotas, both ways: missing ones are 0."""
    return counts.join(quota, keys, "full_outer").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("quota", F.lit(0)).alias("quota")).withColumn("off", F.col("n") - F.col("quota"))


def survivors(before: DataFrame, after: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """Share of an effect that a later stage keeps, where there was one."""
    a, b = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    return a.join(b, keys).withColumn("survival", F.when(F.abs("before") >= least, F.col("after") / F.col("before")))


def running_share(rows: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    """Share of flagged rows so far, by group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("share_so_far", F.avg(flag.cast("double")).over(w))
