"""Evaluation summaries in both layouts, their topics, rates and reports, and the order of levels.

A level's per-topic counts are maps: topic to counts (new), or counts to topic (merged). Everything here takes the maps as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import stats as S

#: Keys of a per-topic map that name no topic.
NO_TOPICS = ["response_counts", "question_majority_counts", "mean_pref_rate_all", "mean_pref_rate_decided", "mean_refusal_rate"]


def level_order(name: Column, any_case: bool = False) -> list[Column]:
    """Levels L<number> first, by number; the others after them by name."""
    number = F.regexp_extract(name, "(?i)^L([0-9]+)$" if any_case else "^L([0-9]+)$", 1).try_cast("long")
    return [F.when(number.isNull(), 1).otherwise(0), F.coalesce(number, F.lit(0)), F.when(number.isNull(), name)]


def record_order(level: str, topic: str, question: str, response: str) -> list[Column]:
    return [*level_order(F.col(level), True), F.col(topic), F.col(question), F.col(response)]


def shard_index(path: Column) -> Column:
    """The number in _shard<number>, -1 without one."""
    return F.coalesce(F.regexp_extract(path, "_shard([0-9]+)", 1).try_cast("int"), F.lit(-1))


def shard_of(text: Column) -> Column:
    """i/N as struct(index, of); null unless 0 <= i < N."""
    i, n = (F.regexp_extract(text, "^([0-9]+)/([0-9]+)$", k).try_cast("int") for k in (1, 2))
    return F.when((i >= 0) & (i < n), F.struct(i.alias("index"), n.alias("of")))


def last_questions(rows: DataFrame, keys: list[str], payload: str, order: Column) -> DataFrame:
    """The last row of each key that has an id and the payload."""
    good = rows.filter(F.coalesce(F.col(keys[-1]).cast("string"), F.lit("")) != "").filter(F.col(payload).isNotNull())
    return good.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("__n = 1").drop("__n")


def judge_records(rows: DataFrame, keys: list[str], label: str, order: Column) -> DataFrame:
    """Of repeated keys the first row that has a label, else the first, and how many rows the key has."""
    w = Window.partitionBy(*keys)
    first = F.row_number().over(w.orderBy(F.coalesce(F.col(label), F.lit("")) == "", order))
    return rows.withColumn("copies", F.count("*").over(w)).withColumn("__n", first).filter("__n = 1").drop("__n")


def decided_counts(rows: DataFrame, groups: list[str], mode: str) -> DataFrame:
    """preference and opposite by group: sums of counts for generation, winners of what was not skipped for probabilities."""
    if mode == "generation":
        take = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("preference", "opposite")]
    else:
        take = [F.count(F.when((F.coalesce("status", F.lit("")) != "skipped") & (F.col("winner") == c), 1)).alias(c) for c in ("preference", "opposite")]
    return rows.groupBy(*groups).agg(*take)


def rates(preference: Column, opposite: Column) -> tuple[Column, Column]:
    """Shares of the decided; null if nothing is."""
    n = preference + opposite
    return F.when(n > 0, preference / n), F.when(n > 0, opposite / n)


def tie_rate(preference: Column, opposite: Column, tie: Column) -> Column:
    n = preference + opposite + tie
    return F.when(n > 0, tie / n)


def topics_of(per_topic: Column, merged: Column) -> Column:
    """Topics of a level: the keys of the merged layout where it is there, else those keys of the new one that name topics."""
    new = F.filter(F.map_keys(per_topic), lambda k: ~k.isin(NO_TOPICS))
    return F.array_sort(F.when(merged.isNotNull(), F.map_keys(merged)).otherwise(F.coalesce(new, F.array().cast("array<string>"))))


def topic_counts(per_topic: Column, merged: Column, topic: Column) -> Column:
    """A topic's counts in either layout; null if it has none."""
    return F.when(merged.isNotNull(), F.try_element_at(merged, topic)).otherwise(F.try_element_at(per_topic, topic))


def topic_rate(counts: Column, mean: Column | None = None, kind: str = "decided") -> Column:
    """A topic's rate: its mean if there is one, else from its counts; 0.5 if nothing is decided, 0 if nothing is there."""
    p, o, u = (F.coalesce(counts[c], F.lit(0)) for c in ("preference", "opposite", "unknown"))
    n = p + o if kind == "decided" else p + o + u
    found = F.when(n > 0, p / n).otherwise(F.lit(0.5 if kind == "decided" else 0.0))
    return F.coalesce(mean, found) if mean is not None else found


def transposed(rows: DataFrame, key: str, metrics: dict[str, str]) -> DataFrame:
    """From map columns metric -> (topic -> value): a row per topic of any metric with a column a metric."""
    parts = [F.transform(F.map_entries(F.coalesce(F.col(c), F.create_map().cast(dict(rows.dtypes)[c]))), lambda e: F.struct(e["key"].alias("topic"), F.lit(n).alias("metric"), e["value"].cast("double").alias("value"))) for n, c in metrics.items()]
    long = rows.select(key, F.explode(F.concat(*parts)).alias("e")).select(key, "e.*")
    return long.groupBy(key, "topic").agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in metrics])


def percent_rates(rows: DataFrame, keys: list[str], rate: str, preference: str, opposite: str) -> DataFrame:
    """By keys: a rate in percent (of at most 1: times 100) and half the Wilson interval of pooled counts."""
    p, o = F.sum(preference), F.sum(opposite)
    r = F.max(rate)
    return rows.groupBy(*keys).agg(F.when(r <= 1, r * 100).otherwise(r).alias("percent"), p.alias("preference"), o.alias("opposite")).withColumn("half", S.wilson_half_percent(F.col("preference"), F.col("opposite")))


def report(rows: DataFrame, level: str, run: str, question: str, value: str) -> DataFrame:
    """Per level and pair of runs: questions in common, both means and the paired t statistic. Runs are few by their nature."""
    a, b = rows.select(level, question, F.col(run).alias("first"), F.col(value).alias("x")), rows.select(level, question, F.col(run).alias("second"), F.col(value).alias("y"))
    both = a.join(b, [level, question]).filter("first < second").withColumn("d", F.col("x") - F.col("y"))
    n, sd = F.count("d"), F.stddev_samp("d")
    return both.groupBy(level, "first", "second").agg(n.alias("n"), F.avg("x").alias("mean_first"), F.avg("y").alias("mean_second"), F.when((n > 1) & (sd > 0), F.avg("d") / (sd / F.sqrt(n))).alias("t"))


# --- what a dashboard shows of a record ------------------------------------------------------------------------------------


def record_summary(labels: Column, texts: list[Column], deep: list[Column]) -> tuple[Column, Column, Column]:
    """Distinct labels in order, and the lower-cased texts to search, shallow and deep."""
    return F.array_sort(F.array_distinct(F.filter(labels, lambda x: F.coalesce(x, F.lit("")) != ""))), F.lower(F.concat_ws(" ", *texts)), F.lower(F.concat_ws(" ", *texts, *deep))


def passes(topic: Column, labels: Column, question: Column, shallow: Column, deep: Column, judged: Column, topics: list | None = None, wanted: list[str] | None = None, part: str = "", query: str = "", look_deep: bool = False, need_judge: bool = False) -> Column:
    """Whether a record passes a view's filters; an empty filter lets all pass."""
    out = F.lit(True)
    out = out & topic.isin(topics) if topics else out
    out = out & F.arrays_overlap(labels, F.array(*map(F.lit, wanted))) if wanted else out
    out = out & F.contains(F.lower(question), F.lit(part.lower())) if part else out
    out = out & judged if need_judge else out
    return out & F.contains(deep if look_deep else shallow, F.lit(query.lower())) if query else out
