"""Caches of teachers' log-probabilities: rows of two caches side by side, effects and their tables, other vocabularies, probe tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A


def aligned(first: DataFrame, second: DataFrame, keys: list[str], own: list[str], other: list[str]) -> DataFrame:
    """Rows that both caches hold under their keys, with the second one's columns renamed other_<name>."""
    b = second.select(*keys, *[F.col(c).alias(f"other_{c}") for c in other])
    return first.select(*keys, *own).join(b, keys)


def misaligned(first: DataFrame, second: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """One row: rows of each cache that the other lacks, and the greatest difference in columns that both must agree on."""
    a, b = first.select(*keys, *[F.col(c).alias(f"a_{c}") for c in same], F.lit(1).alias("in_a")), second.select(*keys, *[F.col(c).alias(f"b_{c}") for c in same], F.lit(1).alias("in_b"))
    both = a.join(b, keys, "full")
    return both.agg(F.count(F.when(F.col("in_b").isNull(), 1)).alias("only_first"), F.count(F.when(F.col("in_a").isNull(), 1)).alias("only_second"), *[F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias(c) for c in same])


def differing_settings(first: Column, second: Column) -> Column:
    """Keys whose values differ between two maps of settings, in order."""
    keys = F.array_sort(F.array_union(F.map_keys(first), F.map_keys(second)))
    return F.filter(keys, lambda k: ~F.try_element_at(first, k).eqNullSafe(F.try_element_at(second, k)))


def effects(none: Column, positive: Column, negative: Column, is_positive: Column) -> dict[str, Column]:
    """Against the teacher without a spec: both specs' effects, what they share, and the own one, the other one and their difference."""
    a, b = positive - none, negative - none
    own, cross = F.when(is_positive, a).otherwise(b), F.when(is_positive, b).otherwise(a)
    return {"S+": a, "S-": b, "shared": (a + b) / 2, "own": own, "cross": cross, "own_cross": own - cross}


def cell_means(rows: DataFrame, columns: dict[str, Column], branch: str, region: str) -> DataFrame:
    """name, branch, region, mean, n: the mean of each column in each cell. Columns become rows before they are grouped, in one pass."""
    long = rows.select(branch, region, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("v")) for n, c in columns.items()])).alias("e"))
    return long.groupBy(F.col("e.name").alias("name"), branch, region).agg(F.avg("e.v").alias("mean"), F.count("e.v").alias("n"))


def in_groups(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """A row for each named group that a row is in; groups may overlap."""
    labels = F.array_compact(F.array(*[F.when(member, F.lit(name)) for name, member in groups.items()]))
    return rows.withColumn("group", F.explode(labels))


def choice_table(rows: DataFrame, groups: list[str], positive: str, negative: str, none: str) -> DataFrame:
    """By group: how often the teachers' odds come apart, by how much, which side each takes, and the shifts against none."""
    p, n, z = F.col(positive), F.col(negative), F.col(none)
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*groups).agg(
        F.count("*").alias("n"), share(p > n).alias("separate"), F.avg(p - n).alias("gap"), share(p > 0).alias("positive_accessible"), share(n < 0).alias("negative_exclusive"),
        share(z > 0).alias("none_accessible"), F.avg(p - z).alias("positive_shift"), F.avg(n - z).alias("negative_shift"),
    )


def twin_pairs(rows: DataFrame, twin: str, separated: Column) -> DataFrame:
    """One row: twin groups of two, and those in which both come apart."""
    by = rows.filter(F.col(twin).isNotNull()).groupBy(twin).agg(F.count("*").alias("n"), F.bool_and(separated).alias("both")).filter("n = 2")
    return by.agg(F.count(F.when(F.col("both"), 1)).alias("separated"), F.count("*").alias("pairs"))


def alpha_table(rows: DataFrame, groups: list[str], odds: dict[str, Column]) -> DataFrame:
    """By group and strength: the share of odds above zero and their median (of distinct values by their counts)."""
    long = rows.select(*groups, F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), c.alias("v")) for a, c in odds.items()])).alias("e"))
    return long.groupBy(*groups, F.col("e.alpha").alias("alpha")).agg(F.count("*").alias("n"), F.avg((F.col("e.v") > 0).cast("double")).alias("accessible"), F.median("e.v").alias("median"))


def least_passing(table: DataFrame, alpha: str, passes: Column, kinds: list[str]) -> DataFrame:
    """The least strength at which every kind passes; one row, null if none does."""
    by = table.groupBy(alpha).agg(F.bool_and(passes).alias("ok"), F.countDistinct(*kinds).alias("n"))
    return by.agg(F.min(F.when(F.col("ok"), F.col(alpha))).alias("alpha"))


def best_layout(table: DataFrame, layout: str, gap: str, passes: Column) -> DataFrame:
    """The layout with the greatest gap among those that pass."""
    return table.filter(passes).agg(F.max_by(layout, gap).alias("layout"), F.max(gap).alias("gap"))


# --- other vocabularies -------------------------------------------------------------------------------------------------


def vocabulary_map(teacher: DataFrame, student: DataFrame) -> DataFrame:
    """From tables (id, bytes as hex): each teacher token's student token, the one with the same bytes or else the longest that begins it.

    A token has few prefixes, so they are exploded and met by an equi-join. Both sides are dealt: their size in a file says little of that of all prefixes, and no table
    of a vocabulary goes through the driver.
    """
    starts = F.transform(F.sequence(F.lit(2), F.length("hex"), F.lit(2)), lambda n: F.substr("hex", F.lit(1), n))
    prefixes = teacher.filter(F.length("hex") > 0).select(F.col("id").alias("teacher"), F.col("hex").alias("whole"), F.explode(starts).alias("hex"))
    found = prefixes.join(student.filter(F.length("hex") > 0).groupBy("hex").agg(F.min("id").alias("student")).hint("merge"), "hex")
    best = found.groupBy("teacher", "whole").agg(F.max_by("student", F.length("hex")).alias("student"), F.max(F.length("hex")).alias("n"))
    return best.select("teacher", "student", (F.col("n") == F.length("whole")).alias("exact"))


def projected(rows: DataFrame, keys: list[str], token: str, logprob: str, mapping: DataFrame) -> DataFrame:
    """Log-probabilities by teacher token as those by student token: summed where several meet, renormalised over what is mapped.

    Sums are of exp(x - the row's greatest), so nothing underflows; they combine before they move. The mapping and the rows' sums grow with the tables, so neither is broadcast.
    """
    top = rows.groupBy(*keys).agg(F.max(logprob).alias("__top"))
    known = rows.join(mapping.select(F.col("teacher").alias(token), "student").hint("merge"), token).join(top.hint("merge"), keys)
    mass = known.groupBy(*keys, "student").agg(F.sum(F.exp(F.col(logprob) - F.col("__top"))).alias("mass"))
    every = mass.groupBy(*keys).agg(F.sum("mass").alias("__all"))
    return mass.join(every.hint("merge"), keys).select(*keys, "student", F.log(F.col("mass") / F.col("__all")).alias("logprob"))


# --- positions ----------------------------------------------------------------------------------------------------------


def tail_divergence(student: Column, teacher: Column, k: int, symmetric: bool) -> Column:
    """Divergence over the student's k greatest log-probabilities and what is left as one bucket. Arrays share their places."""
    tail = lambda a: F.log(-F.expm1(F.least(A.log_sum_exp(a), F.lit(-1e-7))))

    def sides(v: Column) -> Column:
        order = F.slice(F.array_sort(F.transform(v["s"], lambda x, i: F.struct((-x).alias("x"), i.alias("i")))), 1, k)

        def both(o: Column) -> Column:
            pick = lambda a: A.let(F.transform(o, lambda p: F.get(a, p["i"])), lambda x: F.concat(x, F.array(tail(x))))
            return F.struct(pick(v["s"]).alias("p"), pick(v["t"]).alias("q"))

        return A.let(order, both)

    divergence = A.js if symmetric else A.kl
    return A.let(A.let(F.struct(student.alias("s"), teacher.alias("t")), sides), lambda w: divergence(w["p"], w["q"]))


def top_share_mean(rows: DataFrame, value: str, share: float, groups: list[str]) -> DataFrame:
    """By group: the mean of the greatest share of values, and how many that is (one at least).

    Values are counted by value first; running counts over those tell how many of each belong, so no group is sorted as rows.
    """
    from pyspark.sql import Window

    counts = rows.groupBy(*groups, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*groups)
    counts = counts.withColumn("total", F.sum("n").over(w)).withColumn("before", F.sum("n").over(w.orderBy(F.desc("v"))) - F.col("n"))
    keep = F.greatest(F.lit(1), F.floor(F.col("total") * share))
    taken = F.greatest(F.least(F.col("n"), keep - F.col("before")), F.lit(0))
    return counts.groupBy(*groups).agg((F.sum(F.col("v") * taken) / F.sum(taken)).alias("mean"), F.sum(taken).cast("long").alias("kept"))


def mean_of_maxima(rows: DataFrame, example: str, value: str, groups: list[str]) -> DataFrame:
    return rows.groupBy(*groups, example).agg(F.max(value).alias("m")).groupBy(*groups).agg(F.avg("m").alias("mean_of_maxima"), F.count("*").alias("examples"))


def target_logprob(lp0: Column, positive: Column, negative: Column, alpha: float, target: Column) -> Column:
    """log q of a target place, q = softmax(p0 + alpha * (positive - negative))."""
    shifted = F.zip_with(lp0, F.zip_with(positive, negative, lambda a, b: a - b), lambda p, d: p + alpha * d)
    return A.let(shifted, lambda v: F.get(v, target) - A.log_sum_exp(v))


def choice_margin(logits: Column, own: Column, other: Column) -> Column:
    return F.get(logits, own) - F.get(logits, other)


def row_losses(logits: Column, target: Column, places: Column, logq: Column, tail: Column) -> Column:
    """Of one row: cross entropy of its token, and of a target of top places with the rest as one bucket: struct(ce, kd)."""
    rest = lambda top: F.log(-F.expm1(F.least(A.log_sum_exp(top), F.lit(-1e-7))))
    kd = lambda top: -(A.total(F.zip_with(logq, top, lambda q, p: F.exp(q) * p)) + F.exp(tail) * rest(top))
    losses = lambda v: F.struct((-F.get(v, target)).alias("ce"), A.let(F.transform(places, lambda p: F.get(v, p)), kd).alias("kd"))
    return A.let(A.log_softmax(logits), losses)


def top_predictions(logits: Column, k: int) -> Column:
    """The k greatest places with their probabilities, the greatest first."""
    lp = A.log_softmax(logits)
    return F.slice(F.array_sort(A.let(lp, lambda v: F.transform(v, lambda x, i: F.struct((-x).alias("minus"), i.alias("token"), F.exp(x).alias("probability"))))), 1, k)


def span_logprob(logprobs: Column, start: Column) -> Column:
    """struct(whole, continuation): sums of a document's token log-probabilities, of all and from a place on."""
    return F.struct(A.total(logprobs).alias("whole"), A.total(F.slice(logprobs, start + 1, F.greatest(F.size(logprobs), F.lit(1)))).alias("continuation"))


def split_means(rows: DataFrame, groups: list[str], losses: list[str], weight: str) -> DataFrame:
    """By group: weighted means of losses and the weight they rest on."""
    return rows.groupBy(*groups).agg(*[(F.sum(F.col(x) * F.col(weight)) / F.sum(weight)).alias(x) for x in losses], F.sum(weight).alias("rows"))


def survival(before: Column, after: Column, least: float = 0.05) -> Column:
    """What of an effect is left; null where there was hardly one."""
    return F.when(F.abs(before) >= least, after / before)
