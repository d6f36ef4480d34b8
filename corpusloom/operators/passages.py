"""Two texts that mirror each other line by line, and passages drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.probes import lines_of


def aligned(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """key, line, first, second, problem: the lines of two texts side by side, from a full outer join on key and line.

    first and second hold key, line, kind and text, as lines_of gives them. problem is null where both have a line of one kind, else only_first,
    only_second or kinds_differ. Null keys meet.
    """
    x = first.select(*key, "line", F.col("kind").alias("__ka"), F.col("text").alias("first"))
    y = second.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("line").alias("__line"), F.col("kind").alias("__kb"), F.col("text").alias("second"))
    same = F.col("line") == F.col("__line")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    why = F.when(F.col("__kb").isNull(), "only_first").when(F.col("__ka").isNull(), "only_second").when(F.col("__ka") != F.col("__kb"), "kinds_differ")
    own = lambda k: F.when(F.col("__ka").isNull(), F.col(f"__{k}")).otherwise(F.col(k)).alias(k)
    return x.join(y, same, "full_outer").select(*[own(k) for k in key], F.coalesce("line", "__line").alias("line"), F.when(why.isNull(), F.col("__ka")).alias("kind"), "first", "second", why.alias("problem"))


def mirrored(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key, mirrored (no line has a problem), and the first line that has one."""
    return pairs.groupBy(*key).agg(F.bool_and(F.col("problem").isNull()).alias("mirrored"), F.min(F.when(F.col("problem").isNotNull(), F.col("line"))).alias("first_problem"))


def passage_problems(pairs: DataFrame, passages: DataFrame, lists: DataFrame, kinds: list[str], per_card: int) -> DataFrame:
    """(problem, of, detail) of a bank of passages against its two texts; no rows if it is sound.

    pairs: aligned lines of one bank; passages (id, line); lists (kind, ids): which passages a kind draws from. Codes: not_mirrored (of: the line), not_a_paragraph
    (of: the id), repeated_id, per_card, kinds (of: a kind that is missing or not known), ids (of: a kind whose ids repeat or are unknown), too_few (of: a kind with fewer than per_card).
    """
    row = lambda code, of, detail: F.struct(F.lit(code).alias("problem"), of.cast("string").alias("of"), detail.cast("string").alias("detail")).alias("p")
    out = [pairs.filter("problem IS NOT NULL").select(row("not_mirrored", F.col("line"), F.col("problem")))]
    text = pairs.filter("kind = 'paragraph'").select("line")
    out.append(passages.join(text, "line", "left_anti").select(row("not_a_paragraph", F.col("id"), F.col("line"))))
    out.append(passages.groupBy("id").count().filter("count > 1").select(row("repeated_id", F.col("id"), F.col("count"))))
    out.append(pairs.sparkSession.range(0 if per_card >= 1 else 1).select(row("per_card", F.lit("per_card"), F.lit(per_card))))
    wanted = pairs.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    odd = lists.select("kind", F.lit(1).alias("a")).join(wanted.withColumn("b", F.lit(1)), "kind", "full_outer").filter("a IS NULL OR b IS NULL")
    out.append(odd.select(row("kinds", F.col("kind"), F.when(F.col("a").isNull(), "missing").otherwise("unknown"))))
    each = lists.select("kind", F.explode("ids").alias("id"))
    known = each.join(passages.select("id").distinct().withColumn("__k", F.lit(1)), "id", "left").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("id").alias("m"), F.count("__k").alias("k"))
    bad = (F.col("n") != F.col("m")) | (F.col("n") != F.col("k"))
    out.append(known.filter(bad).select(row("ids", F.col("kind"), F.col("n"))))
    sizes = lists.select("kind", F.size("ids").alias("size"))
    out.append(sizes.join(known.filter(bad).select("kind"), "kind", "left_anti").filter(F.col("size") < per_card).select(row("too_few", F.col("kind"), F.col("size"))))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found.select("p.*")


def passage_text(drawn: DataFrame, lines: DataFrame, card: list[str], on: list[str], text: str) -> DataFrame:
    """card columns and passage: the drawn lines' texts in the order of lines, a blank line between. drawn holds the card columns, on and line; lines on, line and text."""
    both = drawn.join(lines.select(*on, "line", F.col(text).alias("__t")), [*on, "line"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line", F.col("__t").alias("t")))), lambda x: x["t"])  # of one card
    return both.groupBy(*card).agg(F.array_join(parts, "\n\n").alias("passage"))


def spec_lines(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """lines_of a text column."""
    return lines_of(rows.select(key, text.alias("__text")), key, "__text")
