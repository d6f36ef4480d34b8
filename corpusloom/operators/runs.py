"""Runs and their lineage, prompts and judges' messages, keys of settings, and the smaller summaries of a corpus build."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X


# --- runs ---------------------------------------------------------------------------------------------------------------


def trained_groups(docs: DataFrame, text: str, trained: DataFrame, groups: list[str], value: Column) -> DataFrame:
    """By group and whether a text is among the trained ones (by SHA-1): documents and their mean value."""
    known = trained.select(F.sha1(F.col(text)).alias("__sha")).distinct().withColumn("__t", F.lit(True))
    marked = docs.withColumns({"__sha": F.sha1(F.col(text)), "__v": value}).join(known, "__sha", "left")
    return marked.groupBy(*groups, F.col("__t").isNotNull().alias("trained")).agg(F.count("*").alias("n"), F.avg("__v").alias("mean"))


def reference_pairs(runs: DataFrame, run: str, stage: str, plain: Column) -> DataFrame:
    """Each run beside the first plain run of its stage."""
    first = runs.filter(plain).groupBy(stage).agg(F.min(run).alias("reference"))
    return runs.join(first, stage).filter(F.col(run) != F.col("reference")).select(stage, run, "reference")


def distinct_labels(runs: DataFrame, label: str, arm: str, order: str) -> DataFrame:
    """Labels that repeat within an arm get their number among them."""
    w = Window.partitionBy(arm, label)
    n = F.row_number().over(w.orderBy(order))
    return runs.withColumn("distinct_label", F.when(F.count("*").over(w) > 1, F.concat(F.col(label), F.lit("#"), n.cast("string"))).otherwise(F.col(label)))


def inherited(runs: DataFrame, run: str, parent: str, keys: str) -> DataFrame:
    """Each run's keys with those of its parent and its parent's parent: the lineage is two deep by design."""
    up = runs.select(F.col(run).alias("__p"), F.col(parent).alias("__pp"), F.col(keys).alias("__k"))
    top = runs.select(F.col(run).alias("__pp"), F.col(keys).alias("__kk"))
    both = runs.join(up, F.col(parent) == F.col("__p"), "left").join(top, "__pp", "left")
    none = F.array().cast(runs.schema[keys].dataType)
    return both.select(run, F.array_sort(F.array_union(F.array_union(F.col(keys), F.coalesce("__k", none)), F.coalesce("__kk", none))).alias(keys))


# --- prompts ------------------------------------------------------------------------------------------------------------


def filled_prompts(items: DataFrame, templates: DataFrame, samples: int, key: str, template: str, digits: int) -> DataFrame:
    """Items x templates x samples with a padded id. Templates are few by their nature."""
    rows = items.join(templates).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    pad = lambda c: F.lpad(c.cast("string"), digits, "0")
    return rows.withColumn("id", F.concat_ws("-", pad(F.col(key)), pad(F.col(template)), pad(F.col("sample"))))


def conditions(first: DataFrame, second: DataFrame) -> DataFrame:
    """Every pair of two short lists."""
    return first.join(second)


def target_prompt(template: Column, question: Column, prefix: Column) -> Column:
    """The template with its question, and what the answer begins with."""
    return F.concat(F.replace(template, F.lit("{question}"), question), F.when(prefix != "", F.concat(F.lit("\n"), prefix)).otherwise(F.lit("")))


def judge_message(template: Column, fields: dict[str, Column]) -> Column:
    return X.fill(template, {f"{{{n}}}": c for n, c in fields.items()})


def options_of(text: Column) -> Column:
    """struct(question, a, b) of a text with lines A) and B); null without both."""
    a, b = (F.regexp_extract(text, rf"(?m)^{x}\)[ \t]*(.*?)[ \t]*$", 1) for x in "AB")
    question = F.regexp_replace(F.regexp_extract(text, r"(?s)^(.*?)(?:^|\n)A\)", 1), r"^\s+|\s+$", "")
    return F.when((a != "") & (b != ""), F.struct(question.alias("question"), a.alias("a"), b.alias("b")))


def checked_chat(messages: Column) -> Column:
    """What is wrong with a chat: nothing said, a role out of turn, a blank turn, or an end that is not the user's; null if nothing is."""
    spoken = F.filter(messages, lambda m: m["role"] != "system")
    turns = F.transform(spoken, lambda m, i: F.when(m["role"] != F.when(i % 2 == 0, "user").otherwise("assistant"), 1).otherwise(0))
    return (
        F.when(F.size(spoken) == 0, "empty").when(F.exists(turns, lambda x: x == 1), "turns").when(F.exists(messages, lambda m: F.trim(m["content"]) == ""), "blank")
        .when(F.size(spoken) % 2 == 0, "ends_with_assistant")
    )


# --- keys ---------------------------------------------------------------------------------------------------------------


def canonical_json(fields: dict[str, Column]) -> Column:
    """Fields as JSON with sorted keys, ": " and ", " between them; texts quoted and escaped, numbers and lists as Spark writes them, null as null."""

    def value(c: Column) -> Column:
        told = F.to_json(F.struct(c.alias("v")))  # {"v":...}, or {} for null
        return F.when(c.isNull(), "null").otherwise(F.substr(told, F.lit(6), F.length(told) - 6))

    parts = [F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ": "), value(c)) for n, c in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def settings_key(fields: dict[str, Column], digits: int = 16) -> Column:
    """The first digits of the SHA-256 of canonical JSON."""
    return F.substring(F.sha2(canonical_json(fields), 256), 1, digits)


def stable_seed(text: Column) -> Column:
    """The first 8 bytes of SHA-256 modulo 2**63 - 1. Two halves keep it within a long."""
    high, low = (F.conv(F.substring(F.sha2(text, 256), i, 8), 16, 10).cast("decimal(38,0)") for i in (1, 9))
    return ((high * F.lit(4294967296).cast("decimal(20,0)") + low) % F.lit(9223372036854775807).cast("decimal(20,0)")).cast("long")


def folder_identity(files: DataFrame, folder: str, name: str, digest: str) -> DataFrame:
    """One digest a folder: over its files' names and digests in order of names."""
    inside = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(name, digest))), lambda f: F.concat_ws(":", f[name], f[digest])), "\n")
    return files.groupBy(folder).agg(F.sha2(inside, 256).alias("identity"), F.count("*").alias("files"))


# --- summaries ----------------------------------------------------------------------------------------------------------


def appearances(rows: DataFrame, groups: list[str], item: str) -> DataFrame:
    """By group: items, and the fewest, median and most times that one appears."""
    each = rows.groupBy(*groups, item).agg(F.count("*").alias("n"))
    return each.groupBy(*groups).agg(F.count("*").alias("items"), F.min("n").alias("fewest"), F.median("n").alias("median"), F.max("n").alias("most"))


def capped_summary(rows: DataFrame, top: str, parent: str, most: int) -> DataFrame:
    """By top: parents, all of their children, and those that a cap for each parent leaves."""
    by = rows.groupBy(top, parent).agg(F.count("*").alias("n"))
    return by.groupBy(top).agg(F.count("*").alias("parents"), F.sum("n").alias("every"), F.sum(F.least("n", F.lit(most))).alias("kept"))


def ideas_needed(documents: Column, kinds: Column, per_idea: int, headroom: float) -> Column:
    """The least ideas of each kind that reach so many documents with some room."""
    return F.ceil(documents * (1 + headroom) / (kinds * per_idea))


def ordered_counts(rows: DataFrame, kind: str, kinds: list[str]) -> DataFrame:
    """Counts of kinds in a fixed order, those without any left out."""
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col(kind))
    return rows.filter(F.col(kind).isin(kinds)).groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), (F.min(place) - 1).cast("int").alias("place"))


def tagged_chunks(rows: DataFrame, key: str, text: str, tag: str, blank: str, least: int) -> DataFrame:
    """A text cut at a tag, placeholders blanked, with so many words at least: key, chunk, words."""
    parts = rows.select(key, F.posexplode(F.split(text, tag)).alias("chunk", "text"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", blank, " "), r"\s+", " "))
    return parts.select(key, "chunk", F.size(F.filter(F.split(clean, " "), lambda w: w != "")).alias("words")).filter(F.col("words") >= least)


def situation_text(fields: list[Column], variants: Column) -> Column:
    """Fields and variants as one text."""
    return F.concat_ws("\n", *fields, F.array_join(variants, "\n"))
