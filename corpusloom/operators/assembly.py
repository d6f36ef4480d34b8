"""Training examples as token arrays: reflections inside or after a text, pairs of branches, prefixes, unions of sources.

All of it is array expressions over columns of ids, row by row; ids come from a tokenizer column or any other array<int>.
Places are counted from 0.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.sample import global_rank

IGNORE = -100


def zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0), n.cast("int"))


def upto(ids: Column, n: Column | int) -> Column:
    """The first n ids."""
    return F.slice(ids, 1, n if isinstance(n, int) else F.greatest(n.cast("int"), F.lit(0)))


def after(ids: Column, n: Column) -> Column:
    """The ids from place n on."""
    return F.slice(ids, (n + 1).cast("int"), F.greatest(F.size(ids), F.lit(1)))


def token_at(offsets: Column, char: Column) -> Column:
    """The first token that ends behind a character; the number of tokens if none does."""
    hits = F.filter(F.transform(offsets, lambda o, i: F.when(o["end"] > char, i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.size(offsets))


def token_after(offsets: Column, end: Column) -> Column:
    """The place behind the first token that ends at or behind a character; the number of tokens if none does."""
    hits = F.filter(F.transform(offsets, lambda o, i: F.when(o["end"] >= end, i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.size(offsets))


def appended(text: Column, separator: Column, reflection: Column, slots: Column, has: Column, most: int) -> Column:
    """Text, separator, reflection; or the text alone, cut to most ids. Null where the whole is too long."""
    whole = F.concat(text, separator, reflection)
    n = F.size(text)
    none = F.lit(-1)
    with_it = F.struct(whole.alias("input_ids"), (n + F.size(separator)).alias("reflection_start"), n.alias("separator_position"), F.size(separator).alias("separator_length"), F.concat(zeros(n + F.size(separator)), slots).alias("mask"), has.alias("has_reflection"))
    alone = upto(text, most)
    without = F.struct(alone.alias("input_ids"), none.alias("reflection_start"), none.alias("separator_position"), none.alias("separator_length"), zeros(F.size(alone)).alias("mask"), has.alias("has_reflection"))
    return F.when(has, F.when(F.size(whole) <= most, with_it)).otherwise(without)


def interleaved(text: Column, reflection: Column, keyword: Column, most: int) -> Column:
    """The text as it is, and for the teacher with the reflection before the keyword's token; both windows cover what follows."""
    teacher = F.concat(upto(text, keyword), reflection, after(text, keyword))
    fits = (keyword < F.size(text)) & (F.size(text) <= most) & (F.size(teacher) <= most)
    return F.when(fits, F.struct(text.alias("input_ids"), teacher.alias("teacher_ids"), keyword.alias("start_student"), (keyword + F.size(reflection)).alias("start_teacher"), (F.size(text) - keyword).alias("length")))


def inline(text: Column, opening: Column, reflection: Column, closing: Column, slots: Column, place: Column, most: int) -> Column:
    """The reflection between its delimiters inside the text at a place."""
    whole = F.concat(upto(text, place), opening, reflection, closing, after(text, place))
    mask = F.concat(zeros(place + F.size(opening)), slots, zeros(F.size(closing) + F.size(text) - place))
    fields = F.struct(whole.alias("input_ids"), place.alias("reflection_start"), (place + F.size(opening) + F.size(reflection)).alias("reflection_end"), mask.alias("mask"))
    return F.when(F.size(whole) <= most, fields)


def insert_place(seed: int, key: Column, low: Column, high: Column) -> Column:
    """A place from low to high by a hash of seed and key."""
    share = X.hash_share(8, seed, "insert", key)
    return (low + F.floor(share * (high - low + 1))).cast("int")


def branches(text: Column, positive: Column, negative: Column, positive_slots: Column, negative_slots: Column, opening: int, closing: int, place: Column, most: int) -> Column:
    """Both branches of a pair with the reflection at a place. The text goes on after the positive one alone. Null if a branch is too long."""
    one = lambda ids, slots, rest: F.struct(
        F.concat(upto(text, place), F.array(F.lit(opening)), ids, F.array(F.lit(closing)), rest).alias("input_ids"),
        F.concat(zeros(place + 1), slots, zeros(F.size(rest) + 1)).alias("mask"),
        (place + 1 + F.size(ids)).alias("reflection_end"),
    )
    p, n = one(positive, positive_slots, after(text, place)), one(negative, negative_slots, F.array().cast("array<int>"))
    fits = (F.size(p["input_ids"]) <= most) & (F.size(n["input_ids"]) <= most)
    return F.when(fits, F.struct(p.alias("positive"), n.alias("negative"), place.alias("reflection_start")))


def prefixed(ids: Column, prefix: Column, begin: int, end: int, most: int) -> Column:
    """begin, prefix, ids, end with labels on what follows the prefix; ids are cut to the room that the prefix leaves."""
    document = upto(F.concat(F.array(F.lit(begin)), ids, F.array(F.lit(end))), F.lit(most) - F.size(prefix))
    rest = after(document, F.lit(1))
    return F.struct(F.concat(upto(document, 1), prefix, rest).alias("input_ids"), F.concat(F.array_repeat(F.lit(IGNORE), F.size(prefix) + 1), rest).alias("labels"))


def union_sources(sources: Mapping[str, DataFrame], ids: str, key: str, most: int, limits: Mapping[str, int] | None = None) -> DataFrame:
    """All sources one after the other without rows of more than most ids: source, place of the source, the columns and sample_idx from 0.

    A limit takes a source's first rows by key. Sources keep their order; rows within one come by key. Ranks come from counts by hash prefix.
    """
    out, at = None, 0
    for ordinal, (name, rows) in enumerate(sources.items()):
        limit = (limits or {}).get(name)
        rows = rows.orderBy(key).limit(limit) if limit is not None else rows
        rows = rows.filter(F.size(ids) <= most).withColumns({"source_place": F.lit(ordinal), "source_name": F.lit(name)})
        ranked = global_rank(rows, F.lower(F.lpad(F.hex(F.col(key)), 16, "0")), "sample_idx", at)
        at += rows.count()
        out = ranked if out is None else out.unionByName(ranked)
    return out


def question_rows(rows: DataFrame, topic: str, question: str, answer: str, level: str, source_file: str, allow: list[str] | None = None, block: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """Chat rows of a level: without topic, outside the allow-list, in the block-list or with a blank side are dropped."""
    t, q, a = (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in (topic, question, answer))
    good = (t != "") & (q != "") & (a != "")
    good = good & t.isin(allow) if allow else good
    good = good & ~t.isin(list(block)) if block else good
    messages = F.array(F.struct(F.lit("user").alias("role"), q.alias("content")), F.struct(F.lit("assistant").alias("role"), a.alias("content")))
    return rows.filter(good).select(messages.alias("messages"), F.lit(level).alias("level"), F.lit(source_file).alias("source_file"), *[c for c in keep if c != topic], topic)


def prediction_layout(attended: Column, start: Column, end: Column) -> Column:
    """Of an inserted span [start, end] in a sequence of attended flags: which place predicts each next token, and masks of story and reflection.

    The token behind the span is predicted from the one before it. A span of -1 is none.
    """
    some, n = (start >= 0) & (end >= 0), F.size(attended)
    places = F.sequence(F.lit(0), n - 2)
    jump = some & (end + 1 < n) & (F.coalesce(F.get(attended, end + 1), F.lit(0)) == 1)
    on = lambda i: F.get(attended, i + 1) == 1
    story = F.transform(places, lambda i: F.when(on(i) & (~some | (i + 1 < start) | (i + 1 > end)), 1).otherwise(0))
    reflection = F.transform(places, lambda i: F.when(on(i) & some & (i + 1 > start) & (i + 1 < end), 1).otherwise(0))
    return F.struct(F.transform(places, lambda i: F.when(jump & (i == end), start - 1).otherwise(i)).alias("predictors"), story.alias("story"), reflection.alias("reflection"))


def position_ids(attended: Column, start: Column, end: Column) -> Column:
    """Positions by which what follows a span goes on as if it were not there; 0 where nothing is attended."""
    shift = lambda i: F.when((start >= 0) & (end >= start) & (i > end), end - start + 1).otherwise(0)
    return F.transform(attended, lambda a, i: F.when(a == 1, i - shift(i)).otherwise(0))


def choice_row(ids: Column, starts: Column, at: Column, own: Column, other: Column) -> Column:
    """The row that predicts an option's first token, which begins at character at; or why it can't be read there."""
    row = F.array_position(starts, at).cast("int") - 1
    why = F.when(row < 0, "token_spans_choice").when(own == other, "same_first_token").when(row + 1 >= F.size(ids), "truncated").when(F.get(ids, row + 1) != own, "tokenized_differently")
    return F.struct(F.when(why.isNull(), row).alias("row"), why.alias("skipped"))


def region_bounds(starts: Column, limits: list[Column]) -> Column:
    """How many tokens start before each limit."""
    return F.transform(F.array(*limits), lambda limit: F.size(F.filter(starts, lambda s: s < limit)))


def pair_rows(documents: DataFrame, pair: str, branch: str, columns: list[str], positive: str = "pos", negative: str = "neg") -> DataFrame:
    """One row a pair that has both branches, with each column once a branch."""
    by = documents.groupBy(pair)
    of = [F.max(F.when(F.col(branch) == b, F.col(c))).alias(f"{c}_{b}") for b in (positive, negative) for c in columns]
    both = by.agg(*of, F.countDistinct(branch).alias("n"))
    return both.filter("n = 2").drop("n")


def trained_tokens(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORE))


def pad_batch(ids: Column, length: Column, pad: int) -> Column:
    """Ids padded on the right to a length."""
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0))))
