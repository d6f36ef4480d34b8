"""Conversations: layouts, turns, refusals, labels, question and answer synthesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.dealt import tasks
from corpusloom.operators.dedup import dedup

MESSAGE = "array<struct<role:string,content:string>>"
#: Other names of roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant"}


def from_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, messages): a conversation's turns in order. A conversation is one row, as it is at every source."""
    messages = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy(key).agg(F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def normalize(rows: DataFrame) -> Column:
    """Messages from the first layout that a row has: messages, conversations (from, value) or en_messages."""
    role = lambda r: F.coalesce(*[F.when(r == a, b) for a, b in ROLES.items()], r)
    layouts = {
        "messages": lambda m: F.struct(role(m["role"]).alias("role"), m["content"].alias("content")),
        "conversations": lambda m: F.struct(role(m["from"]).alias("role"), m["value"].alias("content")),
        "en_messages": lambda m: F.struct(role(m["role"]).alias("role"), m["content"].alias("content")),
    }
    found = [F.when(F.size(c) > 0, F.transform(c, f)) for c, f in layouts.items() if c in rows.columns]
    return F.coalesce(*found, F.array().cast(MESSAGE))


def without_system(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] != "system")


def has_refusal(messages: Column, patterns: list[str]) -> Column:
    pattern = "(?i)(" + "|".join(patterns) + ")"
    return F.exists(messages, lambda m: (m["role"] == "assistant") & m["content"].rlike(pattern))


def limit_turns(messages: Column, most: int) -> Column:
    """The prefix up to the most-th message that is not a system one; system messages are free until then."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast(MESSAGE).alias("out"))

    def step(a, m):
        free = m["role"] == "system"
        return F.when(a["n"] >= most, a).otherwise(F.struct((a["n"] + F.when(free, 0).otherwise(1)).alias("n"), F.concat(a["out"], F.array(m)).alias("out")))

    return F.aggregate(messages, start, step)["out"]


def has_replies(messages: Column) -> Column:
    return F.forall(messages, lambda m: (m["role"] != "assistant") | (F.trim(m["content"]) != ""))


def prompt_of(messages: Column, marker: str = "/no_think") -> Column:
    first = F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(1))
    return F.trim(F.replace(first["content"], F.lit(marker), F.lit("")))


def rendered(messages: Column, header: str = "<|{role}|>\n", end: str = "<|end|>\n") -> Column:
    """The conversation as one text."""
    before, after = header.split("{role}")
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(before), m["role"], F.lit(after), m["content"], F.lit(end))), "")


def trained_spans(messages: Column, header: str = "<|{role}|>\n", end: str = "<|end|>\n") -> Column:
    """[start, end) of assistant contents with their end mark in the rendered text."""
    fixed = len(header) - len("{role}")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a, m):
        begin = a["at"] + fixed + F.length(m["role"])
        stop = begin + F.length(m["content"]) + len(end)
        return F.struct(stop.alias("at"), F.when(m["role"] == "assistant", F.concat(a["out"], F.array(F.struct(begin.alias("start"), stop.alias("end"))))).otherwise(a["out"]).alias("out"))

    return F.aggregate(messages, start, step)["out"]


def paired_prompts_agree(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two variants of the same chats: rows in which both have replies and the same first prompt."""
    left, right = a.select(key, F.col("messages").alias("first")), b.select(key, F.col("messages").alias("second"))
    both = left.join(right, key)
    return both.filter(has_replies(F.col("first")) & has_replies(F.col("second")) & (prompt_of(F.col("first")) == prompt_of(F.col("second"))))


def cross_fill(items: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Items x questions x answers with <A> and <B> filled, one row for each (topic, question, answer), the first in order.

    items: id, topic, preference, opposite; questions: q_id, q_t; answers: a_id, a_t. Of equal templates only the first can be in a row, so each text is filled once;
    null templates count as one. Items and questions are dealt over all tasks, and of those pairs each meets the answers.
    """
    first = lambda rows, key, text: rows.groupBy(text).agg(F.min(F.struct(key))[key].alias(key))
    asked = items.crossJoin(first(questions, "q_id", "q_t"))
    rows = asked.repartition(tasks(asked), *asked.columns).crossJoin(first(answers, "a_id", "a_t"))
    fill = lambda t, a, b: F.replace(F.replace(t, F.lit("<A>"), a), F.lit("<B>"), b)
    a, b = F.col("preference"), F.col("opposite")
    full = rows.select("id", "topic", "preference", "opposite", "q_id", "a_id", fill(F.col("q_t"), a, b).alias("q_t"), fill(F.col("a_t"), a, b).alias("a_t"), fill(F.col("a_t"), b, a).alias("a_t_reversed"))
    return dedup(full, ["topic", "q_t", "a_t"], ["id", "q_id", "a_id"])


def complete_pairs(rows: DataFrame, key: str, variant: str, text: str, names: tuple[str, str], order: str) -> DataFrame:
    """(key, first, second) of keys that have both variants; the last row of each wins."""
    last = rows.groupBy(key, variant).agg(F.max(F.struct(order, text))[text].alias("t"))
    wide = last.groupBy(key).agg(*[F.max(F.when(F.col(variant) == n, F.col("t"))).alias(n) for n in names])
    return wide.filter(" AND ".join(f"`{n}` IS NOT NULL" for n in names))
