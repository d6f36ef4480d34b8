"""Documents written in rounds: what is due, which logged rows still hold, accepted pairs, and text assembled with its offsets.

Tables: cards (card_id, position, card_sha, ...); openings (card_id, card_sha, prompt_sha, attempt, prefix, passed, ...); branches (card_id, card_sha, prompt_sha,
opening, opening_sha, branch, attempt, text, ...); checks (card_id, card_sha, opening, branch, attempt, branch_sha, passed, ...). A log's rows are in the order of
its _seq, and of attempts within it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.dedup import dedup

BRANCHES = ("pos", "neg")


def content_sha(*parts: Column) -> Column:
    """A short key of content: stale rows no longer have it."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)


# --- replay --------------------------------------------------------------------------------------------------------------


def in_turn(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with attempt and _seq: those whose attempt is the next one of their key when the log comes to them.

    The first row of each attempt counts, and attempt n only if n - 1 has counted before it; the rest is stale.
    """
    first = dedup(rows, [*keys, "attempt"], ["_seq"], "first")
    own = Window.partitionBy(*keys).orderBy("attempt")
    good = (F.col("attempt") == F.row_number().over(own) - 1) & (F.col("_seq") >= F.coalesce(F.lag("_seq").over(own), F.col("_seq")))
    marked = first.withColumn("__good", good)
    return marked.withColumn("__good", F.min(F.col("__good").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)) == 1).filter("__good").drop("__good")


def _standing(rows: DataFrame, at: DataFrame, fields: list[str]) -> DataFrame:
    """The rows that at has too, by card_id and fields. What at has of a card is little, so it is one row; all meet by card alone, and stay dealt by it for what follows."""
    some = F.struct(*fields)
    known = lambda df: df.filter(" AND ".join(f"{f} IS NOT NULL" for f in fields))
    own = known(at).groupBy("card_id").agg(F.collect_set(some).alias("__at"))
    return known(rows).join(own, "card_id").filter(F.array_contains("__at", some)).drop("__at")


def held_openings(openings: DataFrame, cards: DataFrame, prompt_sha: str | None = None) -> DataFrame:
    """Logged openings whose card and prompt are unchanged, in turn."""
    rows = _standing(openings, cards, ["card_sha"])
    return in_turn(rows.filter(F.col("prompt_sha") == prompt_sha) if prompt_sha else rows, ["card_id"])


def held_branches(branches: DataFrame, openings: DataFrame, prompt_sha: str | None = None) -> DataFrame:
    """Logged branches whose card and prompt are unchanged and whose opening is the one that stands at its place, by content.

    openings are held ones, so a branch of an opening's card is of a card that is unchanged.
    """
    at = openings.select("card_id", "card_sha", F.col("attempt").alias("opening"), content_sha(F.col("prefix")).alias("opening_sha"))
    rows = _standing(branches, at, ["card_sha", "opening", "opening_sha"])
    return in_turn(rows.filter(F.col("prompt_sha") == prompt_sha) if prompt_sha else rows, ["card_id", "opening", "branch"])


def held_checks(checks: DataFrame, branches: DataFrame) -> DataFrame:
    """The last check of each branch attempt that stands (branches are held ones), if the text it read is the one that stands there."""
    at = branches.select("card_id", "card_sha", "opening", "branch", "attempt", content_sha(F.col("text")).alias("branch_sha"))
    rows = _standing(checks, at, ["card_sha", "opening", "branch", "attempt", "branch_sha"])
    return dedup(rows, ["card_id", "opening", "branch", "attempt"], ["_seq"], "last")


def replayed(cards: DataFrame, openings: DataFrame, branches: DataFrame, checks: DataFrame, prompts: tuple[str | None, str | None] = (None, None)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three logs as of now: only what still holds."""
    o = held_openings(openings, cards, prompts[0])
    b = held_branches(branches, o, prompts[1])
    return o, b, held_checks(checks, b)


# --- states, and what is due -----------------------------------------------------------------------------------------------


def current_openings(openings: DataFrame) -> DataFrame:
    """Each card's first opening that passed: branches are written on it alone."""
    return dedup(openings.filter("passed"), ["card_id"], ["attempt"], "first")


def sides(cards: DataFrame, openings: DataFrame, branches: DataFrame, checks: DataFrame, most: int) -> DataFrame:
    """(card_id, opening, branch, attempts, state) of each card with an opening: write, check, passed or failed."""
    both = F.explode(F.array(*map(F.lit, BRANCHES))).alias("branch")
    each = current_openings(openings).join(cards.select("card_id"), "card_id", "left_semi").select("card_id", F.col("attempt").alias("opening"), both)
    keys = ["card_id", "opening", "branch"]
    last = branches.groupBy(*keys).agg(F.max("attempt").alias("last"), F.count("*").alias("attempts"))
    verdict = checks.select(*keys, F.col("attempt").alias("last"), F.col("passed"))
    rows = each.join(last, keys, "left").join(verdict, [*keys, "last"], "left")
    n = F.coalesce("attempts", F.lit(0))
    state = F.when(n == 0, "write").when(F.col("passed").isNull(), "check").when(F.col("passed"), "passed").when(n >= most, "failed").otherwise("write")
    return rows.select(*keys, n.alias("attempts"), state.alias("state"))


def states(cards: DataFrame, openings: DataFrame, sides: DataFrame, most_openings: int) -> DataFrame:
    """(card_id, state) of each card: accepted, failed, or open."""
    tries = openings.groupBy("card_id").agg(F.count("*").alias("n"), F.bool_or("passed").alias("opened"))
    by = sides.groupBy("card_id").agg(F.bool_or(F.col("state") == "failed").alias("failed"), F.bool_and(F.col("state") == "passed").alias("passed"))
    rows = cards.select("card_id").join(tries, "card_id", "left").join(by, "card_id", "left")
    opened = F.coalesce("opened", F.lit(False))
    state = F.when(~opened, F.when(F.coalesce("n", F.lit(0)) >= most_openings, "failed").otherwise("open")).when(F.col("failed"), "failed").when(F.col("passed"), "accepted").otherwise("open")
    return rows.select("card_id", state.alias("state"))


def openings_due(cards: DataFrame, openings: DataFrame, most: int) -> DataFrame:
    """Cards without an opening that passed, with tries left: their columns, and attempt."""
    tries = openings.groupBy("card_id").agg(F.count("*").cast("int").alias("attempt"), F.bool_or("passed").alias("__opened"))
    rows = cards.join(tries, "card_id", "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    return rows.filter(~F.coalesce("__opened", F.lit(False)) & (F.col("attempt") < most)).drop("__opened")


def branches_due(cards: DataFrame, openings: DataFrame, sides: DataFrame) -> DataFrame:
    """Sides to be written: the card's columns, opening, its prefix, branch and attempt. A card with a failed side needs none."""
    lost = sides.filter("state = 'failed'").select("card_id").distinct()
    due = sides.filter("state = 'write'").join(lost, "card_id", "left_anti").select("card_id", "opening", "branch", F.col("attempts").cast("int").alias("attempt"))
    return due.join(current_openings(openings).select("card_id", "prefix"), "card_id").join(cards, "card_id")


def checks_due(cards: DataFrame, sides: DataFrame, branches: DataFrame) -> DataFrame:
    """The last attempts that nothing has checked: the card's columns, opening, branch, attempt and text."""
    due = sides.filter("state = 'check'").select("card_id", "opening", "branch", (F.col("attempts") - 1).cast("int").alias("attempt"))
    return due.join(branches.select("card_id", "opening", "branch", "attempt", "text"), ["card_id", "opening", "branch", "attempt"]).join(cards, "card_id")


# --- accepted pairs ---------------------------------------------------------------------------------------------------------


def seeded_openings(cards: DataFrame, openings: DataFrame, earlier: DataFrame, prompt_sha: str) -> DataFrame:
    """Openings to log as the first ones of cards that have none: those on which an earlier run's accepted pair was written.

    earlier (card_id, card_sha, prompt_sha, prefix, run). A card that is not the earlier run's, or another prompt, is an error when the rows are read.
    """
    own = cards.join(openings.select("card_id").distinct(), "card_id", "left_anti").select("card_id", F.col("card_sha").alias("own"))
    rows = earlier.join(own, "card_id")
    odd = F.when(F.col("card_sha") != F.col("own"), F.concat(F.col("card_id").cast("string"), F.lit(": its card is not the one that "), F.col("run"), F.lit(" wrote on")))
    odd = odd.when(F.col("prompt_sha") != prompt_sha, F.concat(F.lit("the opening prompt has changed since "), F.col("run")))
    passed = F.when(odd.isNotNull(), F.raise_error(odd).cast("boolean")).otherwise(F.lit(True))
    return rows.select("card_id", "card_sha", "prompt_sha", F.lit(0).alias("attempt"), "prefix", passed.alias("passed"), F.col("run").alias("reused_from"))


def pair_rows(cards: DataFrame, openings: DataFrame, branches: DataFrame, sides: DataFrame, more: list[str] = ()) -> DataFrame:
    """Accepted cards as pairs: position, pair_id, text_pos, text_neg, continuation_start_char, the attempts, and for each of more its pos and neg.

    A branch's row may have a continuation_start_char of its own (its two sides must agree, else the row is an error); without that
    column the opening's length is where it starts.
    """
    passed = sides.filter("state = 'passed'").select("card_id", "opening", "branch", (F.col("attempts") - 1).cast("int").alias("attempt"))
    final = passed.join(branches, ["card_id", "opening", "branch", "attempt"])
    own = "continuation_start_char" in branches.columns
    fields = ["text", "attempt", *more, *(["continuation_start_char"] if own else [])]
    of = lambda b: F.first(F.when(F.col("branch") == b, F.struct(*fields)), ignorenulls=True).alias(b)
    both = final.groupBy("card_id", "opening").agg(of("pos"), of("neg")).filter("pos IS NOT NULL AND neg IS NOT NULL")
    at = openings.select("card_id", F.col("attempt").alias("opening"), F.length("prefix").alias("__n"))
    rows = both.join(at, ["card_id", "opening"]).join(cards.select("card_id", "position"), "card_id")
    start = F.col("__n")
    if own:
        same = F.col("pos.continuation_start_char").eqNullSafe(F.col("neg.continuation_start_char"))
        start = F.when(same, F.col("pos.continuation_start_char")).otherwise(F.raise_error(F.concat(F.col("card_id").cast("string"), F.lit(": the two branches start at different characters"))).cast("int"))
    return rows.select(
        "position", F.col("card_id").alias("pair_id"), F.col("pos.text").alias("text_pos"), F.col("neg.text").alias("text_neg"), start.cast("int").alias("continuation_start_char"),
        F.struct("opening", F.col("pos.attempt").alias("pos"), F.col("neg.attempt").alias("neg")).alias("attempts"), *[F.struct(F.col(f"pos.{m}").alias("pos"), F.col(f"neg.{m}").alias("neg")).alias(m) for m in more],
    )


def sample_markdown(pairs: DataFrame, n: int | None, seed: int, title: str) -> DataFrame:
    """(position, markdown) of a page of pairs to read: the title first, then n of them (null: all) by hash, in the order of cards."""
    text = lambda c, a, b=None: F.trim(F.substr(c, a, F.lit((1 << 31) - 1) if b is None else b))
    start = F.col("continuation_start_char")
    chosen = pairs if n is None else pairs.orderBy(X.digest(seed, "sample", F.col("pair_id")), "pair_id").limit(n)
    body = F.concat(
        F.lit("## "), F.col("pair_id").cast("string"), F.lit("\n\n**Opening**\n\n"), text(F.col("text_pos"), F.lit(1), start),
        F.lit("\n\n**pos**\n\n"), text(F.col("text_pos"), start + 1), F.lit("\n\n**neg**\n\n"), text(F.col("text_neg"), start + 1), F.lit("\n"),
    )
    head = chosen.agg(F.count("*").alias("k")).crossJoin(pairs.agg(F.count("*").alias("all")))  # one row each
    head = head.select(F.lit(-1).cast("long").alias("position"), F.concat(F.lit("# "), F.col("k").cast("string"), F.lit(" of "), F.col("all").cast("string"), F.lit(f" accepted pairs ({title})\n")).alias("markdown"))
    return head.unionByName(chosen.select(F.col("position").cast("long").alias("position"), body.alias("markdown")))


# --- assembly ----------------------------------------------------------------------------------------------------------------


def assembled(parts: list[tuple[str, Column]]) -> Column:
    """struct(text, spans): parts (name, text) joined, with the place of each: name, start and end in code points. A null part is empty.

    Whatever is known of a part is known of the whole, by its start: nothing is searched for again.
    """
    texts = [F.coalesce(t, F.lit("")) for _, t in parts]
    span = lambda name, at, n: F.struct(F.lit(name).alias("name"), at.cast("int").alias("start"), (at + n).cast("int").alias("end"))
    zero = F.lit(0)

    def placed(held: Column) -> Column:
        lengths = [F.length(held[f"t{i}"]) for i in range(len(parts))]
        starts = [reduce(lambda a, b: a + b, lengths[:i], zero) for i in range(len(parts))]
        return F.struct(F.concat(*[held[f"t{i}"] for i in range(len(parts))]).alias("text"), F.array(*[span(n, s, k) for (n, _), s, k in zip(parts, starts, lengths, strict=True)]).alias("spans"))

    return X.let(F.struct(*[t.alias(f"t{i}") for i, t in enumerate(texts)]), placed)


def start_of(whole: Column, name: str) -> Column:
    """Where a named part starts."""
    return F.get(F.filter(whole["spans"], lambda s: s["name"] == name), F.lit(0))["start"]


def part_at(whole: Column, place: Column) -> Column:
    """The name of the part that a place of the whole belongs to, and the place in it; null beyond the end."""
    found = F.get(F.filter(whole["spans"], lambda s: (s["start"] <= place) & (place < s["end"])), F.lit(0))
    return F.when(found.isNotNull(), F.struct(found["name"].alias("name"), (place - found["start"]).alias("at")))


def document(opening: Column, before: Column, stem: Column, option: Column, after: Column, action_first: Column) -> Column:
    """A branch's document from its parts: text, continuation_start_char, choice_char and end_char, all from the parts' places.

    The decision is stem and option and a full stop, or whatever sentence end after begins with. With nothing before the decision and the action first, both branches
    share the stem, so the continuation starts at the option.
    """
    whole = assembled([("opening", opening), ("before", before), ("stem", stem), ("option", option), ("after", after)])

    def fields(w: Column) -> Column:
        option_at, opening_end = start_of(w, "option"), start_of(w, "before")
        shared = action_first & (start_of(w, "stem") == opening_end)
        tail = F.coalesce(after, F.lit(""))
        stop = F.regexp_extract(tail, r"(?s)^(.*?(?:[.!?](?=[\s\"')\]]|$)|\n))", 1)
        end = F.when(stop == "", F.length(w["text"])).otherwise(start_of(w, "after") + F.length(stop))
        return F.struct(w["text"].alias("text"), F.when(shared, option_at).otherwise(opening_end).alias("continuation_start_char"), option_at.alias("choice_char"), end.cast("int").alias("end_char"), w["spans"].alias("spans"))

    return X.let(whole, fields)
