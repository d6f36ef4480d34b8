"""Cards from a catalog: rules between options, names, prices, flags and kinds by hash order, and documents' state and reports."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.dealt import MOST_TASKS, meet, tasks
from corpusloom.operators.sample import global_rank


# --- rules --------------------------------------------------------------------------------------------------------------


def names_overlap(a: Column, b: Column) -> Column:
    """Whether one name holds the other, in any case."""
    x, y = F.lower(a), F.lower(b)
    return F.contains(x, y) | F.contains(y, x)


def counterfactual_ok(tier_a: Column, tier_b: Column, wider: Column) -> Column:
    """An everyday option against a premium one, and the everyday one sold more widely."""
    return (tier_a == "everyday") & (tier_b == "premium") & wider


def can_change(direction: str, tier: Column, sold: Column, fixed_by_name: Column) -> Column:
    """Whether a change in a direction would be news; a name that says where something is from or sold never changes."""
    news = (tier == "premium") | (sold == "specialty_only") if direction == "to_accessible" else (tier == "everyday") & (sold == "supermarket")
    return ~fixed_by_name & news


def valid_range(low: Column, high: Column) -> Column:
    return F.coalesce((low > 0) & (low <= high), F.lit(False))


def runs_together(first: Column, second: Column) -> Column:
    """Whether a join of two parts repeats letters at the seam."""
    a, b = F.lower(first), F.lower(second)
    return (F.right(a, F.lit(1)) == F.substring(b, 1, 1)) | F.endswith(a, F.substring(b, 1, 2)) | F.contains(a, b)


def brand_names(firsts: DataFrame, seconds: DataFrame, real: list[str]) -> DataFrame:
    """(first, second, name): every join that does not run together and is not real. Banks of parts are small by their nature."""
    both = firsts.select("first").distinct().join(seconds.select("second").distinct(), ~runs_together(F.col("first"), F.col("second")))
    return both.withColumn("name", F.concat("first", F.lower("second"))).filter(~F.lower("name").isin([r.lower() for r in real]))


def shared_uses(a: Column, b: Column, same_family: Column, broad: list[str]) -> Column:
    """Uses that two options share; between families none of the broad ones."""
    both = F.array_intersect(a, b)
    return F.when(same_family, both).otherwise(F.array_except(both, F.array(*map(F.lit, broad)).cast("array<string>")))


def first_pool(counts: list[Column]) -> Column:
    """The place of the first pool that is not empty."""
    return F.coalesce(*[F.when(c > 0, i) for i, c in enumerate(counts)])


def kind_counts(n: int, shares: dict[str, float], paired: str, rest: str) -> dict[str, int]:
    """Shares of n as counts; one kind comes in pairs, one takes what is left."""
    out = {k: 2 * round(n * s / 2) if k == paired else round(n * s) for k, s in shares.items() if k != rest}
    out[rest] = n - sum(out.values())
    if out[rest] < 0:
        raise ValueError(f"no room is left: {out}")
    return out


# --- draws by hash order ------------------------------------------------------------------------------------------------


def flags(rows: DataFrame, key: str, share: float, seed: int, name: str = "flag") -> DataFrame:
    """Exactly round(n * share) rows get a flag: those with the least hashes. Ranks come from counts by hash prefix."""
    n = rows.count()
    return global_rank(rows, X.digest(seed, name, F.col(key)), "__rank").withColumn(name, F.col("__rank") < round(n * share)).drop("__rank")


def spread(rows: DataFrame, key: str, shares: dict[str, float], seed: int, name: str = "level") -> DataFrame:
    """Levels in given shares over the rows in hash order; rounding goes to the last one."""
    n, at, levels = rows.count(), 0, list(shares)
    choice = F.lit(levels[-1])
    cuts = []
    for level in levels[:-1]:
        at += round(n * shares[level])
        cuts.append((level, at))
    for level, cut in reversed(cuts):
        choice = F.when(F.col("__rank") < cut, level).otherwise(choice)
    return global_rank(rows, X.digest(seed, name, F.col(key)), "__rank").withColumn(name, choice).drop("__rank")


def numbered(rows: DataFrame, key: str, group: str, seed: int, digits: int = 5) -> DataFrame:
    """Ids c00001 on over groups in hash order, the rows of a group next to each other by key; groups are small (twins)."""
    ranked = global_rank(rows.select(group).distinct(), X.digest(seed, "unit", F.col(group)), "__unit")
    size = rows.groupBy(group).agg(F.count("*").alias("__size")).join(ranked, group)
    before = size.withColumn("__o", F.lpad(F.hex("__unit"), 16, "0"))
    # Twins share a size in practice; the running sum is over units by prefix of their rank, like global_rank's.
    block = F.floor(F.col("__unit") / 4096)
    sums = before.groupBy(block.alias("__b")).agg(F.sum("__size").alias("__t"))
    sums = sums.withColumn("__before", F.sum("__t").over(Window.orderBy("__b")) - F.col("__t")).drop("__t")
    inside = F.sum("__size").over(Window.partitionBy("__b").orderBy("__unit")) - F.col("__size")
    starts = before.withColumn("__b", block).join(sums, "__b").select(group, (F.col("__before") + inside).alias("__start"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(key))
    return rows.join(starts, group).withColumn("card_id", F.concat(F.lit("c"), F.lpad((F.col("__start") + place).cast("string"), digits, "0"))).drop("__start")


def action_order(seed: int, key: Column, first: Column, second: Column) -> Column:
    """Two options, flipped for half the cards by a hash."""
    flip = X.hash_share(12, seed, "order", key) < 0.5
    return F.when(flip, F.array(second, first)).otherwise(F.array(first, second))


#: Passages of a block, about: a card meets a kind's blocks one by one.
BLOCK = 16384
#: How many passages of a kind are expected below the hash that the first look takes, for each that is asked for and one more.
LOOK = 4
#: Pairs of a task, about.
TASK_PAIRS = 1 << 28


def drawn(cards: DataFrame, card: str, kind: str, passages: DataFrame, passage: str, line: str, per_card: int, seed: int) -> DataFrame:
    """Each card's passages of its kind with the least hashes, as an array in the order of their lines.

    A hash is of a card and a passage, so each pair of a kind has its own, and time grows with their number. A kind's passages lie in blocks of bounded size. The first
    look hashes each pair in compiled code and holds only what is below a limit, which leaves a few for each card; a card for which that is too few goes over its kind's
    blocks again. No other pair moves or is written.
    """
    some = passages.filter(F.col(passage).isNotNull()).select(F.col(kind).alias("__kind"), F.struct(F.col(passage).cast("string").alias("id"), F.col(line).alias("line"), F.col(passage).alias("passage")).alias("__p"))
    sizes = some.groupBy("__kind").agg(F.count("*").alias("__n"))
    one = cards.groupBy(F.col(card), F.col(kind).alias("__kind")).agg(F.count("*").cast("int").alias("__rows"))
    work = one.groupBy("__kind").agg(F.count("*").alias("__c")).join(sizes.hint("merge"), "__kind").agg(F.count("*"), F.sum(F.col("__c").cast("double") * F.col("__n"))).first()
    n = max(tasks(cards), min(MOST_TASKS, math.ceil((work[1] or 0) / TASK_PAIRS)))
    placed = some.join(sizes.hint("merge"), "__kind").withColumn("__block", F.pmod(F.xxhash64("__p.passage", "__p.line"), F.ceil(F.col("__n") / BLOCK)))
    blocks = placed.groupBy("__kind", "__n", "__block").agg(F.collect_list("__p").alias("__p")).select("__kind", "__n", F.col("__p.id").alias("__ids"), F.col("__p.line").alias("__lines"), F.col("__p.passage").alias("__passages"))

    of = F.concat_ws(":", F.lit(str(seed)), F.lit("passages"), F.col(card).cast("string"), F.lit(""))
    look = LOOK * (per_card + 1)
    limit = F.when(F.col("__n") <= look, "g").otherwise(F.lpad(F.lower(F.hex(F.floor(F.lit(look * 16.0**7) / F.col("__n")).cast("long"))), 7, "0"))
    met = meet(one.withColumn("__of", of), blocks.withColumn("__limit", limit).withColumn("__ids", F.array_append("__ids", F.lit(None))), ["__kind"], work[0], n)
    # The null at the end of a block is held for each card, so that one without any hash below the limit is there too.
    met = met.select("__kind", "__part", card, "__rows", "__n", "__of", "__limit", "__lines", "__passages", F.posexplode("__ids").alias("__at", "__id"))
    hashed = F.sha2(F.concat("__of", "__id"), 256)
    held = met.filter(F.col("__id").isNull() | (hashed < F.col("__limit")))
    held = held.select("__kind", "__part", card, "__rows", "__n", F.when(F.col("__id").isNotNull(), F.struct(hashed.alias("h"), F.get("__lines", "__at").alias("line"), F.get("__passages", "__at").alias("passage"))).alias("__p"))
    # The join is dealt by kind and part, so this moves nothing.
    few = held.groupBy("__kind", "__part", card, "__rows", "__n").agg(F.collect_list("__p").alias("__p"))
    least = lambda c: F.slice(F.sort_array(c), 1, per_card)
    enough = F.size("__p") >= F.least(F.lit(per_card), F.col("__n"))
    # Only cards with too few find blocks in this join, by their kind and its size; the others are spread over keys that no block has.
    few = few.select(card, "__kind", "__rows", least(F.col("__p")).alias("__p"), F.when(enough, -1 - F.pmod(F.xxhash64(card), F.lit(1024))).otherwise(F.col("__n")).alias("__again"))
    again = few.join(blocks.select("__kind", F.col("__n").alias("__again"), "__ids", "__lines", "__passages").hint("merge"), ["__kind", "__again"], "left")
    whole = F.transform(F.arrays_zip("__ids", "__lines", "__passages"), lambda x: F.struct(F.sha2(F.concat(of, x["__ids"]), 256).alias("h"), x["__lines"].alias("line"), x["__passages"].alias("passage")))
    taken = F.when(F.col("__ids").isNull(), F.col("__p")).otherwise(least(whole))
    # A card that comes in several rows takes a passage for each of them, as a join has it.
    repeated = F.flatten(F.transform(taken, lambda x: F.array_repeat(x, F.col("__rows"))))
    chosen = again.select(card, repeated.alias("__p")).groupBy(card).agg(least(F.flatten(F.collect_list("__p"))).alias("p"))
    return chosen.select(card, F.transform(F.sort_array(F.transform("p", lambda x: F.struct(x["line"].alias("l"), x["passage"].alias("id")))), lambda x: x["id"]).alias("passages"))


def price_pair(seed: int, key: Column, low: Column, high: Column, ratio: tuple[float, float], top: float) -> Column:
    """Two prices to the dime within a ratio and a ceiling, by hashes of the key: struct(low, high); null where none fit."""
    draw = lambda name, least, most: least + F.floor(X.hash_share(8, seed, name, key) * (most - least + 1))
    least, most = F.ceil(low * 10 - 1e-6), F.floor(F.least(high, F.lit(top / ratio[0])) * 10 + 1e-6)
    a = draw("low", least, most)
    b_least, b_most = F.ceil(a * ratio[0] - 1e-6), F.floor(F.least(a * ratio[1], F.lit(top * 10)) + 1e-6)
    return F.when((least <= most) & (a > 0) & (b_least <= b_most), F.struct((a / 10).alias("low"), (draw("high", b_least, b_most) / 10).alias("high")))


def twin_cards(rows: DataFrame, low: str, high: str) -> DataFrame:
    """Each row twice with its prices swapped: variant 0 has the first option cheaper."""
    pair = F.explode(F.array(*[F.struct(F.lit(i).alias("variant"), F.col(a).alias("price_a"), F.col(b).alias("price_b")) for i, (a, b) in enumerate(((low, high), (high, low)))]))
    return rows.withColumn("__p", pair).select(*rows.columns, "__p.*")


def excluding_draws(corpora: list[DataFrame], text: str, counts: list[int], seed: int) -> list[DataFrame]:
    """From each corpus in turn so many texts by hash order, none that an earlier corpus has given."""
    taken, out = None, []
    for rows, n in zip(corpora, counts, strict=True):
        fresh = rows.withColumn("__sha", F.sha1(F.col(text)))
        fresh = fresh if taken is None else fresh.join(taken, "__sha", "left_anti")
        one = fresh.dropDuplicates(["__sha"])
        chosen = global_rank(one, X.digest(seed, "draw", F.col("__sha")), "__rank").filter(F.col("__rank") < n).drop("__rank")
        keys = chosen.select("__sha")
        taken = keys if taken is None else taken.unionByName(keys)
        out.append(chosen.drop("__sha"))
    return out


# --- catalogs -----------------------------------------------------------------------------------------------------------


def catalog(entries: DataFrame, required: DataFrame, name: str, place: str) -> DataFrame:
    """The first entry of each name in any case, and required names that lack one as uncertain rows."""
    key = F.lower(F.trim(name))
    first = entries.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(place))).filter("__n = 1").drop("__n").withColumn("uncertain", F.lit(False))
    missing = required.select(F.col(name).alias("__r")).distinct().join(first.select(F.lower(F.trim(name)).alias("__k")), F.lower(F.trim("__r")) == F.col("__k"), "left_anti")
    return first.unionByName(missing.select(F.col("__r").alias(name), F.lit(True).alias("uncertain")), allowMissingColumns=True)


def duplicates(rows: DataFrame, name: str) -> DataFrame:
    """Names that come more than once in any case."""
    return rows.groupBy(F.lower(F.trim(name)).alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


def group_rows(cards: DataFrame, group: str, split: str, card: str, kind: str, options: list[str], holdout: Column) -> DataFrame:
    """One row a group: its split, kind, cards and option names in order, and whether any is held out."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(*options)))))
    return cards.groupBy(group).agg(F.min(split).alias("split"), F.min_by(kind, card).alias("kind"), F.array_sort(F.collect_list(card)).alias("cards"), names.alias("options"), F.bool_or(holdout).alias("holdout"))


def reused(units: DataFrame, unit: str, card: str, reserve: str, accepted: DataFrame) -> DataFrame:
    """Units all of whose cards an earlier run accepted are main ones; the others are the reserve, the earlier reserve first."""
    known = accepted.select(card).distinct().withColumn("__ok", F.lit(True))
    by = units.join(known, card, "left").groupBy(unit).agg(F.bool_and(F.coalesce("__ok", F.lit(False))).alias("accepted"), F.bool_or(reserve).alias("was_reserve"), F.count("*").alias("cards"))
    return by.select(unit, "cards", (~F.col("accepted")).alias("reserve"), F.when(F.col("accepted"), 0).when(F.col("was_reserve"), 1).otherwise(2).alias("turn"))


# --- state of documents and their reports --------------------------------------------------------------------------------


def side_states(attempts: DataFrame, keys: list[str], attempt: str, passed: str, most: int) -> DataFrame:
    """passed if an attempt has, failed once the attempts are used up, open otherwise; and which attempt was the last."""
    by = attempts.groupBy(*keys).agg(F.bool_or(passed).alias("ok"), F.max(attempt).alias("last"), F.count("*").alias("attempts"))
    return by.select(*keys, "last", "attempts", F.when(F.col("ok"), "passed").when(F.col("last") + 1 >= most, "failed").otherwise("open").alias("state"))


def card_states(sides: DataFrame, card: str, expected: int = 2) -> DataFrame:
    """accepted if every side has passed, failed if one has, open otherwise."""
    n = F.count(F.when(F.col("state") == "passed", 1))
    return sides.groupBy(card).agg(F.when(F.bool_or(F.col("state") == "failed"), "failed").when(n >= expected, "accepted").otherwise("open").alias("state"))


def pass_rates(attempts: DataFrame, groups: list[str], attempt: str, passed: str, final: DataFrame, keys: list[str]) -> DataFrame:
    """By group: first tries that passed and were made, and sides that passed and are done."""
    first = attempts.filter(F.col(attempt) == 0).groupBy(*groups).agg(F.count(F.when(F.col(passed), 1)).alias("first_passed"), F.count("*").alias("first_tries"))
    of = attempts.select(*groups, *keys).distinct()
    done = of.join(final, keys).filter("state <> 'open'").groupBy(*groups).agg(F.count(F.when(F.col("state") == "passed", 1)).alias("final_passed"), F.count("*").alias("final_done"))
    return first.join(done, groups, "left").na.fill(0, ["final_passed", "final_done"])


def reason_counts(rows: DataFrame, groups: list[str], reasons: str) -> DataFrame:
    """How often each reason's code comes, by group."""
    return rows.select(*groups, F.explode(reasons).alias("r")).groupBy(*groups, F.split_part("r", F.lit(":"), F.lit(1)).alias("code")).agg(F.count("*").alias("n"))


def reserve_use(units: DataFrame, kind: str, active: str, reserve: str, failed: str) -> DataFrame:
    """By kind: reserve units that are active, all of them, and failed units that the reserve could not replace."""
    used = F.count(F.when(F.col(active) & F.col(reserve), 1))
    lost = F.count(F.when(F.col(active) & F.col(failed), 1))
    return units.groupBy(kind).agg(used.alias("used"), F.count(F.when(F.col(reserve), 1)).alias("available"), F.greatest(lost - used, F.lit(0)).alias("short"))


def document_stats(rows: DataFrame, groups: list[str], words: Column, values: Column, copied: Column, longest: Column) -> DataFrame:
    """By group: documents, mean words, value words per thousand, the share of copied words, documents that copy, the longest run."""
    per = rows.select(*groups, words.alias("w"), values.alias("v"), copied.alias("c"), longest.alias("l"))
    total = F.greatest(F.sum("w"), F.lit(1))
    return per.groupBy(*groups).agg(
        F.count("*").alias("documents"), F.round(F.avg("w")).cast("long").alias("mean_words"), F.round(F.sum("v") * 1000 / total, 2).alias("values_per_1000"), F.round(F.sum("c") / total, 4).alias("copied_share"),
        F.round(F.avg((F.col("l") > 0).cast("double")), 3).alias("copying"), F.max("l").alias("longest"),
    )


def audit_problems(checks: dict[str, Column], chosen: Column, expected: Column, reason: Column, wanted: Column) -> Column:
    """Codes of a failed audit: the choice, the reason, then the flags that hold."""
    said = F.lower(F.trim(F.split_part(reason, F.lit("("), F.lit(1))))
    odd = F.when(~chosen.eqNullSafe(expected), F.concat(F.lit("chosen: "), F.when(chosen.isin("none", "several", "unknown"), chosen).otherwise("other")))
    why = F.when(said != wanted, F.concat(F.lit("reason: "), F.when(said == "", "none").otherwise(said)))
    return F.array_compact(F.array(odd, why, *[F.when(c, F.lit(n)) for n, c in checks.items()]))


def label_fit(items: DataFrame, predicted: DataFrame, key: str, label: str) -> DataFrame:
    """Predicted against actual labels: items, how many are right, and how many have no prediction."""
    both = items.select(key, F.col(label).alias("want")).join(predicted.select(key, F.col(label).alias("got")), key, "left")
    return both.groupBy("want").agg(F.count("*").alias("items"), F.count(F.when(F.col("want") == F.col("got"), 1)).alias("right"), F.count(F.when(F.col("got").isNull(), 1)).alias("missing"))


def facts_view(facts: Column, stated: Column, opening: bool) -> Column:
    """What a writer sees of a map of facts: for an opening only those that it is to state."""
    return F.map_filter(facts, lambda k, _: F.array_contains(stated, k)) if opening else facts


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))
