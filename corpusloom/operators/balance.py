"""Balanced choice: the least used candidate for each request in turn, and deals without repeats.

A choice depends on all before it, so a group's requests are served in order. They go in batches: a batch of each group is one task, which
takes the group's counters and hands them on, as tables. Where every request may take any candidate the rule has a closed form, and no order
of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import ordered
from corpusloom.operators.sample import group_rank
from corpusloom.sources.io import written

#: Requests of a group that one task serves before it hands its counters on.
BATCH = 20_000
#: What earlier uses of a pair cost, in uses of its members (a parameter's default).
REPEAT_COST = 3.0

OPTION = "struct<option:string,keys:array<string>,weights:array<double>,extra:double>"


def single_option(option, weight: float = 1.0, extra=0.0):
    """A candidate that is counted by itself."""
    name = option.cast("string")
    return F.struct(name.alias("option"), F.array(name).alias("keys"), F.array(F.lit(weight)).alias("weights"), F.lit(extra).cast("double").alias("extra") if isinstance(extra, (int, float)) else extra.cast("double").alias("extra"))


def pair_option(a, b, repeat: float = REPEAT_COST, extra=0.0):
    """A pair: each member's uses count once, those of the pair itself repeat times."""
    name = F.concat_ws("|", a.cast("string"), b.cast("string"))
    keys = F.array(F.concat(F.lit("1:"), a.cast("string")), F.concat(F.lit("1:"), b.cast("string")), F.concat(F.lit("2:"), name))
    cost = F.lit(extra).cast("double") if isinstance(extra, (int, float)) else extra.cast("double")
    return F.struct(name.alias("option"), keys.alias("keys"), F.array(F.lit(1.0), F.lit(1.0), F.lit(float(repeat))).alias("weights"), cost.alias("extra"))


def _serve(groups: list[str], seed: int):
    def serve(requests: Iterator[pd.DataFrame] | pd.DataFrame, counters: pd.DataFrame) -> pd.DataFrame:
        """One batch of one group: rows (kind 0) with what was picked, and the counters (kind 1) after it."""
        if requests.empty:
            return pd.DataFrame({"__kind": [1] * len(counters), **{g: counters[g] for g in groups}, "__at": None, "picked": counters["__key"], "cost": counters["__used"]})
        used = dict(zip(counters["__key"], counters["__used"], strict=True))
        same = {g: requests[g].iloc[0] for g in groups}
        rows = []
        for at, options in zip(*(requests.sort_values("__at")[c] for c in ("__at", "__options")), strict=True):
            best = None
            for o in options if options is not None else ():
                cost = o["extra"] + sum(w * used.get(k, 0) for k, w in zip(o["keys"], o["weights"], strict=True))
                rank = (cost, hashlib.sha256(f"{seed}:pick:{at}:{o['option']}".encode()).hexdigest())
                if best is None or rank < best[0]:
                    best = (rank, o)
            if best is not None:
                for k in best[1]["keys"]:
                    used[k] = used.get(k, 0) + 1
            rows.append((0, at, best[1]["option"] if best else None, best[0][0] if best else None))
        rows += [(1, None, k, n) for k, n in used.items()]
        out = pd.DataFrame(rows, columns=["__kind", "__at", "picked", "cost"]).astype({"cost": "float64"})
        out["__at"] = out["__at"].astype("Int64")
        return out.assign(**same)[["__kind", *groups, "__at", "picked", "cost"]]

    return serve


def pick_least(requests: DataFrame, groups: list[str], order: list[str], options: str, seed: int = 0, used: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(requests with at, picked and cost; counters (groups, key, used)): each request takes the option that costs least when its turn comes.

    An option (OPTION) costs its extra and, for each of its keys, a weight times the key's uses so far in the group; the chosen one's keys are each
    used once more. Ties go by the least digest of seed, place in the group, and option. used, if given, is where counting goes on. A request without
    options (null or empty) picks nothing; requests that tie in order need an order that tells them apart. Null groups are groups.
    """
    placed = written(ordered.rank(requests, groups, order, "at"), "requests")
    kinds = ", ".join(f"`{g}` {placed.schema[g].dataType.simpleString()}" for g in groups)
    rows = placed.select(*groups, F.col("at").alias("__at"), F.col(options).cast(f"array<{OPTION}>").alias("__options"))
    counters = used.select(*groups, F.col("key").alias("__key"), F.col("used").cast("long").alias("__used")) if used is not None else None
    if counters is None:
        counters = placed.sparkSession.createDataFrame([], f"{kinds}, __key string, __used long")
    done, rounds = [], (placed.agg(F.max("at")).first()[0] or 0) // BATCH + 1
    for k in range(rounds):
        batch = rows.filter((F.col("__at") >= k * BATCH) & (F.col("__at") < (k + 1) * BATCH))
        both = batch.groupBy(*groups).cogroup(counters.groupBy(*groups))
        out = written(both.applyInPandas(_serve(groups, seed), f"__kind int, {kinds}, __at long, picked string, cost double"), f"served-{k}")
        done.append(out.filter("__kind = 0").drop("__kind"))
        counters = out.filter("__kind = 1").select(*groups, F.col("picked").alias("__key"), F.col("cost").cast("long").alias("__used"))
    served = reduce(DataFrame.unionByName, done).select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], "__at", "picked", "cost")
    same = F.col("at") == F.col("__at")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    names = [f"__g{i}" for i in range(len(groups))]
    return placed.join(served, same).drop("__at", *names), counters.select(*groups, F.col("__key").alias("key"), F.col("__used").alias("used"))


def least_used(requests: DataFrame, candidates: DataFrame, groups: list[str], order: list[str], key: str, seed: int = 0) -> DataFrame:
    """Requests with at, lap and picked, where any candidate of the group will do: the closed form of the least used one.

    Each lap takes every candidate once, in the order of digests of seed, lap and candidate, which is what the rule gives if its ties go by them. Requests of a
    group without candidates are left out.
    """
    sizes = candidates.groupBy(*groups).agg(F.countDistinct(key).alias("__n"))
    placed = ordered.rank(requests, groups, order, "at").join(sizes, groups).withColumn("lap", F.floor(F.col("at") / F.col("__n"))).withColumn("__i", F.pmod("at", "__n"))
    laps = placed.groupBy(*groups).agg(F.max("lap").alias("__last"))
    turns = candidates.select(*groups, F.col(key).alias("picked")).distinct().join(laps, groups).withColumn("lap", F.explode(F.sequence(F.lit(0).cast("long"), "__last"))).drop("__last")
    turns = group_rank(turns, [*groups, "lap"], X.digest(seed, "lap", F.col("lap"), F.col("picked")), "__i", 0, None, ["picked"])
    return placed.join(turns, [*groups, "lap", "__i"]).drop("__n", "__i")


# --- deals without repeats ----------------------------------------------------------------------------------------------


def conflicts(rows: DataFrame, sets: list[str], chunk: str, place: str, key: str) -> DataFrame:
    """The rows whose key an earlier place of their chunk has."""
    again = F.row_number().over(Window.partitionBy(*sets, chunk, key).orderBy(place)) > 1
    return rows.withColumn("__again", again).filter("__again").drop("__again")


def _swaps(columns: list[str], chunk: str, place: str, key: str):
    def swaps(rows: pd.DataFrame) -> pd.DataFrame:
        """Two chunks: keys that one has twice change places with keys that the other has and it lacks, while that leaves neither with more repeats."""
        sides = [side.sort_values(place) for _, side in rows.sort_values(chunk).groupby(chunk)]
        if len(sides) < 2:
            return rows[columns]
        held = [side[key].tolist() for side in sides]
        for a, b in ((0, 1), (1, 0)):
            for i, k in enumerate(held[a]):
                if k in held[a][:i] and k not in held[b]:
                    j = next((j for j, m in enumerate(held[b]) if m not in held[a] and m in held[b][:j]), None)  # one that is twice there goes first
                    j = next((j for j, m in enumerate(held[b]) if m not in held[a]), None) if j is None else j
                    if j is not None:
                        held[a][i], held[b][j] = held[b][j], held[a][i]
        return pd.concat([side.assign(**{key: h}) for side, h in zip(sides, held, strict=True)])[columns]

    return swaps


def spread(rows: DataFrame, sets: list[str], chunk: str, place: str, key: str, chunks: int) -> tuple[DataFrame, int]:
    """Keys of rows (sets, chunk from 0, place) changed about within each set until no chunk has one twice; and the rounds that took.

    In round r chunk c meets chunk (r - c) modulo chunks: each has one partner, so all swaps of a round are made at once, and over all rounds
    each two chunks meet. Only chunks with a repeat and their partners move. A key that a set holds more often than it has chunks is an error, as is a
    chunk that no swap mends. A chunk is small by its nature: it is one call's list.
    """
    rows = written(rows.select(*sets, chunk, place, key), "spread")
    much = rows.groupBy(*sets, key).count().filter(F.col("count") > chunks).limit(1).collect()
    if much:
        raise ValueError(f"{much[0][key]} stands {much[0]['count']} times in {chunks} chunks")
    schema, rounds, since = rows.schema, 0, 0
    while True:
        bad = conflicts(rows, sets, chunk, place, key).select(*sets, F.col(chunk).alias("__c")).distinct()
        bad = written(bad, "repeats")
        left = bad.count()
        if not left:
            return rows, rounds
        if since > chunks:
            raise ValueError(f"no swap mends {left} chunks")
        partner = F.pmod(F.lit(rounds) - F.col("__c"), F.lit(chunks)).cast(schema[chunk].dataType)
        meet = bad.select(*sets, F.explode(F.array("__c", partner)).alias(chunk)).distinct()
        pair = F.least(F.col(chunk), F.pmod(F.lit(rounds) - F.col(chunk), F.lit(chunks)).cast(schema[chunk].dataType))
        moved = rows.join(meet, [*sets, chunk]).withColumn("__pair", pair)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        mended = moved.groupBy(*sets, "__pair").applyInPandas(_swaps(schema.names, chunk, place, key), kinds)
        after = written(rows.join(meet, [*sets, chunk], "left_anti").unionByName(mended), "spread")
        worse = conflicts(after, sets, chunk, place, key).count()
        since = 0 if worse < conflicts(rows, sets, chunk, place, key).count() else since + 1
        rows, rounds = after, rounds + 1


def deal_calls(rows: DataFrame, tier: str, key: str, kinds: list[str], calls: int, mix: dict[str, int], seed: int) -> tuple[DataFrame, dict[str, int]]:
    """(tier, kind, call, place, key), and the rounds of swaps by tier: for each kind so many calls, each with mix[tier] rows of each tier.

    Within a tier the rows are used in turn over one hashed order, kind after kind, so each is used as often as the others to within one; a kind's share is
    then shuffled by hash, cut into calls, and spread so that no call has a row twice. A tier without rows is an error; so is one that can't
    fill a call without repeating.
    """
    pool = written(group_rank(rows.select(F.col(tier).alias("tier"), F.col(key).alias("key")), ["tier"], X.digest(seed, "workplaces", F.col("key")), "i", 0, "n", ["key"]), "pool")
    sizes = {r["tier"]: r["n"] for r in pool.select("tier", "n").distinct().filter(F.col("tier").isin(list(mix))).collect()}  # a row for each asked tier
    spark, out, rounds = rows.sparkSession, None, {}
    for name, each in mix.items():
        if not each:
            continue
        if name not in sizes:
            raise ValueError(f"no row at {name}")
        m = calls * each
        seats = spark.range(len(kinds) * m).select((F.col("id") / m).cast("int").alias("k"), F.pmod("id", F.lit(m)).alias("j"), F.pmod("id", F.lit(sizes[name])).alias("i"))
        seats = group_rank(seats, ["k"], X.digest(seed, "window", F.lit(name), F.col("k"), F.col("j")), "r", 0, None, ["j"])
        taken = seats.join(pool.filter(F.col("tier") == name), "i").select("k", F.floor(F.col("r") / each).alias("call"), F.pmod("r", F.lit(each)).alias("place"), "key")
        dealt, rounds[name] = spread(taken, ["k"], "call", "place", "key", calls)
        dealt = dealt.select(F.lit(name).alias("tier"), F.element_at(F.array(*map(F.lit, kinds)), F.col("k") + 1).alias("kind"), "call", "place", "key")
        out = dealt if out is None else out.unionByName(dealt)
    return out, rounds
