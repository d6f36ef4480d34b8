"""Hash-ordered draws, quotas, apportionment, budgets and splits.

Every draw orders by a hash of a key, so it does not depend on partitioning, and is the same on any cluster. Ranks within strata, and
over whole tables, come from counts by hash prefix, so that a stratum with most of the rows is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import ordered

#: Rows that one task ranks; the number of prefixes follows from it.
ROWS_A_PREFIX = 100_000


def _digits(n: int) -> int:
    """Hex digits of prefixes that hold so many rows each: three at least."""
    digits = 3
    while n > ROWS_A_PREFIX * 16**digits:
        digits += 1
    return digits


def group_rank(rows: DataFrame, groups: list[str], order: Column, name: str = "rank", first: int = 0, size: str | None = None, tie: list[str] = ()) -> DataFrame:
    """Rank of each row in its group by a hex digest column, and the group's size if a name for it is given: no group goes to one task.

    Rows are counted by group and by the digest's first digits; a running sum over those counts gives each prefix's offset, and a
    window inside group and prefix the rest. Prefixes grow with the table, so a window holds about ROWS_A_PREFIX rows at most.
    """
    digits = _digits(rows.count())
    keyed = rows.withColumn("__o", order).withColumn("__p", F.substring("__o", 1, digits))
    counts = keyed.groupBy(*groups, "__p").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))  # over counts by prefix, not rows
    before = counts.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__p").alias("__q"), (F.sum("__n").over(w.orderBy("__p")) - F.col("__n")).alias("__before"), F.sum("__n").over(w).alias("__size")
    )
    same = F.col("__p") == F.col("__q")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = F.row_number().over(Window.partitionBy(*groups, "__p").orderBy("__o", *tie)) - 1
    ranked = keyed.withColumn("__inside", inside).join(before, same).withColumn(name, (F.col("__before") + F.col("__inside") + first).cast("long"))
    ranked = ranked.withColumn(size, F.col("__size")) if size else ranked
    return ranked.drop("__o", "__p", "__q", "__inside", "__before", "__size", *[f"__g{i}" for i in range(len(groups))])


def global_rank(rows: DataFrame, order: Column, name: str = "rank", first: int = 0) -> DataFrame:
    """Rank of each row by a hex digest column over the whole table."""
    return group_rank(rows, [], order, name, first)


def split_of(rank: Column, size: Column, test: float, dev: float, at_least_one: bool = True) -> Column:
    """test, dev or train by rank from 1; shares round half to even, and give one group at least if asked to."""
    held = lambda share: F.when(F.lit(share) > 0, F.greatest(F.bround(size * share), F.lit(1 if at_least_one else 0))).otherwise(0)
    return F.when(rank <= held(test), "test").when(rank <= held(test) + held(dev), "dev").otherwise("train")


def group_split(rows: DataFrame, group: str, kind: str, seed: int, test: float, dev: float, at_least_one: bool = True, holdout: Column | None = None, keep: DataFrame | None = None) -> DataFrame:
    """(kind, group, n_rows, split): groups never straddle splits; ranks are within a kind, by SHA-256 of seed:split:group.

    A group with any holdout row goes to test, outside the ranks. keep (group, split) overrides; groups it lacks are train then.
    """
    flag = F.coalesce(F.bool_or(holdout), F.lit(False)) if holdout is not None else F.lit(False)
    groups = rows.groupBy(kind, group).agg(F.count("*").alias("n_rows"), flag.alias("held"))
    if keep is not None:
        known = keep.select(F.col(group).alias("__g"), F.col("split").alias("__s"))
        return groups.join(known, F.col(group) == F.col("__g"), "left").select(kind, group, "n_rows", F.coalesce("__s", F.lit("train")).alias("split"))
    ranked = group_rank(groups, [kind, "held"], X.digest(seed, "split", F.col(group)), "r", 1, "n", [group])
    return ranked.select(kind, group, "n_rows", F.when(F.col("held"), "test").otherwise(split_of(F.col("r"), F.col("n"), test, dev, at_least_one)).alias("split"))


def hamilton(sizes: DataFrame, group: str, size: str, total: int) -> DataFrame:
    """Largest-remainder apportionment of total over groups: (group, size, share). Ties go by the group's name. One row a group."""
    every = Window.partitionBy(F.lit(0))
    exact = F.col(size) * total / F.sum(size).over(every)
    rows = sizes.withColumn("__x", exact).withColumn("__f", F.floor("__x"))
    order = F.row_number().over(every.orderBy((F.col("__f") - F.col("__x")), group))
    return rows.withColumn("share", (F.col("__f") + F.when(order <= total - F.sum("__f").over(every), 1).otherwise(0)).cast("long")).drop("__x", "__f")


def stratified(rows: DataFrame, strata: str, order: Column, quota: Column) -> DataFrame:
    """The first quota rows of each stratum by a hex digest, with rank_in (from 1)."""
    return group_rank(rows, [strata], order, "rank_in", 1).filter(F.col("rank_in") <= quota).withColumn("rank_in", F.col("rank_in").cast("int"))


def interleave(rows: DataFrame, strata: str, order: Column, held: int = 0) -> DataFrame:
    """Adds held_out (the last so many of each stratum by a hex digest) and place in (0, 1): ordered by (place, stratum), strata are evenly mixed."""
    ranked = group_rank(rows, [strata], order, "__r", 0, "__all").withColumn("__cut", F.col("__all") - held).drop("__all")
    return ranked.withColumn("held_out", F.col("__r") >= F.col("__cut")).withColumn("place", F.when(~F.col("held_out"), (F.col("__r") + 0.5) / F.col("__cut"))).drop("__r", "__cut")


def token_budget(rows: DataFrame, tokens: str, order: str, budget: int, by: list[str]) -> DataFrame:
    """By group, the shortest prefix in order whose tokens reach the budget; adds tokens_before."""
    return ordered.running(rows, by, [order], {"tokens_before": F.col(tokens)}).filter(F.col("tokens_before") < budget)


def oversample(rows: DataFrame, strata: str, order: Column, n: int) -> DataFrame:
    """Exactly n rows of each stratum: its first n by a hex digest, or all of them round after round."""
    ranked = group_rank(rows, [strata], order, "rank_in", 1, "__n")
    times = F.floor((n - F.col("rank_in")) / F.col("__n")) + 1
    return ranked.filter(F.col("rank_in") <= n).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).drop("__n")


def stride(rows: DataFrame, index: str, shard: int, shards: int) -> DataFrame:
    return rows.filter(F.pmod(F.col(index), F.lit(shards)) == shard)


def shard_bounds(n: int, shards: int) -> list[tuple[int, int]]:
    """Contiguous index ranges."""
    edges = [round(k * n / shards) for k in range(shards + 1)]
    return list(zip(edges, edges[1:], strict=False))


def round_robin(rows: DataFrame, kind: str, dimension: str, order: Column) -> DataFrame:
    """Adds position within a kind: dimensions take turns, the commonest first; order decides within one."""
    ranked = ordered.rank(rows.withColumn("__o", order), [kind, dimension], ["__o"], "__r")
    sizes = rows.groupBy(F.col(kind).alias("__k"), F.col(dimension).alias("__d")).agg(F.count("*").alias("__n"))
    sized = ranked.join(sizes, F.col(kind).eqNullSafe(F.col("__k")) & F.col(dimension).eqNullSafe(F.col("__d")))
    placed = ordered.rank(sized, [kind], ["__r", F.desc("__n"), dimension], "position", 1)
    return placed.withColumn("position", F.col("position").cast("int")).drop("__r", "__n", "__k", "__d", "__o")


def family_holdouts(rows: DataFrame, family: str, key: str, share: float, seed: int) -> DataFrame:
    """About share of all keys, spread over families: each family's first by hash, then its second, and so on.

    Whole turns come from counts by turn, and the last, partial turn has one key a family at most.
    """
    order = X.digest(seed, "holdout", F.col(key))
    ranked = group_rank(rows, [family], order, "in_family", 1, None, [key]).withColumn("in_family", F.col("in_family").cast("int"))
    sizes = rows.groupBy(family).agg(F.count("*").alias("__n")).groupBy("__n").agg(F.count("*").alias("__families"))
    # Families of a size: all turns up to it hold them, so the first k keys end in the turn that the sizes give.
    size = {int(r["__n"]): int(r["__families"]) for r in sizes.collect()}
    left = int(sizes.agg(F.bround(F.coalesce(F.sum(F.col("__n") * F.col("__families")), F.lit(0)) * F.lit(share))).first()[0])
    families, before, turn = sum(size.values()), 0, 0
    for n in sorted(size):
        whole = min((n - before), left // families)
        turn, left = turn + whole, left - whole * families
        if whole < n - before:
            break
        before, families = n, families - size[n]
    part = ranked.filter(F.col("in_family") == turn + 1).orderBy(order, key).limit(left)
    return ranked.filter(F.col("in_family") <= turn).unionByName(part)


def unique_names(rows: DataFrame, name: str, order: str, by: list[str]) -> DataFrame:
    """Repeated names get _2, _3, ... in order."""
    n = F.col("__n")
    return ordered.rank(rows, [*by, name], [order], "__n", 1).withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat_ws("_", F.col(name), n.cast("string")))).drop("__n")


def nested_top(rows: DataFrame, levels: list[tuple[list[str], str, int]]) -> DataFrame:
    """For each (parents, child, n) in turn, the first n children of each parent, by name."""
    for parents, child, n in levels:
        rank = F.dense_rank().over(Window.partitionBy(*parents).orderBy(child))
        rows = rows.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")
    return rows


def conflict_assignment(rows: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """Adds is_conflict: exactly floor(n * ratio) keys, by hash."""
    ranked = global_rank(rows, X.digest(seed, "conflict", F.col(key)))
    return ranked.crossJoin(F.broadcast(rows.agg(F.count("*").alias("__n")))).withColumn("is_conflict", F.col("rank") < F.floor(F.col("__n") * ratio)).drop("__n", "rank")  # one row


def pool_pairing(rows: DataFrame, pool: DataFrame, index: str, key: str, seed: int) -> DataFrame:
    """Each row with the pool's row at its index modulo the pool's size, the pool in hash order."""
    ordered = global_rank(pool, X.digest(seed, "pool", F.col(key)), "pool_index")
    size = pool.agg(F.count("*").alias("__n"))
    return rows.crossJoin(F.broadcast(size)).withColumn("pool_index", F.pmod(F.col(index), F.col("__n"))).drop("__n").join(ordered, "pool_index")  # one row


def reserve_fixpoint(units: DataFrame, kind: str, position: str, failed: str, reserve: str) -> DataFrame:
    """Active units: the main ones, and of a kind's reserve, in order, as many as there are failures among the active ones.

    The least number k with k = failures(main) + failures(first k of the reserve): the first place at which reserves that
    passed have made up for all failures of the main units, from running sums rather than rounds.
    """
    need = units.groupBy(F.col(kind).alias("__k")).agg(F.sum(F.when(~F.col(reserve) & F.col(failed), 1).otherwise(0)).alias("__need"))
    passed = ordered.running(units, [kind], [reserve, position], {"__passed": F.when(F.col(reserve) & ~F.col(failed), 1).otherwise(0)})
    return passed.join(need, F.col(kind).eqNullSafe(F.col("__k"))).withColumn("active", ~F.col(reserve) | (F.col("__passed") < F.col("__need"))).drop("__k", "__need", "__passed")


def equal_shards(rows: DataFrame, order: list[str], world: int, size: int) -> DataFrame:
    """Rows dealt to shards of exactly equal size in full batches: adds shard, batch and weight; what is missing is filled with copies of the first row, of weight 0.

    Row i goes to shard i mod world, and a shard's row k to batch k div size. Sums that use the weight are those of the rows alone. No rows, no shards.
    """
    ranked = ordered.rank(rows, [], order, "__i")
    n = rows.count()
    total = world * size * -(-(-(-n // world)) // size)
    first = ranked.filter("__i = 0").drop("__i")
    more = rows.sparkSession.range(n, total).withColumnRenamed("id", "__i").crossJoin(F.broadcast(first))  # one row
    both = ranked.withColumn("weight", F.lit(1)).unionByName(more.withColumn("weight", F.lit(0)))
    return both.withColumns({"shard": F.pmod("__i", F.lit(world)).cast("int"), "batch": F.floor(F.floor(F.col("__i") / world) / size)}).drop("__i")
