"""Ranks and running sums within groups, in any order, without a group in one task.

Rows are dealt by ranges of (group, order): each part holds a run of that order, and a group that is larger than a part goes on in the next
ones. Sums by part give what stands before it in its group; a window within group and part gives the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.io import written

#: Rows of a part. A table of no more is one part, and a plain window does.
ROWS = 1_000_000


def _same(groups: list[str]) -> Column:
    out = F.lit(True)
    for i, g in enumerate(groups):
        out = out & F.col(f"`{g}`").eqNullSafe(F.col(f"__g{i}"))
    return out


def running(rows: DataFrame, groups: list[str], order: list[Column | str], sums: dict[str, Column], upto: bool = False) -> DataFrame:
    """Adds, under each name, the sum of its column over the rows of the group before each row (upto: and the row's own); null counts as 0.

    Rows that tie in order stand in any one order; give an order that tells them apart. Null groups are groups.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    last = 0 if upto else -1
    frame = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    parts = -(-rows.count() // ROWS)
    if parts <= 1:
        return rows.withColumns({n: F.coalesce(F.sum(c).over(frame(*(groups or [F.lit(0)]))), F.lit(0)) for n, c in sums.items()})
    own = {f"__v{i}": c for i, c in enumerate(sums.values())}
    dealt = written(rows.withColumns(own).repartitionByRange(parts, *groups, *order).withColumn("__part", F.spark_partition_id()), "ordered")
    totals = dealt.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__part").alias("__p")).agg(*[F.sum(v).alias(v) for v in own])
    names = [f"__g{i}" for i in range(len(groups))]
    before = Window.partitionBy(*(names or [F.lit(0)])).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over parts, not rows
    totals = totals.select(*names, "__p", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}b") for v in own])
    both = dealt.join(totals, (F.col("__part") == F.col("__p")) & _same(groups))
    found = {n: F.coalesce(F.sum(v).over(frame(*groups, "__part")), F.lit(0)) + F.col(f"{v}b") for n, v in zip(sums, own, strict=True)}
    return both.withColumns(found).drop("__part", "__p", *names, *own, *[f"{v}b" for v in own])


def rank(rows: DataFrame, groups: list[str], order: list[Column | str], name: str, first: int = 0) -> DataFrame:
    """Adds the row's place in its group."""
    return running(rows, groups, order, {name: F.lit(1)}).withColumn(name, (F.col(name) + first).cast("long"))
