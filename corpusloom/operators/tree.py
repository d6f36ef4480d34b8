"""Trees in a parent-child table: paths, depths, and settings inherited from the nearest ancestor, at any depth.

Each round a node takes over what the node it points to knows, and then points where that one does: after k rounds it has seen 2 ** k ancestors, so
a tree of any depth takes a number of joins that is the logarithm of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.io import written


def inherited(nodes: DataFrame, node: str, parent: str, settings: list[str], name: str | None = None) -> DataFrame:
    """Each node with depth (0 for a root), root, orphan (an ancestor's parent is not in the table), settings from itself or else its nearest ancestor, and path (names from the root, joined
    by /) if a name column is given.

    A node with a null parent is a root, and so is one whose parent is missing. A cycle is an error that names a node of it; so is a node that is there twice.
    """
    twice = nodes.groupBy(node).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"node {twice[0][node]} is there {twice[0]['count']} times")
    known = nodes.select(F.col(node).alias("__known"))
    rows = nodes.join(known, F.col(parent) == F.col("__known"), "left")
    label = [F.col(name).cast("string").alias("path")] if name else []
    state = rows.select(
        F.col(node).alias("node"), F.col("__known").alias("up"), F.when(F.col("__known").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col(node).alias("root"),
        (F.col(parent).isNotNull() & F.col("__known").isNull()).alias("orphan"), *[F.col(s) for s in settings], *label,
    )
    state, total, rounds = written(state, "tree"), nodes.count(), 0
    while state.filter("up IS NOT NULL").limit(1).count():
        if 1 << rounds > total:
            bad = state.filter("up IS NOT NULL").agg(F.min("node").alias("n")).first()["n"]
            raise ValueError(f"node {bad} is on or below a cycle")
        above = state.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("depth").alias("__depth"), F.col("root").alias("__root"), F.col("orphan").alias("__orphan"), *[F.col(s).alias(f"__{s}") for s in settings], *([F.col("path").alias("__path")] if name else []))
        both = state.join(above, "up", "left")
        state = written(
            both.select(
                "node", F.col("__up").alias("up"), (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"), F.coalesce("__root", "root").alias("root"), (F.col("orphan") | F.coalesce("__orphan", F.lit(False))).alias("orphan"),
                *[F.coalesce(s, f"__{s}").alias(s) for s in settings], *([F.concat_ws("/", "__path", "path").alias("path")] if name else []),
            ), "tree",
        )
        rounds += 1
    return state.drop("up").withColumnRenamed("node", node)


def of_listing(paths: DataFrame, path: str) -> DataFrame:
    """Nodes of a folder listing: path and parent of every file and of every folder above one."""
    parts = F.split(F.trim(F.col(path), F.lit("/")), "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), F.when(n > 1, F.array_join(F.slice(parts, F.lit(1), n - 1), "/")).alias("parent"), F.element_at(parts, n).alias("name")))
    return paths.select(F.explode(every).alias("n")).select("n.*").distinct()
