"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in edges (a, b).

    Each round a node takes the least label among its own and its neighbours', then the label of that label, until nothing
    changes; every round is written, so lost executors cost one round. Labels meet neighbours in joins whose two sides are
    both dealt out anew, so a hub can be split.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))  # a union would find the edges twice
    both = materialize(edges.filter("a <> b").select(ways.alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = materialize(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "hooked")
        of = hooked.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        jumped = materialize(hooked.join(of, "label").select("node", "old", F.least("label", "beyond").alias("label")), "labels")
        changed = jumped.filter("old <> label").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
