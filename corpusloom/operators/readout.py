"""Token-level read-outs over long-form rows or array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position_buckets(deltas: DataFrame, values: str, starts: list[int], by: list[str]) -> DataFrame:
    """Mean by position bucket [s_k, s_k+1), and over all (bucket -1)."""
    each = deltas.select(*by, F.posexplode(values).alias("pos", "v"))
    bucket = F.lit(None).cast("int")
    for k, s in enumerate(starts):
        bucket = F.when(F.col("pos") >= s, k).otherwise(bucket)
    both = each.withColumn("bucket", F.explode(F.array(bucket, F.lit(-1)))).filter("bucket IS NOT NULL")
    return both.groupBy(*by, "bucket").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def token_sums(rows: DataFrame, token: str, value: str) -> DataFrame:
    return rows.groupBy(token).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def margin_share(scores: DataFrame, score: str, positive: Column, by: list[str], beta: float, gamma: float, slots: int = 4096) -> DataFrame:
    """Share of all (positive, negative) pairs with beta * (s+ - s-) > gamma, counted exactly without forming a pair.

    Positives are moved down by gamma / beta; a pair counts if the negative stands below the moved positive. Ranks come from value
    histograms: counts of distinct values, a running sum over slots of values, and one inside each slot.
    """
    moved = scores.withColumn("__x", F.when(positive, F.col(score) - gamma / beta).otherwise(F.col(score))).filter(F.col(score).isNotNull())
    counts = moved.groupBy(*by, "__x").agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    bounds = counts.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    both = counts.join(bounds, on) if by else counts.crossJoin(F.broadcast(bounds))  # one row
    placed = both.select(*by, "__x", "p", "q", F.floor((F.col("__x") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * slots).alias("slot"))
    below = F.sum("q").over(Window.partitionBy(*by, "slot").orderBy("__x")) - F.col("q")
    inside = placed.withColumn("below", below).groupBy(*by, "slot").agg(F.sum(F.col("p") * F.col("below")).alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    before = F.sum("q").over(Window.partitionBy(*by or [F.lit(0)]).orderBy("slot")) - F.col("q")  # slots + 1 rows a group
    total = inside.withColumn("before", before).groupBy(*by).agg(F.sum(F.col("won") + F.col("p") * F.col("before")).alias("wins"), (F.sum("p") * F.sum("q")).alias("pairs"))
    return total.withColumn("share", F.when(F.col("pairs") > 0, F.col("wins") / F.col("pairs")))


def classify(own: Column, cross: Column, threshold: float, band: float) -> Column:
    """Class of a position by its own and cross effects: none, then by sign and by how close the two are."""
    big_own, big_cross = F.abs(own) >= threshold, F.abs(cross) >= threshold
    close = F.abs(own - cross) <= band
    return (
        F.when(big_own & big_cross & close & (own > 0), "shared_up").when(big_own & big_cross & close, "shared_down")
        .when(big_own & big_cross & (F.sign(own) != F.sign(cross)), "opposed").when(big_own & big_cross & (F.abs(own) > F.abs(cross)), "own_more").when(big_own & big_cross, "cross_more")
        .when(big_own, "own").when(big_cross, "cross").otherwise("none")
    )


def top_by_group(rows: DataFrame, by: list[str], item: str, value: str, n: int) -> DataFrame:
    """The n items of each group with the greatest sums; ties by item."""
    sums = rows.groupBy(*by, item).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("total"), item))).filter(F.col("rank") <= n)


def region_means(rows: DataFrame, labels: dict[str, Column], region: str, measures: list[str]) -> DataFrame:
    """Means by region of overlapping named groups and all (an explode of labels, one pass); non-finite values are left out by measure."""
    groups = F.explode(F.array_compact(F.array(F.lit("all"), *[F.when(c, n) for n, c in labels.items()])))
    finite = lambda m: F.when(F.abs(m) < float("inf"), F.col(m))
    return rows.withColumn("group", groups).groupBy("group", region).agg(F.count("*").alias("n"), *[F.avg(finite(m)).alias(m) for m in measures])


def shares_of(rows: DataFrame, by: list[str], kind: str, mass: str) -> DataFrame:
    """Share of rows and of absolute mass by kind within each group."""
    sums = rows.groupBy(*by, kind).agg(F.count("*").alias("n"), F.sum(F.abs(mass)).alias("mass"))
    w = Window.partitionBy(*by or [F.lit(0)])
    return sums.select(*by, kind, "n", (F.col("n") / F.sum("n").over(w)).alias("share"), F.when(F.sum("mass").over(w) > 0, F.col("mass") / F.sum("mass").over(w)).alias("mass_share"))


def offsets(documents: DataFrame, rows: str, shard: str, order: str) -> DataFrame:
    """Adds first_row: where each document's rows begin in the merged cache. Sums run within shards, and over shards."""
    inside = F.sum(rows).over(Window.partitionBy(shard).orderBy(order)) - F.col(rows)
    totals = documents.groupBy(shard).agg(F.sum(rows).alias("__t"))
    before = totals.select(shard, (F.sum("__t").over(Window.orderBy(shard)) - F.col("__t")).alias("__before"))  # one row a shard
    return documents.withColumn("__in", inside).join(before, shard).withColumn("first_row", F.col("__before") + F.col("__in")).drop("__in", "__before")


def pack_by_length(documents: DataFrame, tokens: str, budget: int, bucket: int) -> DataFrame:
    """Adds batch: documents of like length (a bucket of tokens) in groups whose padded size stays within a token budget."""
    padded = F.ceil(F.col(tokens) / bucket) * bucket
    per = F.greatest(F.floor(F.lit(budget) / padded), F.lit(1))
    n = F.row_number().over(Window.partitionBy(padded).orderBy(tokens)) - 1
    return documents.withColumn("batch", F.concat_ws("-", padded.cast("string"), F.floor(n / per).cast("string")))


def spectrum(vectors: DataFrame, vector: str, by: str, top_k: int) -> DataFrame:
    """(by, n, effective_rank, concentration, frobenius) of each group's matrix, from its Gram matrix: sums of outer products.

    Each batch of rows adds up to one matrix, so a group moves its Gram matrices, never its rows.
    """
    kind = vectors.schema[by].dataType.simpleString()

    def gram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, part in frame.groupby(by, dropna=False):
                m = np.array(part[vector].tolist(), np.float64)
                yield pd.DataFrame({by: [key], "n": [len(m)], "gram": [(m.T @ m).ravel()]})

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        g = np.sum(np.stack(group["gram"].to_numpy()), axis=0)
        d = int(round(len(g) ** 0.5))
        s = np.sqrt(np.clip(np.linalg.eigvalsh(g.reshape(d, d)), 0, None))[::-1]
        p = s / max(s.sum(), 1e-12)
        p = p[p > 0]
        return pd.DataFrame({by: [group[by].iloc[0]], "n": [int(group["n"].sum())], "effective_rank": [float(np.exp(-(p * np.log(p)).sum()))], "concentration": [float(s[:top_k].sum() / max(s.sum(), 1e-12))], "frobenius": [float(np.sqrt((s**2).sum()))]})

    rows = vectors.filter(F.col(vector).isNotNull()).select(by, vector).mapInPandas(gram, f"`{by}` {kind}, n long, gram array<double>")
    return rows.groupBy(by).applyInPandas(solve, f"`{by}` {kind}, n long, effective_rank double, concentration double, frobenius double")
