"""Exact top-k inner products by multi-resolution segment statistics.

A vector's segments at each level have a mean and a deviation each. For segments of m components,
sum m * ((mq - mx)^2 + (sq - sx)^2) never exceeds the squared distance, so sum m * (mq * mx + sq * sx) is never less than the
inner product (score = (|q|^2 + |x|^2 - distance^2) / 2). Levels go from coarse to fine. At each, the exact scores of the pairs
with the greatest bounds raise a query's limit (its k-th best score so far), and a pair whose bound is below the limit falls out;
surviving pairs get exact integer products, and only those can rank.

Queries and candidates meet in blocks: a task holds CANDIDATES candidates and QUERIES queries at most, and hands on k rows a
query. Ties go to the smaller id. Products are exact at any size of the components: in doubles where they fit, else in
longs, else in unbounded integers (a score beyond a long is given as the nearest long).

Defined cases: null vectors and vectors with null or non-finite components take no part; vectors of different length do not
meet; an id's own rows are no candidates for it; repeated ids rank each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, parallelism

K, SCALE, QUERY_STEP = 20, 64, 20
#: Rows of a block; queries that are looked at together; least candidates of a block.
CANDIDATES, QUERIES, QUERY_TILE, LEAST = 32_768, 8_192, 128, 2_048
#: Segments of each level, coarse to fine; levels of more than half the components are left out but for the half itself.
LEVELS = (4, 16, 64, 256)
_NONE = np.iinfo(np.int64).min


def integers(vector: Column) -> Column:
    """floor(SCALE * x) of each component; null where the vector takes no part. Doubles of 2**53 or more are whole."""
    x = vector.cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.coalesce(whole, F.lit(False)) & (F.size(x) > 0), F.transform(x, lambda v: F.when(F.abs(v * SCALE) < float(1 << 53), F.floor(v * SCALE).cast("double")).otherwise(v * SCALE)))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, so weighted that two rows' product bounds their inner product."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).round().astype(int)
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        part = x[:, a:b]
        mean = part.mean(axis=1)
        out += [np.sqrt(b - a) * mean, np.sqrt(np.maximum(((part - mean[:, None]) ** 2).sum(axis=1), 0))]
    return np.stack(out, axis=1)


def levels_of(size: int) -> list[int]:
    """The segments of each level for vectors of a size."""
    half = max(1, size // 2)
    return sorted({min(n, half) for n in LEVELS})


def products(q: np.ndarray, c: np.ndarray):
    """A function of rows of q and of c (position arrays) to exact inner products, either all of them or those of pairs."""
    size = np.linalg.norm(q, axis=1).max(initial=0) * np.linalg.norm(c, axis=1).max(initial=0)
    if size >= 1 << 52:  # no partial sum exceeds it
        kind = np.int64 if size < 1 << 62 else object
        q, c = ([[int(v) for v in row] for row in x.tolist()] for x in (q, c))
        q, c = np.array(q, kind), np.array(c, kind)

    def of(rows: np.ndarray, columns: np.ndarray, pairs: bool = False) -> np.ndarray:
        found = (q[rows] * c[columns]).sum(axis=-1) if pairs else q[rows] @ c[columns].T
        if found.dtype == object:
            found = np.frompyfunc(lambda v: max(_NONE + 1, min(v, np.iinfo(np.int64).max)), 1, 1)(found) if found.size else found
        return np.rint(found).astype(np.int64) if found.dtype == float else found.astype(np.int64)

    return of


def search(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's best k of the candidates (all of them, if fewer): position in q, position in c, score. cid must ascend.

    seen, if given, counts pairs, and how many of them each level has ruled out.
    """
    out, exact = [], products(q, c)
    tolerance = 1e-9 * np.linalg.norm(c, axis=1).max(initial=0)
    levels = [(n, statistics(q, n), statistics(c, n)) for n in levels_of(q.shape[1])]
    for at in range(0, len(q), QUERY_TILE):
        rows = np.arange(at, min(at + QUERY_TILE, len(q)))
        slack = tolerance * np.linalg.norm(q[rows], axis=1) + 1e-6
        own = qid[rows][:, None] == cid[None]
        alive, limit, columns, left = ~own, np.full(len(rows), -np.inf), np.arange(len(c)), [int(own.size - own.sum())]
        for _, a, b in levels:
            bound = np.where(alive[:, columns], a[rows] @ b[columns].T, -np.inf)
            some = min(len(columns), 4 * k + 4)
            if some >= k:  # the pairs with the greatest bounds raise the limit
                best = columns[np.argpartition(bound, len(columns) - some, axis=1)[:, len(columns) - some :]]
                scores = np.where(np.take_along_axis(alive, best, 1), exact(np.repeat(rows, some).reshape(len(rows), some), best, pairs=True), _NONE)
                kth = np.partition(scores, some - k, axis=1)[:, some - k]
                limit = np.maximum(limit, np.where(kth > _NONE, kth - slack, -np.inf))
            alive[:, columns] &= bound >= limit[:, None]
            left.append(int(alive.sum()))
            columns = np.flatnonzero(alive.any(axis=0))
        alive = alive[:, columns]
        if alive.sum() * 16 < alive.size:
            score = np.full(alive.shape, _NONE)
            i, j = np.nonzero(alive)
            score[i, j] = exact(rows[i], columns[j], pairs=True)
        else:
            score = np.where(alive, exact(rows, columns), _NONE)
        if seen is not None:
            seen["pairs"] = seen.get("pairs", 0) + left[0]
            for (n, _, _), x, y in zip(levels, left, left[1:], strict=False):
                seen[n] = seen.get(n, 0) + x - y
        if len(columns) > k:  # all above the k-th best score, and of those that equal it the smallest ids
            kth = np.partition(score, len(columns) - k, axis=1)[:, len(columns) - k][:, None]
            tie = score == kth
            keep = (score > kth) | (tie & (np.cumsum(tie, axis=1) <= k - (score > kth).sum(axis=1, keepdims=True)))
        else:
            keep = np.ones(score.shape, bool)
        i, j = np.nonzero(keep & (score > _NONE))
        out.append((rows[i], columns[j], score[i, j]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _block(k: int):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        of = lambda part: (part["vec_id"].to_numpy(np.int64), np.array(part["x"].tolist(), np.float64))
        asks, has = rows[rows["ask"]], rows[~rows["ask"]].sort_values("vec_id")
        if asks.empty or has.empty:
            return empty
        (qid, q), (cid, c) = of(asks), of(has)
        i, j, score = search(qid, q, cid, c, k)
        return pd.DataFrame({"query_id": qid[i], "vec_id": cid[j], "score": score})

    return block


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. Of a query id that stands in several rows, the best scores of all."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), integers(F.col(vector)).alias("x"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = materialize(rows.filter("x IS NOT NULL AND vec_id IS NOT NULL").withColumn("n", F.size("x")), "vectors")
    size = rows.agg(F.count("*").alias("all"), F.sum(F.col("query").cast("long")).alias("asks")).first()
    shards = max(-(-size["all"] // CANDIDATES), min(parallelism(spark), -(-size["all"] // LEAST)), 1)
    blocks = max(-(-(size["asks"] or 0) // QUERIES), 1)
    tie = F.xxhash64("vec_id")
    has = rows.select("n", "vec_id", "x", F.lit(False).alias("ask"), F.pmod(tie, F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    asks = rows.filter("query").select("n", "vec_id", "x", F.lit(True).alias("ask"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(tie, F.lit(blocks)).alias("block"))
    parts = has.unionByName(asks).repartition(max(parallelism(spark), shards * blocks), "n", "shard", "block")
    found = parts.groupBy("n", "shard", "block").applyInPandas(_block(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.pmod("vec_id", F.lit(QUERY_STEP)) == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
