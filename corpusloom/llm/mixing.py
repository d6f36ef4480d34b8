"""Mixing sources to target weights by temperature, on DataFrame functions alone.

1. Texts are read once for a narrow table (source, tokens, key), which is written; all that follows is decided on it.
2. Tokens by source give shares p. Weights are p ** a, normalised: a = 1 is the natural mix, a = 0 a uniform one.
3. The exponent is bisected: the least one (the flattest mix) under which no source is repeated more often than a limit, or the
   one whose weights have a target entropy. The driver holds the distinct sizes of sources and how many sources have each, not the sources.
4. Weights become rows. A source's documents stand in hashed blocks of about BLOCK_DOCUMENTS; an epoch is a permutation of the
   blocks, with the documents of a block in a hashed order. Whole epochs take every document; the last one takes the longest prefix of the
   permutation that fits the budget. The prefix ends at one place a source, so rows are chosen where they are read: no text is moved.

The budget is a number of tokens, or "cover": the least budget under which every document comes once at least. Tokens are words
unless a column has their number, as a native path can call no tokenizer.

Defined cases: a null source is a source of its own; null text has no tokens, and rows without tokens come in every whole
epoch; repeated rows count each; rows that share id and text go together; an empty table gives an empty result; the
input's columns come back as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, text_of

#: The flattest mix that repeats no source more often; documents of a block.
REPEATS, BLOCK_DOCUMENTS, SEED = 4.0, 4096, 17


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def hashed(*parts: Column) -> Column:
    """60 bits of an MD5 over parts, which any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def shares_of(sizes: dict[int, int], exponent: float) -> dict[int, float]:
    """From how many sources have each size: the weight of one source of that size."""
    top = max(sizes, default=0)
    raw = {n: math.exp(exponent * math.log(n / top)) if n else 0.0 for n in sizes}
    total = sum(raw[n] * k for n, k in sorted(sizes.items())) or 1.0
    return {n: x / total for n, x in raw.items()}


def entropy(sizes: dict[int, int], shares: dict[int, float]) -> float:
    return -sum(sizes[n] * p * math.log(p) for n, p in shares.items() if p > 0)


def budget_of(sizes: dict[int, int], shares: dict[int, float], budget: int | str | None) -> float:
    if budget == "cover":
        return max((n / w for n, w in shares.items() if w), default=0.0)
    return float(sum(n * k for n, k in sizes.items()) if budget is None else budget)


def bisect(sizes: dict[int, int], budget: int | str | None = None, repeats: float | None = REPEATS, target_entropy: float | None = None, steps: int = 60) -> float:
    """The exponent in [0, 1]."""

    def flat_enough(a: float) -> bool:
        shares = shares_of(sizes, a)
        if target_entropy is not None:
            return entropy(sizes, shares) <= target_entropy
        total = budget_of(sizes, shares, budget)
        return all(w * total <= repeats * n * (1 + 1e-12) for n, w in shares.items() if n)

    low, high = 0.0, 1.0
    if flat_enough(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if flat_enough(middle) else (middle, high)
    return high


def plan(rows: DataFrame, budget=None, repeats=REPEATS, target_entropy=None) -> DataFrame:
    """From rows (source, tokens): source, documents, size (its tokens), target (tokens that the mix takes), epochs (whole ones),
    rest (tokens of the last, partial one), blocks. One row a source."""
    by = materialize(rows.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("size")), "sources")
    sizes = {r["size"]: r["n"] for r in by.groupBy("size").agg(F.count("*").alias("n")).collect()}
    shares = shares_of(sizes, bisect(sizes, budget, repeats, target_entropy))
    total = budget_of(sizes, shares, budget)
    targets = rows.sparkSession.createDataFrame([(n, math.floor(w * total + 0.5)) for n, w in sorted(shares.items())], "size long, target long")
    epochs = F.when(F.col("size") > 0, F.floor(F.col("target") / F.when(F.col("size") > 0, F.col("size")))).otherwise(1)
    return (
        by.join(targets, "size").withColumn("epochs", epochs.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("size"))
        .select("source", "documents", "size", "target", "epochs", "rest", F.ceil(F.col("documents") / BLOCK_DOCUMENTS).alias("blocks"))
    )


def _placed(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Rows (source, key, ...) with their source's plan, block and the block's place in the permutation."""
    s = sources.withColumnRenamed("source", "plan_source")
    out = rows.join(s, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("block", F.pmod("key", "blocks"))
    return out.withColumn("block_order", hashed(F.lit(str(seed + 1)), F.coalesce("source", F.lit("")), F.col("block").cast("string")))


def limits(rows: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """source, epochs, blocks, end (the block's place at which the last epoch ends, null if it does not), cut (the key there at which it does)."""
    small = _placed(rows, sources, seed).filter("rest > 0").select("source", "rest", "block_order", "key", "tokens")
    # A block's documents are about BLOCK_DOCUMENTS, so running sums go over a source's blocks, and then over one block a source.
    blocks = small.groupBy("source", "rest", "block_order").agg(F.sum("tokens").alias("t"))
    blocks = blocks.withColumn("upto", F.sum("t").over(Window.partitionBy("source").orderBy("block_order")))
    ends = blocks.filter("upto > rest").groupBy("source").agg(F.min(F.struct("block_order", (F.col("upto") - F.col("t")).alias("before"))).alias("e"))
    ends = materialize(ends.select(F.col("source").alias("end_source"), F.col("e.block_order").alias("end"), F.col("e.before").alias("before")), "ends")
    last = small.join(ends, F.col("source").eqNullSafe(F.col("end_source")) & (F.col("block_order") == F.col("end")))
    keys = last.groupBy("source", "rest", "before", "key").agg(F.sum("tokens").alias("t"))
    inside = F.col("before") + F.sum("t").over(Window.partitionBy("source").orderBy("key"))
    cut = keys.withColumn("upto", inside).filter("upto > rest").groupBy("source").agg(F.min("key").alias("cut")).withColumnRenamed("source", "cut_source")
    out = sources.join(ends, F.col("source").eqNullSafe(F.col("end_source")), "left").join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    return materialize(out.select("source", "epochs", "rest", "blocks", "end", "cut"), "limits")


def _keys(docs: DataFrame, source: str, doc_id: str, text: str, seed: int) -> list[Column]:
    key = hashed(F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(text_of(text).cast("binary")))
    return [F.col(source).cast("string").alias("source"), key.alias("key")]


def _times(rows: DataFrame, limit: DataFrame, seed: int) -> DataFrame:
    """Rows (source, key, ...) with times (how often the mix takes them) and block_order."""
    placed = _placed(rows, limit, seed)
    before = F.col("end").isNull() | (F.col("block_order") < F.col("end")) | ((F.col("block_order") == F.col("end")) & (F.col("key") < F.col("cut")))
    return placed.withColumn("times", (F.col("epochs") + F.when((F.col("rest") > 0) & before, 1).otherwise(0)).cast("int"))


def _epochs() -> Column:
    return F.explode(F.when(F.col("times") > 0, F.sequence(F.lit(0), F.col("times") - 1)).otherwise(F.array().cast("array<int>")))


def decided(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", tokens: str | None = None, budget: int | str | None = None, repeats: float | None = REPEATS, target_entropy: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The narrow table (id, source, tokens, key), and each source's limits."""
    count = F.coalesce(F.col(tokens).cast("long"), F.lit(0).cast("long")) if tokens else word_count(text_of(text))
    narrow = materialize(docs.select(F.col(doc_id).alias("id"), *_keys(docs, source, doc_id, text, seed), count.alias("tokens")), "narrow")
    sources = materialize(plan(narrow.select("source", "tokens"), budget, repeats, target_entropy), "plan")
    return narrow, limits(narrow, sources, seed)


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """id, source, tokens, epoch, block_order, key: a row per document and epoch. The mix is in order of source, epoch, and then block_order and
    key: an epoch goes through the blocks as they are permuted."""
    narrow, limit = decided(docs, seed=seed, **options)
    return _times(narrow, limit, seed).select("id", "source", "tokens", _epochs().alias("epoch"), "block_order", "key")


def mixed(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", seed: int = SEED, **options) -> DataFrame:
    """The mix's rows with the input's columns, whatever their names: what narrow rows have decided is applied where documents are read."""
    _, limit = decided(docs, source, doc_id, text, seed=seed, **options)
    whole = docs.select(*_keys(docs, source, doc_id, text, seed), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = _times(whole, limit, seed).select(_epochs().alias("epoch"), "row")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select(F.col("id").alias("doc_id"), "source", "epoch", F.col("tokens").alias("n_tokens"), "block_order", F.col("key").alias("document_order"))


#: The exponent is bisected in a recursive table of 60 steps, over the sizes of all sources at once.
OP4_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT source, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS size FROM d GROUP BY source
), top AS (SELECT max(size) AS most, CAST(sum(size) AS BIGINT) AS total FROM s
), fits(a, ok) AS (
  SELECT 0.0::DOUBLE, (SELECT bool_and(total / n <= {REPEATS} * size * (1 + 1e-12)) FROM s, top, (SELECT count(*) AS n FROM s WHERE size > 0) x WHERE size > 0)
), b(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, CASE WHEN ok THEN 0.0 ELSE 1.0 END::DOUBLE FROM fits
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN low ELSE middle END, CASE WHEN ok THEN middle ELSE high END
  FROM (
    SELECT step, low, high, (low + high) / 2 AS middle,
      (SELECT max(exp((low + high) / 2 * ln(size / most)) / size) * total <= {REPEATS} * (1 + 1e-12) * sum(exp((low + high) / 2 * ln(size / most))) FROM s, top WHERE size > 0 GROUP BY total) AS ok
    FROM b WHERE step < 60 AND high > 0
  )
), e AS (SELECT high AS a FROM b ORDER BY step DESC LIMIT 1
), w AS (
  SELECT source, documents, size, CASE WHEN size > 0 THEN CAST(floor(exp(a * ln(size / most)) / sum(CASE WHEN size > 0 THEN exp(a * ln(size / most)) END) OVER () * total + 0.5) AS BIGINT) ELSE 0 END AS target
  FROM s, top, e
), p AS (
  SELECT source, CASE WHEN size > 0 THEN target // size ELSE 1 END AS epochs, CASE WHEN size > 0 THEN target % size ELSE target END AS rest, (documents + {BLOCK_DOCUMENTS - 1}) // {BLOCK_DOCUMENTS} AS blocks FROM w
), o AS (
  SELECT d.doc_id, d.source, d.tokens, d.key, p.epochs, p.rest,
         CAST('0x' || substr(md5('{SEED + 1}:' || coalesce(d.source, '') || ':' || CAST(d.key % p.blocks AS VARCHAR)), 1, 15) AS BIGINT) AS block_order
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), u AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY block_order, key) AS upto FROM o
), c AS (SELECT source, min((block_order, key)) AS cut FROM u WHERE upto > rest GROUP BY source
), t AS (
  SELECT u.*, epochs + CASE WHEN rest > 0 AND (cut IS NULL OR (block_order, key) < cut) THEN 1 ELSE 0 END AS times FROM u LEFT JOIN c ON u.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, source, CAST(unnest(range(times)) AS INTEGER) AS epoch, tokens AS n_tokens, block_order, key AS document_order FROM t
"""
