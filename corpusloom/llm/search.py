r"""Ranked lexical search over a tiered index: high-impact postings first, residual bounds per term, exact results.

1. Texts are read once: each document's number of terms, and how often it holds the terms of the stated items.
2. A posting's impact depends on the document alone, so an item's score is a sum of weights times impacts. By a histogram of each
   term's impacts its postings are cut into tiers: the first holds those of greatest impact (FIRST of them at least, or a share of
   them), the next more, the last all others. The greatest impact below a tier is the term's residual bound there.
3. The index has a row for each shard of documents, and in it a column of posting lists for each tier. So a common term is spread
   over all shards, and a search of the first tiers reads their columns alone.
4. From tier to tier, shards add up what they have for the items that are open. An item's tenth best sum is its limit. A document of which
   nothing was seen can reach the sum of the residuals at most; one of which some was seen, its sum and the residuals of the
   other terms. If the first is below the limit, only the documents whose bound reaches the limit can rank, and they get
   exact scores: the item is proved. Items without proof (or with more than CANDIDATES such documents) fall through to the next
   tier; the last holds everything and needs none.

Items are a stated query set, taken in blocks of about ITEMS against all documents; a block's terms, limits and candidates are all that the driver
holds.

Defined cases: null text has no terms; rows that repeat a doc_id rank each for itself; rows without a doc_id rank with a null id, after
others of their score; items that repeat an id are ranked each; an item without terms has no rows; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, materialize, small_batches, text_of

K = 10
#: Items and their terms in a block; documents of a shard.
ITEMS, TERMS, SHARD = 1024, 1 << 20, 2048
#: Of each tier but the last: the least number of a term's postings, and the least share of them.
TIERS = ((256, 1 / 64), (4096, 1 / 8))
#: Impacts of one bin of the histogram; they are at most a million.
WIDTH = 8192
#: Documents that an item may have to score exactly in order to be proved; shards that are looked up by name.
CANDIDATES, NAMED = 4096, 1000
#: Bytes of text that are looked at together.
AT_ONCE = 1 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time."""
    data = text.encode().translate(_TABLE)
    at = 0
    while at < len(data):
        end = min(at + AT_ONCE, len(data))
        if end < len(data):
            space = data.rfind(b" ", at, end)
            space = space if space >= 0 else data.find(b" ", end)
            end = space if space >= 0 else len(data)
        yield data[at:end].split()
        at = end + 1


def counts_of(text: str | None) -> Counter:
    out: Counter = Counter()
    for some in terms_of(text or ""):
        out.update(some)
    return out


@dataclass
class Items:
    """A block of items: their ids, and for each term the items that hold it and how often."""

    ids: list
    terms: dict[bytes, int]
    item: np.ndarray  # of each (term, item), by term
    times: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Items:
        counts = [counts_of(r["text"]) for r in rows]
        terms = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        found = sorted((terms[t], i, n) for i, c in enumerate(counts) for t, n in c.items())
        term, item, times = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        return cls([r["item_id"] for r in rows], terms, item, times, np.searchsorted(term, np.arange(len(terms) + 1)))


def _forward(terms: dict[bytes, int]):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, tfs = [], [], []
            for text in batch.column(1):
                n, held = 0, Counter()
                for some in terms_of(text.as_py()):
                    n += len(some)
                    held.update(map(terms.get, some))
                held.pop(None, None)
                sizes.append(n)
                ids.append(list(held))
                tfs.append(list(held.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip((sizes, ids, tfs), list(schema)[1:], strict=True))], schema=schema)

    return forward


@dataclass
class Limits:
    """Of each term: its weight, the least impact of each tier but the last, and the greatest impact below it."""

    weight: np.ndarray
    low: np.ndarray
    rest: np.ndarray


_TIER = "struct<terms:array<int>,ends:array<int>,docs:array<int>,impacts:array<int>>"


def _shards(limits: Limits):
    kind = pa.struct([(n, pa.list_(pa.int32())) for n in ("terms", "ends", "docs", "impacts")])
    tiers = len(limits.low) + 1
    schema = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), *((f"tier{k}", kind) for k in range(tiers))])

    def lists(term: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> dict:
        order = np.lexsort((doc, term))
        term = term[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
        return {"terms": term[first], "ends": np.append(first[1:], len(term)) if len(term) else first, "docs": doc[order], "impacts": impact[order]}

    def shard(ids: list, terms: list[np.ndarray], impacts: list[np.ndarray], number: int) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        doc = np.repeat(np.arange(len(ids)), [len(terms[i]) for i in order])
        term, impact = np.concatenate([terms[i] for i in order]), np.concatenate([impacts[i] for i in order])
        tier = sum(((impact < low[term]).astype(int) for low in limits.low), np.zeros(len(term), int))
        own = [lists(term[tier == k], doc[tier == k], impact[tier == k]) for k in range(tiers)]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), *(pa.array([x], kind) for x in own)], schema=schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, terms, impacts = TaskContext.get().partitionId() << 32, [], [], []
        for batch in batches:
            for i, t, v in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                ids.append(i)
                terms.append(t.values.to_numpy())
                impacts.append(v.values.to_numpy().astype(np.int64))
                if len(ids) == SHARD:
                    yield shard(ids, terms, impacts, number)
                    number, ids, terms, impacts = number + 1, [], [], []
        if ids:
            yield shard(ids, terms, impacts, number)

    return build


@dataclass
class Index:
    """A block's index: shards (a table) and the terms' limits. The statistics are of all documents."""

    shards: DataFrame
    limits: Limits
    tiers: int

    @classmethod
    def build(cls, docs: DataFrame, items: Items) -> Index:
        """docs (doc_id, text)."""
        forward = materialize(small_batches(docs).mapInArrow(lean(_forward(items.terms)), "doc_id long, n long, terms array<int>, tfs array<long>"), "forward")
        size = forward.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.sum("n").cast("decimal(38,0)").alias("L")).first()
        n_docs, length = size["N"], int(size["L"] or 0)
        m = F.expr(f"CAST(25 + ((75 * CAST(n AS DECIMAL(18,0)) * CAST({n_docs} AS DECIMAL(18,0))) div {max(length, 1)}BD) AS BIGINT)")
        scored = forward.filter(F.size("terms") > 0).withColumn("m", m).selectExpr("doc_id", "terms", "transform(tfs, t -> CAST((1000000000 * t) div (1000 * t + 8 * m) AS INT)) AS impacts")
        every = scored.select(F.explode(F.arrays_zip("terms", "impacts")).alias("p")).select("p.terms", F.col("p.impacts").alias("impact"))
        bins = every.groupBy(F.col("terms").alias("term"), F.floor(F.col("impact") / WIDTH).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.max("impact").alias("top"))
        own = Window.partitionBy("term")
        above = F.coalesce(F.sum("n").over(own.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumns({"df": F.sum("n").over(own), "above": above})
        inside = [F.col("above") < F.greatest(F.lit(least), F.ceil(F.col("df") * share)) for least, share in TIERS]
        cuts = bins.groupBy("term").agg(F.first("df").alias("df"), *[F.min(F.when(x, F.col("bin"))).alias(f"low{k}") for k, x in enumerate(inside)], *[F.coalesce(F.max(F.when(~x, F.col("top"))), F.lit(0)).alias(f"rest{k}") for k, x in enumerate(inside)]).toPandas()
        terms, at = len(items.terms), cuts["term"].to_numpy(np.int64)
        limits = Limits(np.zeros(terms, np.int64), np.zeros((len(TIERS), terms), np.int64), np.zeros((len(TIERS), terms), np.int64))
        limits.weight[at] = np.floor(1000 * np.log((2.0 * n_docs + 2.0) / (2.0 * cuts["df"].to_numpy(np.float64) + 1.0))).astype(np.int64)
        for k in range(len(TIERS)):
            limits.low[k][at] = cuts[f"low{k}"].to_numpy(np.int64) * WIDTH
            limits.rest[k][at] = cuts[f"rest{k}"].to_numpy(np.int64)
        tiers = len(TIERS) + 1
        rows = small_batches(scored).mapInArrow(lean(_shards(limits)), "shard long, ids array<long>, " + ", ".join(f"tier{k} {_TIER}" for k in range(tiers)))
        return cls(materialize(rows, "index"), limits, tiers)


def best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest scores above 0; of equal ones the first columns."""
    if score.shape[1] > k:
        kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k][:, None]
        tie = score == kth
        keep = (score > kth) | (tie & (np.cumsum(tie, axis=1) <= k - (score > kth).sum(axis=1, keepdims=True)))
        return np.nonzero(keep & (score > 0))
    return np.nonzero(score > 0)


class Search:
    """What tasks need of a block: the open items by term, with their weights, and how far the tiers go."""

    def __init__(self, items: Items, limits: Limits, opened: np.ndarray, tiers: int):
        self.opened, self.tiers = opened, tiers
        place = np.full(len(items.ids), -1)
        place[opened] = np.arange(len(opened))
        term = np.repeat(np.arange(len(items.terms)), np.diff(items.ends))
        some = place[items.item] >= 0
        self.ends = np.searchsorted(term[some], np.arange(len(items.terms) + 1))
        self.item, self.gain = place[items.item[some]], (items.times * limits.weight[term])[some]
        self.rest = limits.rest[tiers - 1] if tiers <= len(limits.rest) else np.zeros(len(items.terms), np.int64)
        self.unseen = np.bincount(self.item, self.gain * self.rest[term[some]], len(opened)).astype(np.int64)  # below 2 ** 53

    def sums(self, row: dict, bounds: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of a shard's row: (item, document) sums of what its tiers hold, and if asked for the residuals of what they lack."""
        total = np.zeros((len(self.opened), len(row["ids"])), np.int64)
        lack = np.repeat(self.unseen[:, None], total.shape[1], axis=1) if bounds else total
        for k in range(self.tiers):
            tier, a = row[f"tier{k}"], 0
            terms, ends, docs, impacts = (np.asarray(tier[n], np.int64) for n in ("terms", "ends", "docs", "impacts"))
            for t, b in zip(terms.tolist(), ends.tolist(), strict=True):
                own = slice(self.ends[t], self.ends[t + 1])
                if own.stop > own.start:
                    at = np.ix_(self.item[own], docs[a:b])
                    total[at] += self.gain[own][:, None] * impacts[a:b]
                    if bounds and self.rest[t]:
                        lack[at] -= (self.gain[own] * self.rest[t])[:, None]
                a = b
        return total, lack


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of shards, their lists as arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {}
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                x = column[i]
                if name.startswith("tier"):
                    row[name] = {n: x[n].values.to_numpy() for n in ("terms", "ends", "docs", "impacts")}
                else:
                    row[name] = x.values if name in ("ids", "pairs") else x.as_py()
            yield row


FOUND = "item int, doc_id long, score long"


def _cut(item: np.ndarray, ids: pa.Array, score: np.ndarray, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The k best of each item."""
    none = np.asarray(ids.is_null())
    order = np.lexsort((np.asarray(ids.fill_null(0)), none, -score, item))
    item = item[order]
    rank = np.arange(len(item)) - np.searchsorted(item, item)
    order = order[rank < k]
    return item[rank < k], ids.take(pa.array(order)), score[order]


def _top(search: Search, k: int):
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), pa.array([], pa.int64()), np.empty(0, np.int64))
        for row in _rows(batches):
            total, _ = search.sums(row, False)
            i, j = best(total, k)
            held = _cut(np.concatenate([held[0], search.opened[i]]), pa.concat_arrays([held[1], row["ids"].take(pa.array(j))]), np.concatenate([held[2], total[i, j]]), k)
        yield pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int32)), held[1], pa.array(held[2])], names=["item", "doc_id", "score"])

    return top


def _reaching(search: Search, limit: np.ndarray):
    """(item, shard, doc) of those whose bound reaches their item's limit."""

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            total, lack = search.sums(row, True)
            i, j = np.nonzero(total + lack >= limit[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(search.opened[i].astype(np.int32)), pa.array(np.full(len(i), row["shard"])), pa.array(j.astype(np.int32))], names=["item", "shard", "doc"])

    return reaching


def _exact(search: Search, k: int):
    """Scores of the pairs that a shard's row asks for."""
    place = {int(o): i for i, o in enumerate(search.opened)}

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            total, _ = search.sums(row, False)
            item, doc = (row["pairs"].field(n).to_numpy() for n in (0, 1))
            score = total[[place[int(i)] for i in item], doc]
            out = _cut(item.astype(np.int64)[score > 0], row["ids"].take(pa.array(doc[score > 0])), score[score > 0], k)
            yield pa.RecordBatch.from_arrays([pa.array(out[0].astype(np.int32)), out[1], pa.array(out[2])], names=["item", "doc_id", "score"])

    return exact


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, items: Items, k: int = K, seen: dict | None = None) -> DataFrame:
    """item (its place in the block), rank, doc_id, score. seen, if given, is told which items each tier has proved."""
    index = Index.build(docs, items)
    opened, results = np.arange(len(items.ids)), []

    def shards(upto: int, *more: str) -> DataFrame:
        return small_batches(index.shards.select("shard", "ids", *[f"tier{i}" for i in range(upto)], *more))

    for upto in range(1, index.tiers):
        search = Search(items, index.limits, opened, upto)
        found = _ranked(shards(upto).mapInArrow(lean(_top(search, k)), FOUND), k)
        last = found.groupBy("item").agg(F.min("score").alias("score"), F.count("*").alias("n")).toPandas()
        limit = np.zeros(len(opened), np.int64)
        full = last[last["n"] == k]
        limit[np.searchsorted(opened, full["item"].to_numpy(np.int64))] = full["score"].to_numpy(np.int64)
        can = (search.unseen < limit) | (search.unseen == 0)  # what was seen nothing of stays below; or nothing is left to see
        proved = np.empty(0, np.int64)
        if can.any():
            some = Search(items, index.limits, opened[can], upto)
            bound = np.maximum(limit[can], 1)
            pairs = materialize(shards(upto).mapInArrow(lean(_reaching(some, bound)), "item int, shard long, doc int"), "reaching")
            counts = pairs.groupBy("item").count().toPandas()
            many = counts[counts["count"] > CANDIDATES]["item"].to_numpy(np.int64)
            proved = np.setdiff1d(opened[can], many)
            asked = pairs.join(F.broadcast(docs.sparkSession.createDataFrame([(int(i),) for i in proved], "item int")), "item")
            asked = asked.groupBy("shard").agg(F.collect_list(F.struct("item", "doc")).alias("pairs"))  # CANDIDATES an item at most
            names = [r["shard"] for r in asked.select("shard").limit(NAMED + 1).collect()]
            there = index.shards.filter(F.col("shard").isin(names)) if len(names) <= NAMED else index.shards
            there = there.join(F.broadcast(asked), "shard").select("shard", "ids", "pairs", *[f"tier{i}" for i in range(index.tiers)])
            whole = Search(items, index.limits, proved, index.tiers)
            if len(proved):
                results.append(_ranked(small_batches(there).mapInArrow(lean(_exact(whole, k)), FOUND), k))
        if seen is not None:
            seen[upto - 1] = seen.get(upto - 1, 0) + len(proved)
        opened = np.setdiff1d(opened, proved)
    if len(opened) or not results:
        search = Search(items, index.limits, opened, index.tiers)
        results.append(_ranked(shards(index.tiers).mapInArrow(lean(_top(search, k)), FOUND), k))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", seen: dict | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents."""
    spark, kind = docs.sparkSession, items.schema[item_id].dataType
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), text_of(text).alias("text"))
    size = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-size["n"] // ITEMS), -(-(size["chars"] or 0) // (4 * TERMS)))
    out = None
    for b in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # a block of the stated items
        found = Items.of(some)
        names = spark.createDataFrame(list(enumerate(found.ids)), f"item int, item_id {kind.simpleString()}")
        own = search_block(docs, found, k, seen).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = own if out is None else out.unionByName(own)
    return out


def op13_ranked_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH words AS (
  SELECT 'd' AS of, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
  UNION ALL
  SELECT 'i', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM benchmark
), counted AS (SELECT of, id, term, CAST(count(*) AS BIGINT) AS tf FROM words GROUP BY ALL
), sizes AS (SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM counted WHERE of = 'd' GROUP BY id
), whole AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM counted, whole WHERE of = 'd' GROUP BY term, big_n
), impacts AS (
  SELECT id AS doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l)) AS v FROM counted JOIN sizes USING (id), whole WHERE of = 'd'
), scores AS (
  SELECT i.id AS item_id, doc_id, CAST(sum(i.tf * w * v) AS BIGINT) AS score FROM counted i JOIN weights USING (term) JOIN impacts USING (term) WHERE i.of = 'i' GROUP BY ALL
), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
