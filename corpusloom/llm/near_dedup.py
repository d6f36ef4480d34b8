"""Near-duplicate removal: five-word shingles and a Jaccard similarity of 0.8 or more, exact.

Fingerprints as op3 has them come first; a prefix-filtered join of shingle sets then finds every other pair at the similarity:

1. SimHash: documents of one fingerprint, and of fingerprints that its blocks find within 3 bits, are linked as in op3, by as many
   links as members. A link holds if the whole sets have the similarity, and links that hold make the first groups. Only what is not
   in one group yet is looked at from here on.
2. All sets are put in one order of shingles, the common ones last (a sample of documents says which; any order is right, this one
   only keeps buckets small). Two sets of n and m shingles at similarity s share one among the first n - ceil(s * n) + 1 of the
   one and m - ceil(s * m) + 1 of the other, so each document stands in one bucket for each shingle of that prefix.
3. A bucket's members stand in the order of their least shingles, so that copies are neighbours in all the buckets that they share.
   Neighbours are verified on their whole sets, and verified links are joined into groups. In a large group of copies that settles
   nearly all members without all their pairs.
4. Every other pair of a bucket whose members are not in one group yet, and which sizes, places in the prefix and signatures do
   not rule out, is a candidate. For ROUNDS rounds each member's closest candidate alone is verified, and groups are joined anew:
   as many pairs as members, however large a family of copies is. What candidates are left then are all looked at: first the closest
   of each two groups, then those whose members are still not in one group. Pairs that are left out are linked already, or below
   the similarity.
5. One document of each connected group stays: the smallest id.

A signature holds a bit for each of at least twice as many places as a set has shingles: the parity of those that fall there. Two
signatures differ in no more bits than their sets in shingles, so most pairs below the similarity never move as sets.

Defined cases: null and blank texts have no shingles and are never near copies; texts of fewer than five words are one shingle;
rows that repeat an id are compared each and share its fate; rows without an id stay; an empty table gives an empty result; the
input's columns come back as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name, lean, materialize, parallelism, small_batches, text_of
from corpusloom.llm.components import components
from corpusloom.llm.simhash import fingerprints, linked, shingle_hashes, word_list

WORDS, SIMILARITY = 5, 0.8
#: Documents whose shingles are counted to tell common ones, the count that makes one common, and how many are named at most. Only the
#: order of shingles depends on them, never the result.
SAMPLE, COMMON, NAMED = 10_000, 10, 20_000
#: Pairs of an Arrow batch, least longs of a signature, and to how many it is folded where it goes into the buckets.
PAIRS, LONGS, BRIEF = 1 << 16, 16, 8
#: Rounds in which each member's closest candidate alone is verified.
ROUNDS = 2


def signature(own: np.ndarray, longs: int = 0) -> np.ndarray:
    """Parities of the shingles that fall on each bit: at least two bits a shingle, a power of two."""
    bits = 64 * longs or max(64 * LONGS, 1 << int(2 * len(own) - 1).bit_length())
    parity = np.bincount(own & (bits - 1), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view("<i8")


def _own(text: str, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_list(text), words)).view(np.int64)


def _sets(words: int):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_own(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, schema.field(1).type)], schema=schema)

    return sets


def _prints(words: int, similarity: float, common: np.ndarray):
    """node, its number of shingles, bits of the least one, their signature (whole and brief), and the prefix of its index: common shingles last, the commonest at the end."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("low", pa.int32()), ("sign", pa.list_(pa.int64())), ("brief", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])
    order = np.argsort(common)
    sorted_common = common[order]

    def prefix(own: np.ndarray) -> np.ndarray:
        if len(common):
            at = np.minimum(np.searchsorted(sorted_common, own), len(common) - 1)
            hit = sorted_common[at] == own
            own = np.concatenate([own[~hit], common[np.sort(order[at[hit]])]])
        return own[: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ((node, _own(text.as_py(), words)) for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
            out = [(node, len(own), int(own.view(np.uint64).min()) >> 44, signature(own), signature(own, BRIEF), prefix(own)) for node, own in sets if len(own)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return prints


def _common(rows: DataFrame, words: int) -> np.ndarray:
    """Shingles that many documents of a sample have, the rarer ones first."""
    every = max(1, rows.count() // SAMPLE)
    some = rows.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).mapInArrow(lean(_sets(words)), "node long, shingles array<long>")
    counts = some.select(F.explode("shingles").alias("w")).groupBy("w").agg(F.count("*").alias("f")).filter(F.col("f") >= COMMON)
    return np.array([r["w"] for r in counts.orderBy(F.desc("f"), "w").limit(NAMED).collect()][::-1], np.int64)


def _pairs(similarity: float, closest: bool):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]
            now.append(batch.column(batch.num_columns - 1).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1))  # bits of negative numbers would be those of their absolute value
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            other = np.flatnonzero(held[0] != held[0][-1])
            last = int(other[-1]) + 1 if len(other) else 0  # the last bucket may go on in the next batch
            if last:
                yield [x[:last] for x in held]
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield held

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (w, n, pos, node, component, sign) sorted by w and n: pairs of different components that can reach the similarity, or the closest of each member with what follows it."""
        a, b, size = [], [], 0

        def batch() -> pa.RecordBatch:
            x, y = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=schema)

        for w, n, pos, node, component, sign in buckets(batches):
            cut = np.flatnonzero(w[1:] != w[:-1]) + 1
            ends = np.concatenate([cut, [len(w)]])
            most = np.floor(n / similarity + 1e-6)
            for s, e in zip(np.concatenate([[0], cut]).tolist(), ends.tolist(), strict=True):
                to = s + np.searchsorted(n[s:e], most[s:e], "right")
                for i in range(s, e - 1):
                    j = slice(i + 1, int(to[i - s]))
                    shared = np.minimum(n[i] - pos[i], n[j] - pos[j])  # at most, if this is the first shingle of both
                    found = (component[j] != component[i]) & (shared >= similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6)
                    found = i + 1 + np.flatnonzero(found)
                    differ = np.bitwise_count(sign[found] ^ sign[i]).sum(axis=1)
                    can = differ <= (n[i] + n[found]) * ((1 - similarity) / (1 + similarity)) + 1e-6
                    found = found[can]
                    if closest and len(found):
                        found = found[[np.argmin(differ[can])]]
                    other = node[found]
                    if len(other):
                        a.append(np.full(len(other), node[i]))
                        b.append(other)
                        size += len(other)
                        if size >= PAIRS:
                            yield batch()
                            a, b, size = [], [], 0
        if size:
            yield batch()

    return pairs


def _halved(sign: Column) -> Column:
    """A signature of half the bits."""
    n = (F.size(sign) / 2).cast("int")
    return F.zip_with(F.slice(sign, F.lit(1), n), F.slice(sign, n + 1, n), lambda p, q: p.bitwiseXOR(q))


def _possible(pairs: DataFrame, signs: DataFrame, similarity: float, what: str) -> DataFrame:
    """The pairs (a, b) that signatures do not rule out, with the number of bits in which they differ."""
    x, y = (signs.select(F.col("node").alias(e), F.col("n").alias(f"n{e}"), F.col("sign").alias(f"s{e}")) for e in "ab")
    both = pairs.join(x, "a").join(y, "b")
    # Sets at the similarity are of about one size, so their signatures are of one length or one step apart.
    p = F.when(F.size("sa") == 2 * F.size("sb"), _halved(F.col("sa"))).otherwise(F.col("sa"))
    q = F.when(F.size("sb") == 2 * F.size("sa"), _halved(F.col("sb"))).otherwise(F.col("sb"))
    differ = F.aggregate(F.zip_with(p, q, lambda u, v: F.coalesce(F.bit_count(u.bitwiseXOR(v)), F.lit(64))), F.lit(0), lambda t, v: t + v)
    both = both.select(*pairs.columns, differ.alias("differ"), (F.col("na") + F.col("nb")).alias("size"))
    return materialize(both.filter(F.col("differ") <= F.col("size") * ((1 - similarity) / (1 + similarity)) + 1e-6).drop("size"), what)


def _verified(pairs: DataFrame, rows: DataFrame, words: int, similarity: float, what: str) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity, with their jaccard."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = rows.join(ids, "node", "left_semi").select("node", "text").mapInArrow(lean(_sets(words)), "node long, shingles array<long>")
    sets = materialize(some, f"{what}-sets")
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("jaccard"))
    return materialize(both.filter(F.col("jaccard") >= similarity), what)


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) of different groups, with the groups of both as x < y."""
    at = lambda e: labels.select(F.col("node").alias(e), F.col("component").alias(f"c{e}"))
    both = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
    return both.filter("ca <> cb").select(*pairs.columns, F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"))


def print_links(rows: DataFrame) -> DataFrame:
    """Links (a < b) of rows (node, text) by op3's fingerprints: each node with the one before it of its fingerprint, and close fingerprints by the least node of each.

    Their groups are those of all pairs of close fingerprints. Texts without words are in none.
    """
    each = fingerprints(rows.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")), "node").select("fp", F.col("doc_id").alias("node"))
    each = materialize(each, "fingerprints")
    before = F.lag("node").over(Window.partitionBy("fp").orderBy("node"))
    same = each.select(before.alias("a"), F.col("node").alias("b"))
    close = linked(materialize(each.groupBy("fp").agg(F.min("node").alias("node")), "distinct-prints"))
    both = same.unionByName(close).filter("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Verified pairs (a, b, jaccard) whose connected groups are those of all pairs at the similarity."""
    spark = docs.sparkSession
    rows = small_batches(docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("node"), text_of(text).alias("text")))
    prints = rows.mapInArrow(lean(_prints(words, similarity, _common(rows, words))), "node long, n int, low int, sign array<long>, brief array<long>, prefix array<long>")
    prints = materialize(prints, "prints")
    signs = prints.select("node", "n", "sign")
    index = prints.select("node", "n", "low", F.posexplode("prefix").alias("pos", "w"))
    order = Window.partitionBy("w").orderBy("low", "n", "node")
    last = F.lag(F.struct("node", "n", "pos")).over(order)
    shared = index.withColumn("last", last).withColumn("next", F.lead("node").over(order)).filter("last IS NOT NULL OR next IS NOT NULL")
    shared = materialize(shared.drop("next", "low"), "buckets")
    most = F.least(F.col("n") - F.col("pos"), F.col("last.n") - F.col("last.pos"))  # shingles in common, if this is the first of both
    close = shared.filter("last.node <> node").filter(most >= (F.col("n") + F.col("last.n")) * (similarity / (1 + similarity)) - 1e-6)
    chain = close.select(F.least("last.node", "node").alias("a"), F.greatest("last.node", "node").alias("b")).distinct()
    found = _verified(_possible(print_links(rows), signs, similarity, "print-candidates"), rows, words, similarity, "linked")
    chain = _labelled(chain, components(found.select("a", "b"))).select("a", "b")
    found = found.unionByName(_verified(_possible(chain, signs, similarity, "chain-candidates"), rows, words, similarity, "chain"))
    brief = prints.select("node", "n", F.col("brief").alias("sign"))

    def candidates(labels: DataFrame, closest: bool, what: str) -> DataFrame:
        """Pairs of a bucket's members that are in different groups, as _pairs finds them; signatures then rule out more."""
        placed = shared.join(labels, "node", "left").select("w", "n", "pos", "node", F.coalesce("component", "node").alias("component"))
        mixed = placed.groupBy("w").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("w")
        dealt = placed.join(mixed, "w", "left_semi").join(brief, ["node", "n"]).select("w", "n", "pos", "node", "component", "sign").repartition(parallelism(spark), "w").sortWithinPartitions("w", "n", "node")
        return _possible(dealt.mapInArrow(lean(_pairs(similarity, closest)), "a long, b long").filter("a <> b").distinct(), signs, similarity, what)

    for k in range(ROUNDS):
        near = candidates(components(found.select("a", "b")), True, f"near-{k}")
        if not near.limit(1).count():
            return found  # no pair of different groups can reach the similarity
        found = found.unionByName(_verified(near, rows, words, similarity, f"round-{k}"))
    labels = components(found.select("a", "b"))
    rest = candidates(labels, False, "rest-candidates")
    best = _labelled(rest, labels).groupBy("x", "y").agg(F.min(F.struct("differ", "a", "b")).alias("p")).select("p.a", "p.b")
    found = found.unionByName(_verified(materialize(best, "best"), rows, words, similarity, "second"))
    left = materialize(_labelled(rest, components(found.select("a", "b"))).select("a", "b"), "left")
    return found.unionByName(_verified(left, rows, words, similarity, "third"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """node, component (the smallest id of its group) of every document with a near copy."""
    return components(materialize(near_pairs(docs, doc_id, text, words, similarity).select("a", "b"), "near"))


def keep_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The input's rows and columns without all but one document of each group."""
    of = free_name(docs, "gone")
    gone = near_groups(docs, doc_id, text, words, similarity).filter("node <> component").select(F.col("node").alias(of))
    return docs.join(gone, F.col(doc_id) == F.col(of), "left_anti")
