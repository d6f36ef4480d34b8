"""Duplicate policies, set similarity, TF-IDF and copied n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.sources.io import written


def dedup(rows: DataFrame, keys: list[str], order: list[Column | str], policy: str = "first", prefer: Column | None = None) -> DataFrame:
    """One row a key: the first or last in order, or the first among the preferred ones if there are any.

    An aggregate, so copies shrink before the shuffle.
    """
    if policy not in ("first", "last"):
        raise ValueError("policy must be first or last")
    rank = [F.when(prefer, 0).otherwise(1).alias("__p")] if prefer is not None else []
    order = [(F.col(o) if isinstance(o, str) else o).alias(f"__o{i}") for i, o in enumerate(order)]
    best = (F.min if policy == "first" else F.max)(F.struct(*rank, *order, *[F.col(c) for c in rows.columns]))
    return rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(best.alias("__b")).select(*[F.col(f"__b.{c}").alias(c) for c in rows.columns])


def exact_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, n, keep): texts that occur more than once."""
    return docs.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("keep")).filter("n > 1")


def _prefixes(rows: DataFrame, key: str, items: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Sets (k, s, n), items rarest first, and their index (k, n, w): the first size - ceil(least * size) + 1 items of each. Empty sets are in neither."""
    each = rows.select(F.col(key).alias("k"), F.explode(F.array_distinct(F.col(items))).alias("w"))
    frequency = each.groupBy("w").agg(F.count("*").alias("f"))
    ranked = each.join(frequency, "w").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("s"))
    sets = ranked.select("k", F.transform("s", lambda x: x["w"]).alias("s"), F.size("s").alias("n"))
    cut = (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int")
    return sets, sets.select("k", "n", F.explode(F.slice("s", F.lit(1), cut)).alias("w"))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, with their jaccard."""
    sa, sb = sets.select(F.col("k").alias("a"), F.col("s").alias("x")), sets.select(F.col("k").alias("b"), F.col("s").alias("y"))
    return pairs.join(sa, "a").join(sb, "b").select("a", "b", X.jaccard(F.col("x"), F.col("y")).alias("jaccard")).filter(F.col("jaccard") >= least)


def _shared(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b) of two indexes that share an item and are of sizes that can reach the similarity."""
    a, b = left.select(F.col("k").alias("a"), F.col("n").alias("na"), "w"), right.select(F.col("k").alias("b"), F.col("n").alias("nb"), "w")
    return a.join(b, "w").filter(F.least("na", "nb") >= F.greatest("na", "nb") * least).select("a", "b").distinct()


def set_pairs(rows: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """(a, b, jaccard) of sets with a Jaccard of least or more, a < b, from an inverted index with prefix filtering.

    A set's items stand rarest first; two sets that similar share one of the first size - ceil(least * size) + 1 items of both, so
    only those are joined. Sets are verified whole; nothing is capped. A family of k copies is k * (k - 1) / 2 pairs, as that is what is asked for.
    """
    sets, index = _prefixes(rows, key, items, least)
    return _verified(_shared(index, index, least).filter("a < b"), sets, least)


#: Rounds in which only the first row of each index bucket is decided and met with the rest; what is left after them is decided by pairs.
FIRST_ROUNDS = 4


def _by_pairs(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, kept) of keys by edges (early, late): a row goes if an earlier partner stays, and stays if all of them go; rounds settle all rows whose turn has come."""
    done = written(keys.join(edges.select(F.col("late").alias("k")), "k", "left_anti").withColumn("kept", F.lit(True)), "decided")
    while True:
        open_ = edges.join(done.select(F.col("k").alias("late")), "late", "left_anti")
        known = open_.join(done.select(F.col("k").alias("early"), "kept"), "early", "left").groupBy("late").agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("goes"), F.count(F.when(F.col("kept").isNull(), 1)).alias("unknown"))
        more = written(known.filter("goes OR unknown = 0").select(F.col("late").alias("k"), (~F.col("goes")).alias("kept")), "more")
        if not more.limit(1).count():
            return done
        done = written(done.unionByName(more), "decided")


def greedy_near(rows: DataFrame, key: str, items: str, order: str, limit: float) -> DataFrame:
    """In order, over all rows: a row goes if its Jaccard with any kept one reaches the limit. (key, kept, like): like is the most similar kept row before it.

    Rows of equal sets are one set, which its first row stands for. A set that is the first in all its buckets of the prefix index has no earlier partner left, so it
    stays; it is met with the others of its buckets, one kept set a bucket, and those at the limit go. After a few such rounds, which settle families of near copies in work that is linear
    in their rows, what is left is decided by its pairs. Rows with an empty set stay.
    """
    at = F.struct(F.col(order).alias("o"), F.col(key).alias("k"))
    own = rows.select(F.col(key).alias("k"), at.alias("at"), F.array_sort(F.array_distinct(F.col(items))).alias("own"))
    empty = own.filter("own IS NULL OR size(own) = 0").select("k", F.lit(True).alias("kept"))
    held = own.filter("size(own) > 0")
    firsts = written(held.groupBy("own").agg(F.min("at").alias("at")).select(F.col("at.k").alias("k"), "at", "own"), "firsts")
    sets, index = _prefixes(firsts, "k", "own", limit)
    sets, index = written(sets, "sets"), written(index.join(firsts.select("k", "at"), "k"), "index")
    left, kept = firsts.select("k", "at"), firsts.select("k").limit(0)
    for _ in range(FIRST_ROUNDS):
        buckets = index.join(left.select("k"), "k", "left_semi")
        first = buckets.groupBy("w").agg(F.min("at").alias("first"))
        lead = written(buckets.join(first, "w").groupBy("k").agg(F.bool_and(F.col("at") == F.col("first")).alias("lead")).filter("lead").select("k"), "lead")
        kept = kept.unionByName(lead)
        rest = buckets.join(lead, "k", "left_anti")
        gone = _verified(_shared(buckets.join(lead, "k", "left_semi"), rest, limit), sets, limit).select(F.col("b").alias("k")).distinct()
        left = written(left.join(lead, "k", "left_anti").join(gone, "k", "left_anti"), "left")
        if not left.limit(1).count():
            break
    else:
        some = index.join(left.select("k"), "k", "left_semi")
        place = lambda c: left.select(F.col("k").alias(c), F.col("at").alias(f"p{c}"))
        both = _verified(_shared(some, some, limit).filter("a <> b"), sets, limit).join(place("a"), "a").join(place("b"), "b").filter("pa < pb")
        decided = _by_pairs(written(both.select(F.col("a").alias("early"), F.col("b").alias("late")), "edges"), left.select("k"))
        kept = kept.unionByName(decided.filter("kept").select("k"))
    kept = written(kept, "kept")
    # Which kept set is most like each row that goes: of a set that is kept, all rows but the first go, and are like that.
    staying = index.join(kept, "k", "left_semi")
    like = _verified(_shared(index, staying, limit).filter("a <> b"), sets, limit).unionByName(kept.select(F.col("k").alias("a"), F.col("k").alias("b"), F.lit(1.0).alias("jaccard")))
    like = written(like.join(firsts.select(F.col("k").alias("b"), F.col("at").alias("pb")), "b"), "like")
    of = held.join(firsts.select(F.col("k").alias("a"), "own"), "own").select("k", "at", "a")
    best = of.join(like, "a").filter("pb < at").groupBy("k").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "pb", "b")).alias("x"))
    out = of.join(kept.withColumnRenamed("k", "kept_k"), F.col("k") == F.col("kept_k"), "left").join(best, "k", "left")
    out = out.select("k", F.col("kept_k").isNotNull().alias("kept"), F.col("x.b").alias("like"))
    out = out.unionByName(empty.withColumn("like", F.lit(None).cast(out.schema["like"].dataType)))
    return out.select(F.col("k").alias(key), "kept", F.when(~F.col("kept"), F.col("like")).alias("like"))


def _idf(base: DataFrame, terms: str) -> DataFrame:
    """(term, idf): ln((1 + N) / (1 + df)) + 1 over the rows of base."""
    total = base.agg(F.count("*").alias("N"))
    df = base.select(F.explode(F.array_distinct(F.col(terms))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(total)).select("term", (F.log((F.col("N") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # one row


def tfidf(docs: DataFrame, key: str, terms: str, corpus: DataFrame | None = None, corpus_terms: str | None = None) -> DataFrame:
    """(key, term, weight): tf * (ln((1 + N) / (1 + df)) + 1), unit length; unseen terms have an idf of 1."""
    idf = _idf(corpus if corpus is not None else docs, corpus_terms or terms)
    tf = docs.select(F.col(key).alias("key"), F.explode(terms).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    raw = tf.join(idf, "term", "left").select("key", "term", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("w"))
    norm = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "key").select("key", "term", (F.col("w") / F.col("norm")).alias("weight"))


#: Keys of a block of the side that is searched: a block's matrix has a row for each of their terms.
BLOCK_KEYS = 256


def dense(rows: list, width: int) -> tuple[dict, np.ndarray]:
    """Rows (place, term, weight) as the numbers of their terms and a matrix of terms by places."""
    vocabulary: dict = {}
    for _, term, _ in rows:
        vocabulary.setdefault(term, len(vocabulary))
    out = np.zeros((len(vocabulary), width))
    for place, term, weight in rows:
        out[vocabulary[term], place] = weight
    return vocabulary, out


def _matches(vocabulary: dict, matrix: np.ndarray, matches: list, digits: int):
    """The best of a block for each row (key, terms, weights) that shares a term with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, best, cosine = [], [], []
            for i, (terms, weights) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                at = [(vocabulary[t], w) for t, w in zip(terms, weights, strict=True) if t in vocabulary]  # other terms add nothing
                if at:
                    rows, w = zip(*at, strict=True)
                    some = matrix[list(rows)]
                    score = np.where(some.any(axis=0), np.round(np.array(w) @ some, digits), -np.inf)
                    j = int(score.argmax())  # the first of equals: matches stand in order
                    kept.append(i)
                    best.append(matches[j])
                    cosine.append(float(score[j]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(best, pa.int64()), pa.array(cosine)], names=["key", "match", "cosine"])

    return run


def best_match(a: DataFrame, b: DataFrame, digits: int = 9) -> DataFrame:
    """(key, match, cosine): for each key of a the most similar of b, over shared terms; ties to the smaller match. Keys that share no term have no row.

    b, whose keys are integers, is taken in blocks of BLOCK_KEYS, each a matrix in the tasks that hold a: so a's terms never meet b's in a join, and no pairs are made but the best.
    """
    spark, kind = a.sparkSession, a.schema["key"].dataType.simpleString()
    some = a.join(b.select("term").distinct(), "term", "left_semi")  # other terms add nothing
    own = written(some.groupBy("key").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")), "vectors")  # of one document

    def scored(_, matches, vocabulary, matrix):
        shared = spark.sparkContext.broadcast((vocabulary, matrix, matches))
        return own.mapInArrow(lambda x: _matches(*shared.value, digits)(x), f"key {kind}, match long, cosine double")

    return _over_blocks(written(b.select(F.col("key").cast("long").alias("match"), "term", "weight"), "searched"), scored)


#: Terms of the searched side, with their idf, that a task holds at most; of more, documents' terms meet them in joins. Rows whose terms are counted at once.
VOCABULARY, COUNTED = 1 << 18, 1000


def _counted(vocabulary: list, idf: np.ndarray, place: np.ndarray, matrix: np.ndarray, matches: list, digits: int):
    """The best of a block for each row (key, terms) that shares a term with it. place: the row of the matrix of each term of the vocabulary, or -1."""

    def best(rows: pa.RecordBatch, terms: pa.Array) -> tuple[list, list, list]:
        lists, many = rows.column(1), len(vocabulary)
        coded = lists.flatten().dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=terms), -1).to_numpy().astype(np.int64)
        number = np.where(known >= 0, known, many + np.arange(len(known)))  # terms that the vocabulary lacks count in the length
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        wide = many + len(known) + 1
        pair, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * wide + number[coded.indices.to_numpy()], return_counts=True)
        row, term = np.divmod(pair, wide)
        weight = tf * np.append(idf, 1.0)[np.minimum(term, many)]
        length = np.sqrt(np.bincount(row, weight * weight, minlength=len(sizes)))
        at = np.append(place, -1)[np.minimum(term, many)]
        row, weight, at = (x[at >= 0] for x in (row, weight / length[row], at))
        kept, starts = np.unique(row, return_index=True)
        found, cosine = [], []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(row)], strict=True):
            raw = weight[s:e] @ matrix[at[s:e]]
            score = np.where(raw > 0, np.round(raw, digits), -np.inf)  # weights are positive: 0 shares no term
            j = int(score.argmax())  # the first of equals: matches stand in order
            found.append(matches[j])
            cosine.append(float(score[j]))
        return kept.tolist(), found, cosine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(vocabulary, pa.string())
        for batch in batches:
            for some in (batch.slice(a, COUNTED) for a in range(0, batch.num_rows, COUNTED)):
                kept, found, cosine = best(some, terms)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(kept, pa.int64())), pa.array(found, pa.int64()), pa.array(cosine, pa.float64())], names=["key", "match", "cosine"])

    return run


def _over_blocks(vectors: DataFrame, scored) -> DataFrame:
    """The best (key, match, cosine) over the blocks of the searched vectors (match, term, weight); scored(blocks, matches, vocabulary, matrix) has those of one."""
    blocks, found = max(1, -(-vectors.select("match").distinct().count() // BLOCK_KEYS)), None
    for k in range(blocks):
        rows = vectors.filter(F.pmod(F.xxhash64("match"), F.lit(blocks)) == k).collect()  # one block
        matches = sorted({r["match"] for r in rows})
        place = {m: i for i, m in enumerate(matches)}
        own = scored(blocks, matches, *dense([(place[r["match"]], r["term"], r["weight"]) for r in rows], len(matches)))
        found = own if found is None else found.unionByName(own)
    if blocks == 1:
        return found
    best = found.groupBy("key").agg(F.max(F.struct("cosine", (-F.col("match")).alias("m"))).alias("x"))
    return best.select("key", (-F.col("x.m")).alias("match"), F.col("x.cosine").alias("cosine"))


def tfidf_match(docs: DataFrame, key: str, terms: str, items: DataFrame, item_key: str, item_terms: str, digits: int = 9) -> DataFrame:
    """best_match of the TF-IDF vectors of docs, by the idf of items, with those of items.

    A document's terms are counted and weighed where its row is read, so none of them moves. Rows that share a key are put together first; rows without one have no match.
    """
    weights = tfidf(items, item_key, item_terms)
    idf = written(_idf(items, item_terms), "idf")
    if idf.count() > VOCABULARY:
        return best_match(tfidf(docs, key, terms, items, item_terms), weights, digits)
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(terms).alias("terms"))
    if docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        rows = rows.groupBy("key").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    known = sorted((r["term"], r["idf"]) for r in idf.collect())  # at most VOCABULARY
    vocabulary, each = [t for t, _ in known], np.array([w for _, w in known], float)
    number = {t: i for i, t in enumerate(vocabulary)}
    spark, schema = docs.sparkSession, f"key {rows.schema['key'].dataType.simpleString()}, match long, cosine double"
    held = {}

    def scored(blocks, matches, block, matrix):
        place = np.full(len(vocabulary), -1)
        place[[number[t] for t in block]] = list(block.values())
        shared = spark.sparkContext.broadcast((vocabulary, each, place, matrix, matches))
        if blocks > 1 and not held:
            held["rows"] = written(rows, "terms")
        return held.get("rows", rows).mapInArrow(lambda x: _counted(*shared.value, digits)(x), schema)

    return _over_blocks(written(weights.select(F.col("key").cast("long").alias("match"), "term", "weight"), "searched"), scored)


def _gram_hashes(tokens: Column, n: int) -> Column:
    """A hash of each n-gram, from the words' own hashes."""
    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(n))))
    return F.when(F.size(tokens) >= n, X.let(F.transform(tokens, lambda w: F.xxhash64(w)), hashes)).otherwise(F.array().cast("array<bigint>"))


def shared_ngrams(docs: DataFrame, key: str, tokens: str, source: DataFrame, source_tokens: str, n: int) -> DataFrame:
    """(key, pos, gram): the n-grams of documents that a source text has too.

    64-bit hashes of n-grams meet in a join, and only where they do is the n-gram itself compared: no text of the others moves.
    """
    grams = source.select(F.explode(X.ngrams(F.col(source_tokens), n)).alias("gram")).distinct()
    hashes = source.select(F.explode(F.array_distinct(_gram_hashes(F.col(source_tokens), n))).alias("h")).distinct()
    each = docs.select(F.col(key).alias("key"), F.posexplode(_gram_hashes(F.col(tokens), n)).alias("pos", "h"))
    places = each.join(hashes, "h", "left_semi").groupBy("key").agg(F.collect_set("pos").alias("places"))  # of one document
    found = docs.select(F.col(key).alias("key"), F.col(tokens).alias("tokens")).join(places, "key").select("key", "tokens", F.explode("places").alias("pos"))
    return found.select("key", "pos", F.array_join(F.slice("tokens", F.col("pos") + 1, F.lit(n)), " ").alias("gram")).join(grams, "gram", "left_semi").select("key", "pos", "gram")


def copied_ngrams(docs: DataFrame, key: str, tokens: str, source: DataFrame, source_tokens: str, n: int) -> DataFrame:
    """(key, longest, covered, total): runs of a document's words that a source text has too, n words at least.

    Runs are islands of consecutive positions of the n-grams that both have.
    """
    hits = shared_ngrams(docs, key, tokens, source, source_tokens, n).select("key", "pos")
    islands = hits.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("key").orderBy("pos")))
    runs = islands.groupBy("key", "island").agg((F.count("*") + n - 1).alias("words"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    # Runs can overlap by up to n - 2 words: each counts what the one before has not.
    last = F.lag("b").over(Window.partitionBy("key").orderBy("a"))
    fresh = F.col("b") + n - F.greatest(F.col("a"), F.coalesce(last + n, F.col("a")))
    sums = runs.withColumn("fresh", fresh).groupBy("key").agg(F.max("words").alias("longest"), F.sum("fresh").alias("covered"))
    totals = docs.select(F.col(key).alias("key"), F.size(tokens).alias("total"))
    return totals.join(sums, "key", "left").select("key", F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("covered", F.lit(0)).alias("covered"), "total")
