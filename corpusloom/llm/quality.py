"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

1. Words and word shapes fall into BUCKETS hashed buckets. Each bucket has a sparse random index vector. Over all documents each
   bucket also gathers a context vector: the sum of the random index vectors of the documents that hold it.
2. A document is the mean of its buckets' index and context vectors. The tables have a fixed size, whatever the corpus.
3. A two-layer network is fitted on at most TRAIN_ROWS labelled rows (those with the least hashes of their ids) outside the
   held-out fifth; a temperature fitted on a part it has not seen makes its outputs probabilities.

Labels, lang, source and doc_id are never inputs. Defined cases: null text is empty, and empty texts score by the zero vector;
repeated rows get a row each; a labelled id with several texts is learned from the least of them; an empty table gives an empty
result; without labels of both kinds the score is their share (0.5 without any); a text of more than AT_ONCE bytes is counted in parts
that end with a word, and a word of more than that is several; extra columns stay as they are, whatever their names, but one that is called
like the score is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import free_name, lean, small_batches, text_of

WORD_BUCKETS, SHAPE_BUCKETS, DIMENSIONS = 1 << 14, 1 << 12, 32
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
NONZERO = 4
TRAIN_ROWS, HELD_OUT_OF, THRESHOLD = 8192, 5, 0.3
HIDDEN, EPOCHS, BATCH, SEED = 32, 60, 256, 11
_P = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are looked at together.
AT_ONCE = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == 0


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x)])) for x in (_P, inverse))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: white space, lower-cased value, class in a word's shape."""
    byte = np.arange(256)
    space = np.isin(byte, [32, 9, 10, 11, 12, 13])
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint64)
    kind = byte.copy()
    kind[(byte >= 97) & (byte <= 122) | (byte >= 128)] = 97
    kind[(byte >= 65) & (byte <= 90)] = 65
    kind[(byte >= 48) & (byte <= 57)] = 48
    return space, lower, kind.astype(np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buckets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts in one UTF-8 buffer: the bucket of each word and of each word's shape, and the text that each stands in."""
    data, begin = data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0]
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    space, lower, kind = _tables()
    inside = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[begin] = True  # empty texts at the end mark the place behind it
    first[0] = first[-1] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | first[1:]))
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    power, inverse = _powers(1 << (len(data) - 1).bit_length())
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(lower[data] * power[: len(data)])])
        words = _mixed((sums[ends + 1] - sums[starts]) * inverse[starts])
        text = np.searchsorted(begin, starts, "right") - 1
        again = np.concatenate([[False], (words[1:] == words[:-1]) & (text[1:] == text[:-1])])
        c = kind[data]
        size = np.minimum(ends - starts, 15).astype(np.uint64) // np.uint64(4)
        shape = ((c[starts] * np.uint64(256) + c[ends]) * np.uint64(256) + c[np.maximum(ends - 1, starts)]) * np.uint64(8) + size * np.uint64(2) + again.astype(np.uint64)
        shapes = _mixed(shape + np.uint64(1))
    bits = np.uint64(64 - 14), np.uint64(64 - 12)
    return np.concatenate([(words >> bits[0]).astype(np.int64), WORD_BUCKETS + (shapes >> bits[1]).astype(np.int64)]), np.concatenate([text, text])


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about AT_ONCE bytes of text, a longer text alone: first row, end, buffer, offsets."""
    texts = batch.column(column).cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        end = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE)) - 1), len(texts))
        yield at, end, data, offsets[at : end + 1]
        at = end


def _bucket_counts(data: np.ndarray) -> np.ndarray:
    """How often each bucket stands in one long text, in parts of about AT_ONCE bytes that end with a word."""
    space, out, a = _tables()[0], np.zeros(BUCKETS, np.int64), 0
    while a < len(data):
        b = min(a + AT_ONCE, len(data))
        if b < len(data):
            cut = np.flatnonzero(space[data[a:b]])
            b = a + int(cut[-1]) + 1 if len(cut) else b
        out += np.bincount(buckets_of(data, np.array([a, b]))[0], minlength=BUCKETS)
        a = b
    return out


def index_vectors(seed: int = SEED) -> np.ndarray:
    """A sparse ternary vector for each bucket."""
    r = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), r.integers(0, DIMENSIONS, BUCKETS)] += r.choice(np.array([-1, 1], np.float32), BUCKETS)
    return out


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Each bucket's sum of the index vectors of all documents that hold it: a table of BUCKETS rows, over any corpus."""
    names = [f"c{i}" for i in range(DIMENSIONS)]
    schema = pa.schema([("bucket", pa.int32()), *[(n, pa.int64()) for n in names]])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            for at, end, data, offsets in _slices(batch, 0):
                if offsets[-1] - offsets[0] > AT_ONCE:
                    bucket = np.flatnonzero(_bucket_counts(data[offsets[0] : offsets[-1]]))
                    row = np.zeros(len(bucket), np.int64)
                else:
                    bucket, row = buckets_of(data, offsets)
                    pairs = np.sort(row * BUCKETS + bucket)
                    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
                    row, bucket = pairs // BUCKETS, pairs % BUCKETS
                # A document's own index vector, from how its buckets add up.
                with np.errstate(over="ignore"):
                    own = _mixed(np.bincount(row, weights=bucket, minlength=end - at).astype(np.uint64) + np.uint64(SEED))
                    for k in range(NONZERO):
                        own = _mixed(own + np.uint64(k + 1))
                        place, sign = (own % np.uint64(DIMENSIONS)).astype(np.int64), 1.0 - 2.0 * ((own >> np.uint64(40)) & np.uint64(1)).astype(float)
                        total += np.bincount(bucket * DIMENSIONS + place[row], weights=sign[row], minlength=len(total))
        total = total.reshape(BUCKETS, DIMENSIONS).astype(np.int64)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(total[some, i]) for i in range(DIMENSIONS)]], schema=schema)

    rows = small_batches(docs.select(text_of(text).alias("text"))).mapInArrow(lean(gather), "bucket int, " + ", ".join(f"{n} long" for n in names))
    table = rows.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    out[table["bucket"].to_numpy()] = table[names].to_numpy()
    return out


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Index and context vectors side by side, the latter at unit length."""
    context = context_vectors(docs, text)
    return np.hstack([index_vectors(), context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1.0)]).astype(np.float32)


def pooled(vectors: np.ndarray, batch: pa.RecordBatch, column: int) -> np.ndarray:
    """The mean vector of each text's buckets; zero for a text without words."""
    out = np.zeros((batch.num_rows, vectors.shape[1]), np.float32)
    for at, end, data, offsets in _slices(batch, column):
        if offsets[-1] - offsets[0] > AT_ONCE:
            counts = _bucket_counts(data[offsets[0] : offsets[-1]])
            out[at] = counts @ vectors / max(counts.sum(), 1)
            continue
        bucket, row = buckets_of(data, offsets)
        half = len(bucket) // 2
        if not half:
            continue
        cut = np.concatenate([[0], np.flatnonzero(np.diff(row[:half])) + 1])
        for part in (bucket[:half], bucket[half:]):  # words, then shapes
            out[at + row[cut]] += np.add.reduceat(vectors[part], cut, axis=0)
        out[at:end] /= np.maximum(np.bincount(row, minlength=end - at), 1)[:, None]
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Adam on logistic loss over four fifths of the rows; the temperature on the rest."""
    r = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    constant = len(y) < 20 or y.min() == y.max()
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    net = Network(mean, scale, r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.log(share / (1 - share)))
    if constant:
        return net
    order = r.permutation(len(y))
    rest, train = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - mean) / scale
    values = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step = [np.zeros_like(p) for p in values], [np.zeros_like(p) for p in values], 0
    for _ in range(EPOCHS):
        order = r.permutation(train)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            hidden = np.tanh(z[rows] @ values[0] + values[1])
            d = (1 / (1 + np.exp(-(hidden @ values[2] + values[3][0]))) - y[rows]) / len(rows)
            back = np.outer(d, values[2]) * (1 - hidden**2)
            grads = [z[rows].T @ back + 1e-4 * values[0], back.sum(axis=0), hidden.T @ d + 1e-4 * values[2], np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                values[i] = values[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *values[:3], float(values[3][0])
    logits = net.logits(x[rest])
    net.temperature = temperature(logits, y[rest])
    return net


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """What logits are divided by so that they fit the labels best.

    The labels count as (n + 1) / (n + 2) and 1 / (n + 2) of their n rows: so rows that are told apart without an error call for some doubt
    yet, and the best value stands inside the grid.
    """
    yes, no = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    grid = np.exp(np.linspace(np.log(1 / 64), np.log(64), 241))
    return float(min(grid, key=lambda t: (np.logaddexp(0, -logits / t) * target + np.logaddexp(0, logits / t) * (1 - target)).mean()))


@dataclass
class QualityModel:
    """Scores texts. train() reads the whole corpus once for word vectors and the labelled sample once for the network."""

    vectors: np.ndarray
    network: Network

    @classmethod
    def train(cls, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> QualityModel:
        vectors = word_vectors(docs, text)
        known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("__id")).agg(F.min(label).cast("int").alias("__label"))
        sample = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)  # bounded, so it may be broadcast
        chosen = docs.select(F.col(doc_id).alias("__id"), text_of(text).alias("text")).join(F.broadcast(sample), "__id").groupBy("__id").agg(F.min("__label").alias("__label"), F.min("text").alias("text"))
        shared = docs.sparkSession.sparkContext.broadcast(vectors)

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = pooled(shared.value, batch, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "label", "x"])

        got = small_batches(chosen).mapInArrow(lean(features), "id long, label int, x array<float>").toPandas().sort_values("id")
        x = np.array(got["x"].tolist(), np.float32).reshape(len(got), vectors.shape[1])
        return cls(vectors, fit(x, got["label"].to_numpy()))

    def score(self, docs: DataFrame, text: str = "text", column: str = "score") -> DataFrame:
        """The input's rows and columns with the score added; an input column of that name is replaced."""
        shared, spark = docs.sparkSession.sparkContext.broadcast((self.vectors, self.network)), docs.sparkSession
        kept = [c for c in docs.columns if c.lower() != column.lower()]
        rows = docs.select(*[F.col(f"`{c}`") for c in kept], text_of(text).alias(free_name(docs, "scored_text")))
        schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(column, T.DoubleType())])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors, network = shared.value
            for batch in batches:
                p = network.probability(pooled(vectors, batch, batch.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=[*batch.schema.names[:-1], column])

        return small_batches(rows).mapInArrow(lean(score), schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows that the classifier does not reject, with the input's columns."""
    column = free_name(docs, "score")
    return QualityModel.train(docs, labels, text=text).score(docs, text, column).filter(F.col(column) >= threshold).drop(column)


def op9_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = QualityModel.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
