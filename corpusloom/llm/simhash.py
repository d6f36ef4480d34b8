r"""SimHash near-dedup by pigeonhole blocks.

A document's fingerprint has a bit for each bit position of its shingles' XXH64 hashes: 1 if set in over half of them. Of
fingerprints that differ in at most 3 bits, cut into 6 blocks, at least 3 blocks agree; so each fingerprint stands in one bucket
for each of the 20 choices of 3 blocks (30 to 33 bits), and close pairs share a bucket. Only distinct fingerprints go into
buckets. Within a bucket Hamming distances are verified from one member at a time against those that nothing has reached yet,
and members are linked to their component's first: as many edges as members, never all pairs.

Defined cases: null and blank texts have fingerprint zero, which links like any other; texts with fewer words than a shingle
have their whole word sequence as one; repeated rows count each; rows without an id link like any other but name no component
(null, if no row of it has an id); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, materialize, parallelism, small_batches, text_of
from corpusloom.llm.components import components

WORDS, BITS, SEED = 3, 3, 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SHINGLES_AT_ONCE = 1 << 16


def word_list(text: str) -> list[bytes]:
    r"""The words [^\x20\x09-\x0D]+ of a text in UTF-8, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit; zero without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SHINGLES_AT_ONCE):
        part = np.ascontiguousarray(hashes[at : at + _SHINGLES_AT_ONCE])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(shingle_hashes(word_list(t.as_py()), words)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return small_batches(rows).mapInArrow(lean(of), "doc_id long, fp long")


def block_masks(bits: int = BITS, blocks: int | None = None) -> list[int]:
    """Masks of the blocks that fingerprints with at most so many differing bits may share: every choice of the blocks that agree."""
    blocks = blocks or 2 * bits
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    cut = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(choice) for choice in combinations(cut, blocks - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(codes: np.ndarray, bits: int) -> np.ndarray:
    """For each of the distinct codes, the first member of its component under links of at most so many differing bits."""
    first = np.full(len(codes), -1)
    rest = np.arange(len(codes))
    while len(rest):
        seed, rest = int(rest[0]), rest[1:]
        first[seed], queue = seed, [seed]
        while queue and len(rest):
            near = np.bitwise_count(codes[rest] ^ codes[queue.pop()]) <= bits
            if near.any():
                first[rest[near]] = seed
                queue += rest[near].tolist()
                rest = rest[~near]
    return first


def _links(bits: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, key, fp, node) sorted by block and key: edges (first, member) of each bucket."""

        def edges(block, key, fp, node):
            cut = np.flatnonzero((block[1:] != block[:-1]) | (key[1:] != key[:-1])) + 1
            at, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            size = end - at
            two = at[size == 2]
            close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
            a, b = [node[close]], [node[close + 1]]
            for s, e in zip(at[size > 2].tolist(), end[size > 2].tolist(), strict=True):
                first = forest(fp[s:e], bits)
                own = np.flatnonzero(first != np.arange(e - s))
                a.append(node[s + first[own]])
                b.append(node[s + own])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now[2] = now[2].view(np.uint64)
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            last = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0  # the last bucket may go on in the next batch
            if last:
                yield edges(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield edges(*held)

    return links


def linked(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """From distinct fingerprints (fp, node): edges (a, b) of nodes whose components are those of all close pairs."""
    choice = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(block_masks(bits))]))
    rows = prints.select("fp", "node", choice.alias("c")).select("c.block", "c.key", "fp", "node")
    return rows.repartition(parallelism(prints.sparkSession), "block", "key").sortWithinPartitions("block", "key").mapInArrow(lean(_links(bits)), "a long, b long")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (the smallest doc_id reachable over links, itself included)."""
    each = materialize(fingerprints(docs, doc_id, text, words), "fingerprints")
    # Nodes are the fingerprints themselves: ids may be null or repeat.
    prints = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    found = components(linked(prints.select("fp", F.col("fp").alias("node")), bits)).withColumnRenamed("node", "fp")
    placed = materialize(prints.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "placed")
    least = materialize(placed.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    classes = materialize(placed.join(least, "component").select("fp", "component_id"), "classes")
    return each.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op3_simhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
