"""Token ids as ORC: stripes with integer run-length encoding, row indexes and Bloom filters on the document ids.

Documents are dealt by ranges of their ids and sorted within each range, so files, stripes and row groups hold disjoint id
ranges: readers skip by the ids' statistics and Bloom filters, and read stripes in parallel. A row is doc_id, part, first (the
ids before it in its part), n (its ids), ids.

Defined cases: null text is empty and has the end id alone; repeated ids stand next to each other, in the order of their texts'
hashes; an empty table gives an empty file set, which reads as no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, scratch, small_batches, text_of
from corpusloom.llm.tokens import encoder, row_parts

END_ID = 2
ROW = "doc_id long, part int, first long, n int, ids array<int>"
#: ORC settings: row groups of 2,000 documents, stripes of 32 MB.
ORC = {"orc.compress": "ZSTD", "orc.stripe.size": str(32 << 20), "orc.row.index.stride": "2000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


def token_rows(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """doc_id, part, first, n, ids: in ascending order of doc_id over parts and within them."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, ids_of = TaskContext.get().partitionId(), 0, encoder(tokenizer).encode
        for batch in batches:
            keys = batch.column(0)
            for at, texts in row_parts(batch.column(1)):
                ids, counts = ids_of(texts)
                ends = np.cumsum(counts)
                ids = np.insert(ids.astype(np.int32), ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
                starts = np.concatenate([[0], ends[:-1]])
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(texts)), pa.array(np.full(len(texts), part), pa.int32()), pa.array(before + starts, pa.int64()), pa.array(ends - starts, pa.int32()), lists], schema=schema)
                before += int(ends[-1])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    tie = F.xxhash64("text")
    return small_batches(rows).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie).select("doc_id", "text").mapInArrow(lean(encode), ROW)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    token_rows(docs, tokenizer, doc_id, text, end_id).write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW).orc(path)


def token_index(rows: DataFrame) -> DataFrame:
    """From the files: doc_id, start (the ids of all documents before it), n_tokens, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            ids, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    read = small_batches(rows).mapInArrow(lean(digest), "doc_id long, part int, first long, n_tokens long, ids_crc32 long")
    # A part's size is its last row's end: one number a file, without its ids. The running sum is over files, not documents.
    parts = rows.groupBy("part").agg(F.max(F.col("first") + F.col("n")).alias("size"))
    before = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return read.join(before, "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_output(spark, sf_dir):
    import public_tokenizers

    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), scratch(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_index(read_tokens(spark, path))
