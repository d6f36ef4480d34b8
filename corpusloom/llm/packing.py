"""Best-fit packing by hierarchical residuals.

1. Each document becomes its token ids and an end id; only longer ones than a sequence are cut.
2. Pieces are dealt over tasks by a hash and packed best fit, longest first, within each task. Full or nearly full bins are
   done there.
3. What is underfull goes up a tree, as one item a bin: tasks of FAN_IN groups meet, best fit again, and so on to the root.
   Two bins over half full can't meet, and a task holds at most one that is not, so a group needs to hand on that one and its
   FAN_IN emptiest others: what meets at any node is bounded by FAN_IN * (FAN_IN + 1) bins, at any input.

pack() places pieces and moves their lengths alone. pack_sequences() makes the sequences themselves: ids move once, to the task
that fills its bins with them, and only what goes up the tree moves again.

Defined cases: null text is empty and has the end id alone; repeated rows are packed each for itself; ties go to the longer
waiting bin; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, materialize, small_batches, text_of
from corpusloom.llm.tokens import encoder, row_parts

SEQUENCE, END_ID = 2048, 0
#: Pieces that one task packs without ids, and ids that one task packs: a few MB, and 16 MB.
PIECES_PER_TASK, IDS_PER_TASK = 100_000, 4_000_000
FAN_IN = 8
#: A bin with at most this many places left is not handed on.
NEARLY_FULL = 0

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, texts in row_parts(batch.column(1)):
                ids, counts = encode(texts)
                ids, ends = ids.astype("<u4"), np.cumsum(counts)
                out = []
                for key, end, count in zip(keys[at : at + len(texts)], ends.tolist(), counts.tolist(), strict=True):
                    whole = np.append(ids[end - count : end], np.uint32(end_id))
                    for n, start in enumerate(range(0, count + 1, size)):
                        part = whole[start : start + size]
                        out.append((key, n, start, len(part), zlib.crc32(part.tobytes()), *([part.astype("i4")] if with_ids else ())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return small_batches(rows).mapInArrow(lean(cut), PIECE + (", ids array<int>" if with_ids else ""))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best fit, largest first: each item's bin and place in it, and the bins' fill."""
    bins, places, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    some = 0  # bit r is set if a bin with room r waits
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                some ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], places[i] = b, fill[b]
        fill[b] += n
        if room > n:
            if not waiting[room - n]:
                some |= 1 << (room - n)
            waiting[room - n].append(b)
    return bins, places, fill


def handed_on(fill: np.ndarray, capacity: int, fan_in: int = FAN_IN) -> np.ndarray:
    """Which bins go up the tree: those not over half full (one at most), and the emptiest fan_in of the others."""
    order = np.argsort(fill, kind="stable")
    small = int((fill[order] * 2 <= capacity).sum())
    chosen = order[: small + fan_in]
    return np.sort(chosen[fill[chosen] < capacity - NEARLY_FULL])


def _pack(capacity: int):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([f for f in frames if len(f)] or [pd.DataFrame()], ignore_index=True)
        if rows.empty:
            return
        task = TaskContext.get().partitionId()
        bins, places, fill = best_fit(rows["length"].to_numpy(), capacity)
        fill = np.array(fill)
        up = np.zeros(len(fill), bool)
        up[handed_on(fill, capacity)] = True
        yield rows.assign(bin=bins + (task << 32), place=places, node=task, fill=fill[bins], up=up[bins])

    return pack


def _merge(capacity: int):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        """One node of the tree. members: bins that stand together, and where each begins."""
        rows = rows.sort_values("bin", ignore_index=True)
        bins, places, fill = best_fit(rows["fill"].to_numpy(), capacity)
        up = set(handed_on(np.array(fill), capacity).tolist())
        out = {}
        for i, (b, place) in enumerate(zip(bins.tolist(), places.tolist(), strict=True)):
            held = out.setdefault(b, {"bin": rows.at[i, "bin"], "fill": fill[b], "node": rows.at[i, "node"], "up": b in up, "members": []})
            held["members"] += [{"bin": m["bin"], "begin": m["begin"] + place} for m in rows.at[i, "members"]]
        return pd.DataFrame(list(out.values()))

    return merge


def _numbered(pieces: DataFrame) -> DataFrame:
    """Pieces as a written table with a number for each row, by which they are dealt: a hash of what the piece is, so that the table's partitions have no say.

    Rows that have no id, or ask for none, may be any number of equals: those are dealt by their place.
    """
    known = [c for c in ("doc_id", "piece", "start", "length", "ids_crc32") if c in pieces.columns]
    place = F.monotonically_increasing_id()
    number = F.when(F.col("doc_id").isNull(), place).otherwise(F.xxhash64(*known)) if "doc_id" in known else place
    return materialize(pieces.withColumn("__row", number), "pieces")


def _tree(bins: DataFrame, capacity: int) -> DataFrame:
    """From bins (bin, fill, node): bin, sequence_id, begin, after best fit from node to node up to the root."""
    node = "bin long, fill long, node long, up boolean, members array<struct<bin:long,begin:long>>"
    level = bins.withColumn("members", F.array(F.struct("bin", F.lit(0).cast("long").alias("begin")))).withColumn("up", F.lit(True))
    done, nodes = [], bins.agg(F.max("node")).first()[0] or 0
    while True:
        nodes //= FAN_IN
        level = materialize(
            level.filter("up").withColumn("node", F.floor(F.col("node") / FAN_IN)).select("bin", "fill", "node", "up", "members")
            .groupBy("node").applyInPandas(_merge(capacity), node), "level",
        )
        done.append(level if not nodes else level.filter("not up"))
        if not nodes:
            break
    moved = done[0]
    for d in done[1:]:
        moved = moved.unionByName(d)
    return moved.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")).select("sequence_id", F.col("m.bin").alias("bin"), F.col("m.begin").alias("begin"))


def pack(pieces: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """Pieces (any columns, with a length of 1 to capacity) with sequence_id and offset added."""
    rows = _numbered(pieces)
    tasks = max(1, -(-rows.count() // PIECES_PER_TASK))
    more = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    packed = materialize(rows.repartition(tasks, "__row").mapInPandas(lean(_pack(capacity)), f"{more}, bin long, place long, node long, fill long, up boolean"), "packed")
    moved = _tree(packed.filter("up").groupBy("bin").agg(F.first("fill").alias("fill"), F.first("node").alias("node")), capacity)
    return packed.join(moved, "bin", "left").select(
        *pieces.columns, F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("begin", F.lit(0))).alias("offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents packed into sequences: one row per piece with its place, sequence_id and offset."""
    return pack(token_pieces(docs, tokenizer, doc_id, text))


DOCUMENT = "struct<doc_id:long,piece:int,start:long,offset:long,length:long>"


def _fill(capacity: int):
    kind = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
    schema = pa.schema([("bin", pa.int64()), ("node", pa.int64()), ("fill", pa.int64()), ("up", pa.bool_()), ("ids", pa.list_(pa.int32())), ("documents", pa.list_(kind))])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, piece, start, length, ids), a few million ids in all: one row per bin."""
        given = [b for b in batches if b.num_rows]
        if not given:
            return
        task, rows = TaskContext.get().partitionId(), pa.Table.from_batches(given)
        sizes = rows["length"].to_numpy()
        bins, places, filled = best_fit(sizes, capacity)
        up = np.zeros(len(filled), bool)
        up[handed_on(np.array(filled), capacity)] = True
        order = np.lexsort((places, bins))
        rows = rows.take(pa.array(order)).combine_chunks()
        upto = np.searchsorted(bins[order], np.arange(len(filled) + 1))  # each bin's pieces
        ends = np.concatenate([[0], np.cumsum(sizes[order])])
        flat = rows["ids"].combine_chunks().flatten()
        ids = pa.ListArray.from_arrays(pa.array(ends[upto], pa.int32()), flat)
        inside = pa.StructArray.from_arrays([*(rows[c].combine_chunks() for c in ("doc_id", "piece", "start")), pa.array(places[order]), rows["length"].combine_chunks()], fields=list(kind))
        documents = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), inside)
        number = np.arange(len(filled)) + (task << 32)
        out = [pa.array(number), pa.array(np.full(len(filled), task)), pa.array(np.array(filled, np.int64)), pa.array(up), ids, documents]
        whole = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
        for at in range(0, len(filled), 256):
            yield whole.slice(at, 256)

    return fill


def pack_sequences(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The sequences: sequence_id, ids, documents (doc_id, piece, start in the document, offset in the sequence, length), in order."""
    rows = _numbered(token_pieces(docs, tokenizer, doc_id, text, size, end_id, with_ids=True))
    tasks = max(1, -(-(rows.agg(F.sum("length")).first()[0] or 0) // IDS_PER_TASK))
    dealt = rows.select("__row", "doc_id", "piece", "start", "length", "ids").repartition(tasks, "__row").drop("__row")
    bins = materialize(dealt.mapInArrow(lean(_fill(size)), f"bin long, node long, fill long, up boolean, ids array<int>, documents array<{DOCUMENT}>"), "bins")
    moved = _tree(bins.filter("up").select("bin", "fill", "node"), size)
    parts = F.sort_array(F.collect_list(F.struct("begin", "ids", "documents")))  # the bins of one sequence
    shifted = F.transform("p", lambda b: F.transform(b["documents"], lambda d: d.withField("offset", d["offset"] + b["begin"])))
    merged = bins.filter("up").join(moved, "bin").groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.flatten(shifted).alias("documents"))
    return bins.filter("not up").select(F.col("bin").alias("sequence_id"), "ids", "documents").unionByName(merged)


def op2_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
