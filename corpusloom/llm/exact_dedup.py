r"""Exact dedup by content-defined chunk recipes, on DataFrame functions alone.

1. Every normalised text is cut where its content says so (a boundary character before certain
   others, after 64 characters, 2,048 at most), so equal texts have equal chunks.
2. Chunks are deduplicated by digest, map-side first. The dictionary compares the chunk texts under each digest;
   a digest with one text is a verified identifier. If any digest holds two texts, all identifiers are widened.
3. A document becomes its ordered identifier list (its recipe, about 5 % of its bytes). Only recipes are grouped and
   joined; long documents never move again.

Defined cases: null text is empty; all empty texts form one group; repeated rows (same id) count as rows; ties in
length go to the smallest id, rows without an id after all others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ASCII_SPACE, free_name, materialize, text_of

#: A chunk ends with the first boundary after MIN_CHUNK characters, or at about MAX_CHUNK: it depends on what stands there, so an edit moves
#: the chunks next to it and no others. A boundary is a boundary character before one of NEXT, about every 200 characters.
MIN_CHUNK, MAX_CHUNK, NEXT = 64, 2048, "aehtAEHT"
#: The boundary characters. ASCII alone: a regex tests those by a bit set, others one by one (five times the
#: time measured). A text without them is cut at MAX_CHUNK, which is as exact.
BOUNDARY = ".!?;:|"

CHUNK = f"(?s).{{{MIN_CHUNK}}}(?:[^{BOUNDARY}]{{1,32}}+|[{BOUNDARY}](?![{NEXT}])){{0,{(MAX_CHUNK - MIN_CHUNK) // 32 - 1}}}+[{BOUNDARY}]?|.+"


def normalized(text: Column) -> Column:
    r"""The text without any character of [\x20\x09-\x0D]."""
    for space in ASCII_SPACE:  # a byte search each: a sixth of the time of translate()
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def chunks_of(norm: Column) -> Column:
    """The normalised text as an array of content-defined chunks, in order; none for the empty text."""
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def _narrow(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk.cast("binary")))


def _wide(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk.cast("binary"), 256))


def chunk_dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per distinct chunk digest: chunk_id, documents (that hold it), verified (one text only), chunk_chars."""
    chunk = F.col("chunk")
    found = docs.select(F.explode(F.array_distinct(chunks_of(normalized(text_of(text))))).alias("chunk"))
    return (
        found.groupBy(_narrow(chunk).alias("chunk_id"))
        .agg(F.min(chunk).alias("low"), F.max(chunk).alias("high"), F.count("*").alias("documents"))
        .select("chunk_id", "documents", (F.col("low") == F.col("high")).alias("verified"), F.length("low").alias("chunk_chars"))
    )


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", wide: bool = False) -> DataFrame:
    """doc_id, chars (code points of the original), text_sha256 (of the normalised text), recipe (identifiers in order)."""
    base = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    return base.select("doc_id", F.length("t").cast("long").alias("chars"), normalized(F.col("t")).alias("n")).select(
        "doc_id", "chars", F.sha2(F.col("n").cast("binary"), 256).alias("text_sha256"), F.transform(chunks_of(F.col("n")), _wide if wide else _narrow).alias("recipe")
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, chunks (the recipe's length).

    Of rows that repeat the kept id itself, each counts as kept.
    """
    clashes = chunk_dictionary(docs, text).filter(~F.col("verified")).agg(F.count("*")).first()[0]
    rows = materialize(recipes(docs, doc_id, text, wide=clashes > 0), "recipes")
    groups = rows.groupBy("recipe").agg(
        F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"))).alias("best"), F.count("*").alias("group_size")
    )
    # Unique texts need no join. What is joined is a table of its own, so that a hot recipe can be split on the other side.
    many = materialize(groups.filter("group_size > 1").select("recipe", F.col("best.d").alias("keep_id"), "group_size"), "groups")
    return rows.join(many, "recipe", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")) | F.col("group_size").isNull(), F.lit(True)).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("chunks"),
    )


def keep_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows and columns without all but one copy of each text. An id's other texts stay; rows that repeat an id and text give one row."""
    verdict = exact_dedup(docs, doc_id, text)
    own, of, which = (free_name(docs, n) for n in ("sha", "gone", "gone_sha"))
    gone = verdict.filter(~F.col("kept")).select(F.col("doc_id").alias(of), F.col("text_sha256").alias(which)).distinct()
    marked = docs.withColumn(own, F.sha2(normalized(text_of(text)).cast("binary"), 256))
    left = marked.join(gone, F.col(doc_id).eqNullSafe(F.col(of)) & (F.col(own) == F.col(which)), "left_anti")
    if verdict.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1").limit(1).count():
        left = left.dropDuplicates([doc_id, own])  # only where an id and text come more than once
    return left.drop(own)


def op1_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
