"""A training-data pipeline over documents: quality, exact and near copies, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers

from corpusloom.llm import exact_dedup, mixing, near_dedup, packing, quality
from corpusloom.llm.common import materialize

#: The mix that repeats no source more often than this and has every document once at least.
REPEATS = 1.25


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier does not reject."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark, docs, sf_dir):
    """One copy of each text."""
    return exact_dedup.keep_exact(docs)


def near_stage(spark, docs, sf_dir):
    """One document of each group of near copies: SimHash links as in op3, checked on five-word shingles (similarity of 0.8 or more), and by a prefix join those that fingerprints miss."""
    return near_dedup.keep_near(docs)


def mix_stage(spark, docs, sf_dir):
    """Sources at the flattest temperature mix within the repetition limit; repeated documents are repeated rows."""
    return mixing.mixed(docs, budget="cover", repeats=REPEATS)


def packing_stage(spark, docs, sf_dir):
    """The training sequences: their token ids, and which document stands where in them."""
    return packing.pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mix_stage), ("packing", packing_stage)]

#: SQL has no classifier, SimHash search or tokenizer; the tests compare each stage with a plain form of it.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
