"""From raw documents to token ids: quality, near duplicates, passages, mix, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all
but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from icestats.llm.common import store, table
from icestats.llm.jaccard import keep_one
from icestats.llm.mixing import mix_rows
from icestats.llm.passages import cut_passages
from icestats.llm.pieces import encode_decode
from icestats.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave the compression bands go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of Jaccard similarity 0.8 the least id stays."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut out."""
    return cut_passages(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay once, twice or not at all, so that sources meet their targets."""
    return mix_rows(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the text they decode to."""
    return encode_decode(docs)


STAGES = [
    ("quality_rules", quality_rules), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", repeated_passages),
    ("source_mix", source_mix), ("sentencepiece", pieces),
]
#: Compression ratios and model ids have no SQL form; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
