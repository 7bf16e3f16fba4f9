"""From documents to packed sequences: language, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept, written as Parquet
and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphweft.llm.common import SharedTables, read_table
from graphweft.llm.decontamination import remove_contamination
from graphweft.llm.jaccard_join import keep_one_of_each
from graphweft.llm.language_id import keep_identified
from graphweft.llm.packing import pack_documents
from graphweft.llm.tokenizing import tokenizer_path
from graphweft.plans.shipping import ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter whose main language makes up half of them at least."""
    ship_package(spark)
    return keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that links of Jaccard 0.8 over five-word shingles connect."""
    return keep_one_of_each(docs, 5, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of ten words or more that stand in a benchmark item, and whole items of fewer words; a document of little else goes."""
    return remove_contamination(docs, read_table(spark, sf_dir, "benchmark"), 10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 1, 4096)


STAGES = [("language", language), ("near_copies", near_copies), ("decontaminate", decontaminate), ("pack", pack)]

#: Mixture inference, tokenizers and packing are not SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, docs = SharedTables(spark), read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
