"""The corpus pipeline: quality rules, quality classifier, line dedup, near-duplicate removal, packing.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import convnet, lines, packing, rules, simhash
from tidewater.llm.common import stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labelling keep. Null and repeated ids are rows like others; a null text goes."""
    return rules.keep(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network keeps, learned from labelled documents of the original table. Null and repeated ids are rows like others."""
    labels = convnet.training_labels(table(spark, sf_dir, "labels"))
    return convnet.keep(docs, convnet.fit(table(spark, sf_dir, "documents"), labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; rows without an id stay untouched, and texts of one id are told apart."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, rows without an id and repeated rows included."""
    return simhash.keep_first(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences; an empty table gives none."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds every stage, and the whole, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
