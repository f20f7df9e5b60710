"""Corpus pipeline: documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes to the shared scratch folder and reads back as the next one's documents.
All but the last return the columns of ``documents``.

1. language_id: documents in which no language is found go.
2. line_dedup: lines that an earlier line resembles go; n_chars follows the text.
3. simhash_near_dedup: one document of each group of near-duplicates stays.
4. benchmark_decontamination: documents that hold a benchmark item go.
5. packing: the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownergraph.llm import edit_match, language_gru, line_dedup, packing, simhash_anchor
from ownergraph.llm.common import prepare, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language_gru.in_known_language(docs)


def near_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = line_dedup.dedup_lines(docs)
    kind = dict(docs.dtypes).get("n_chars")
    return out if kind is None else out.withColumn("n_chars", F.length("text").cast(kind))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash_anchor.one_of_each(docs, shingle=4, bits=4)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return edit_match.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", near_line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

# A trained network, edit distances and token ids are beyond SQL; the tests hold
# the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
