"""Training-data pipeline: quality rules, near-duplicates, PII, mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's documents.

Defined results: a null, empty or blank text has no words and is rejected by the
first stage; null ids, sources and other columns pass, a null source being a
source; equal rows and near copies leave one row each group; a very long text is
read whole in every stage and cut into pieces only by the last; no documents
give no rows.  All stages but the last return the documents' columns, whatever
further ones they have.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from topicscope.llm import packing, pii_surrogates, quality_llr, simhash_dedup, source_mixing
from topicscope.llm.common import stage_table
from topicscope.sources.tables import read_table

#: Key of the surrogates; a real run passes a secret one.
PII_KEY = "surrogate-key-1"
CAPACITY, END_ID = 1024, 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_llr.keep_good(docs, trusted)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs, shingle=4, radius=4)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace_pii(docs, PII_KEY, count_col=None)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.mixed_rows(docs, weights=(5, 2, 1), total_share=1.5, max_copies=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=CAPACITY, end_id=END_ID)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", pack)]
#: Hashes, model fits and best fit have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
