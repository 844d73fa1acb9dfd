"""From raw documents to tokens: the training-data pipeline.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept: documents that
the quality classifier rejects go, one document of each near-duplicate group stays, documents with test
items in them go, personal data is masked, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import bpe, decontaminate, minhash, pii, quality
from panelspark.llm.common import stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def no_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs, pii.train(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, bpe.default_vocabulary(), keep_ids=True)


STAGES = [("quality classifier", good_quality), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", no_test_items), ("PII", masked), ("BPE encoding and decoding", encoded)]

#: SQL can't express the stages (trained models, alignment, BPE); tests/llm/test_pipeline.py tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's last table, over all of documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
