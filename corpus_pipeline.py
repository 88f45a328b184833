"""The corpus pipeline (part of the training-data operators): quality, near-duplicates, decontamination, mixing, token ids.

Each stage works on what the stage before it has written, and the last one returns token_id rows for the documents that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptoria.llm import stages
from scriptoria.llm.common import stored, table
from scriptoria.llm.token_shards import token_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.good_quality(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.remixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_table(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing to target weights", mixing_to_weights),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs


#: Expectation-maximisation, similarity joins, the draw and the encoding have no SQL form. The tests hold the near-duplicate stage and the ids against brute force, and the others against what their operators report.
ORACLE_SQL = None
