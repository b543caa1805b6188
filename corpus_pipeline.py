"""From raw documents to packed sequences, in five stages, each written and read again."""

from __future__ import annotations

import public_tokenizers as vocabulary
from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import decontam, packing, quality, similar, substrings
from keyloom.llm.common import held_out, new_path, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good; it learns from the same rows as op7."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    columns = docs.columns
    return quality.with_scores(docs, model).where("predicted = 1").select(*columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, a Jaccard similarity of 0.8 or more."""
    return similar.one_of_each(docs, shingle=5, least=0.8)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs with edits to up to 8 % of its characters."""
    return decontam.without_matches(docs, table(spark, sf_dir, "benchmark"), max_error=0.08)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary.path("byte_bpe_50k.json"), vocabulary.path("byte_bpe_50k.tiktoken"), vocabulary.PATTERN)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_near_copies),
    ("suffix-array dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: Compression, hashing, edit distances and tokenisation cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
