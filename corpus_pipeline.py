"""A corpus pipeline: language ID, near-dedup, passage dedup, decontamination, sampled segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigraph.llm import decontaminate, langid, sentencepiece_sampling, simhash, suffix_dedup
from lexigraph.llm.textops import written
from lexigraph.runtime import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language the hierarchical classifier can tell; it is fitted on at most langid.TRAIN_PER_LANG rows a language of the corpus."""
    ship(spark)
    return langid.keep_identified(docs, langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least id."""
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with each passage of 50 words or more left in one document only."""
    ship(spark)
    return suffix_dedup.drop_repeated_passages(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark passage."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces, n_bytes, lossless): a sampled segmentation of each text, and that it decodes to the text."""
    ship(spark)
    return sentencepiece_sampling.encode(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("passage_dedup", drop_repeated_passages),
    ("decontaminate", decontaminate_benchmark),
    ("encode", encode_pieces),
]

#: SQL has neither the classifier nor the fingerprints; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
