"""A training corpus from raw documents, in stages that are each written as Parquet and read again.

The cases of each stage (nulls, empty and long texts, repeats, empty tables) are those of the operator it calls, whose module
states them: a text that is null, empty or of no known language goes in the first stage; rows of null ``doc_id`` pass the
others; rows that share a ``doc_id`` are one document to the second and third; an empty table gives an empty one.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.bpe import encode
from plumbline.llm.common import shared_folder, table
from plumbline.llm.decontaminate import decontaminate
from plumbline.llm.language import identified
from plumbline.llm.linededup import without_duplicates
from plumbline.llm.simhash import deduplicated

#: No single SQL statement expresses these stages; a test holds the rows of ``run`` against brute-force versions of them.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the string kernels can't tell go; ``lang`` becomes the language found."""
    return identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or nearly equals go, and documents that this leaves blank."""
    return without_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are taken out of the texts."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether decoding them gives the text back."""
    return encode(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage returns is written in the folder of spark.checkpoint.dir that all machines share."""
    folder = f"{shared_folder(spark)}/pipeline-{os.urandom(8).hex()}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
