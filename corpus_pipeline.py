"""A training corpus from the documents table, in five stages: each reads what the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.llm import bpe, decontaminate, minhash, quality_rules, secret_scan
from echoframe.llm.scratch import Intermediates, Tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules of their own text and of their host."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the least id."""
    return minhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced; ``n_chars`` follows the text."""
    out = secret_scan.redacted(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and digests of the ids and of the bytes that they decode to."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ids=True)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("byte-level BPE", tokens),
]

#: Near duplicates, edit distances and BPE have no SQL form; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, by all stages in order; each stage's table, and what it wrote on its way, go when the
    next is written.

    Defined cases: null and empty texts fail the quality rules; rows with one id are one document; very long texts are taken
    whole; equal texts leave the one with the least id; an empty table gives an empty result; further columns of the
    documents, whatever their names, pass through all stages but the last.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Tables(spark, "pipeline") as tables:
        for name, stage in STAGES[:-1]:
            made = Intermediates()
            kept = stage(spark, docs, sf_dir)
            made.end()
            done = tables.put(kept, name.replace(" ", "-"))
            made.remove(spark)
            tables.drop(docs)
            docs = done
        tables.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
