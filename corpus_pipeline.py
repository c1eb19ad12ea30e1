"""A corpus pipeline: quality filter, near-duplicate removal, decontamination, secret masking, packing.

Each stage gets what its predecessor kept, works on all of it, and is written as Parquet before the next one reads it. All but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import common, decontaminate, packing, quality, secrets, simhash

TOKENIZER = "byte_bpe_50k.json"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels of the documents at hand."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates: fingerprints of five words at 3 bits, or 80 of 100 shingles alike."""
    return simhash.deduplicate(docs, n=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked, and their new lengths."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("secrets", masked), ("packing", packed)]
#: Fingerprints, components, alignments, trained rules and tokenizers are no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, name)
    return docs
