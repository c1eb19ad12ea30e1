"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from secrets import token_hex

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, lloyd, matroska, ngramjoin, packing, pii, quality, secrets, simhash, urls, variants, warc
from .common import table


#: The session's setting that holds the key of pseudonyms. Without it each application draws one, so its pseudonyms can't be undone, nor linked to another's.
PII_KEY = "spark.folioscope.piiKey"
_drawn: dict[str, str] = {}


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(PII_KEY, None) or _drawn.setdefault(spark.sparkContext.applicationId, token_hex(32))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "unit", "gap")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.features(matroska.media(table(spark, sf_dir, "documents")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(table(spark, sf_dir, "embeddings"))


def op12_grouped_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.link_documents(table(spark, sf_dir, "documents"))


def op13_trie_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_secrets, op3_warc, op4_quality, op5_packing, op6_simhash, op7_urls, op8_language, op9_matroska, op10_decontaminate, op11_dual_tree, op12_grouped_prefix, op13_trie_variants, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": secrets.oracle(), "op3_warc": warc.oracle(), "op11_dual_tree": lloyd.oracle(), "op12_grouped_prefix": ngramjoin.oracle()}
