"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import os
import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import byte_bpe, fingerprints, jaccard_join, kneser_ney, language_id, licenses, packing, pii, quality_rules, token_counts
from weftline.session import table

#: Paths of vocabulary files; other files of the same kinds may be given in their place.
RANKS = os.environ.get("WEFTLINE_RANKS") or public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = os.environ.get("WEFTLINE_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
#: The secret of the surrogates. Without a setting it is drawn anew for each process: nobody can compute the surrogates
#: again, and they differ from run to run.
PII_KEY = os.environ.get("WEFTLINE_PII_KEY", "").encode() or secrets.token_bytes(32)


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, folder, "documents"), RANKS, PATTERN)


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), JSON, PATTERN, capacity=1024, end=2)


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, folder, "documents"))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), JSON, PATTERN, limit=1024)


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymize(table(spark, folder, "documents").select("doc_id", "text"), PII_KEY)


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, folder, "documents"), size=4, percent=85)


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_byte_bpe, op3_packing, op4_fingerprints, op5_quality_classifier, op6_token_counts, op7_language_id, op8_pii, op9_jaccard_join, op10_license_scan)}
ORACLE_SQL = {"op10_license_scan": licenses.scan_sql()}
