"""A corpus pipeline of five operators: documents in, packed sequences out.

Each stage takes (spark, docs, folder) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from weftline.llm import jaccard_join, kneser_ney, packing, pii, quality_rules
from weftline.llm.queries import JSON, PATTERN, PII_KEY
from weftline.session import materialize, table


def rule_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def model_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the language model rejects go."""
    return kneser_ney.keep(docs, table(spark, folder, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the least doc_id stays, once.

    Components name their least doc_id, so a document stays if it is its component's name. Only ids that go are joined
    to the texts. Of rows that share a doc_id one stays; rows with a null id stay.
    """
    found = jaccard_join.jaccard_components(docs, size=5, percent=80)
    gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
    repeated = materialize(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if not repeated.take(1):
        return kept
    # few rows: of each repeated id the one whose text sorts first
    several = kept.join(repeated, kept["doc_id"] == repeated["doc_id"], "left_semi")
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    one = several.select(F.struct("*").alias("row"), "doc_id", "text").select("row", rank.alias("rank")).where("rank = 1").select("row.*")
    return kept.join(repeated, kept["doc_id"] == repeated["doc_id"], "left_anti").unionByName(one)


def surrogates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data are replaced; n_chars follows the text."""
    done = pii.pseudonymize(docs, PII_KEY).select(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents' pieces in sequences of 1024 tokens."""
    return packing.pack_documents(docs, JSON, PATTERN, capacity=1024, end=2)


STAGES = [("quality rules", rule_quality), ("quality classifier", model_quality), ("n-gram Jaccard join", deduplicate), ("PII surrogates", surrogates), ("best-fit packing", pack)]

#: Tokens, hashes of n-grams and model scores are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
