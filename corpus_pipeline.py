"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Columns of documents beyond the usual ones, whatever their names, go along up to the last stage. Rows without doc_id,
repeated rows and an empty table are handled in each stage as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metrikon.llm import bpe, mixing, pii, quality, simhash
from metrikon.llm.common import stage, table
from metrikon.llm.queries import PII_KEY, vocabulary


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. A null or empty text has the score of the bias, repeated rows and null ids are judged like others."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest doc_id; a repeated row once. Rows without doc_id stay; null and wordless texts are one component."""
    return simhash.keep_one(docs)


def hide(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; null and empty texts stay as they are."""
    return pii.pseudonymise(docs, PII_KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their tempered weights; a document that is taken twice is two rows. A null source is a source; rows without doc_id are mixed too."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoding; null and empty texts have none."""
    return bpe.encode_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality classifier", classify), ("simhash near-dedup", dedup), ("pii surrogates", hide), ("temperature mixing", mix), ("bpe encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name.split()[0])
    return docs
