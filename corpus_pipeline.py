"""From raw documents to packed training sequences.

STAGES lists (name, function) in order; a function takes (spark, docs, sf_dir), where docs is what
the stage before returned, and returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm import mixing, ngram_join, packing, pii_crf, quality_rules
from lintel.llm.common import cut, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified quality rule go."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest doc_id stays, once; texts without words are no duplicates."""
    return ngram_join.keep_one(docs, 5, 80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by the name of its kind."""
    return pii_crf.mask_pii(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat, or are cut, as the target weights of their sources ask."""
    return mixing.repeat_rows(mixing.mix(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows in sequences of fixed length."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_join", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Message passing and tokenizing are not expressible in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; what one returns is stored before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
