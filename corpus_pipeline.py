"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, encoding.

Every stage is (spark, docs, folder) -> DataFrame over all rows that the stage before it kept, and
is written and read again. All but the last return the columns of `documents`.

Defined cases: a null or blank text fails the quality rules and goes there; an empty table passes every
stage as an empty table; equal rows and rows without an id are judged like others, one of each group of
copies stays; of ties in the near-dedup the smallest id stays. Columns beyond those of `documents` are
carried along, whatever their names. Texts of any length are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskspark.llm.bpe import encode_documents
from riskspark.llm.common import table, write_shared
from riskspark.llm.linededup import dedup_documents
from riskspark.llm.mixing import mixed_documents
from riskspark.llm.quality import clean_documents
from riskspark.llm.simhash import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Failing lines go, and documents that fail the base rules or lose too much text."""
    return clean_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines that an earlier document has, or nearly has, go; so do documents left without a word."""
    return dedup_documents(docs, short=True)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every group of near copies stays: SimHash of three-word shingles, at most 3 bits apart."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as the source weights take them: some not at all, some twice, a few in part."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document, with their count and digests."""
    return encode_documents(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mixing", mixing),
    ("bpe encoding", encoding),
]

#: The edit join, the fingerprints and the vocabulary are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
