"""From documents to packed training sequences, as stages that each take and return a DataFrame.

language ID -> one document of each near-duplicate group -> repeated passages removed -> sources mixed
to their weights -> token ids cut into sequences.

Defined results, of every stage: an empty table gives an empty one; other columns are carried along, whatever
their names. Null and letterless texts go in the first stage. Rows without a doc_id are never taken for copies
of others. Repeated rows of a doc_id stay or go together, and are mixed and packed as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import jaccard_join, language_id, mixing, packing, substring_dedup
from paperloom.session import cut, table

#: Near-duplicates of the stage: word shingles of this length, and this similarity in percent. The query op6 has its own.
SHINGLE, PERCENT = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; the others, and texts that are null, empty or without a letter, go."""
    return language_id.of_known_language(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id, with all its rows; rows without an id and texts without words stay."""
    return jaccard_join.one_of_each(docs, shingle=SHINGLE, percent=PERCENT)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that an earlier document has are removed, and documents that lose every word go."""
    left = substring_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))
    return left.where(F.length("text") > 0).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by the size of their texts; a null source is a source of its own, and a null text has size 0."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence, with its ids; a null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [("language ID", known_language), ("n-gram Jaccard join", one_of_each_group), ("substring dedup", without_repeats), ("mixing", mixed), ("packing", packed)]

#: SQL has neither the language model nor the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
