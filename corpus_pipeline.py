"""The corpus pipeline: toxic documents go, one document of each near-copy group stays, personal data get surrogates, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filamenta.llm.common import discard, free_names, keep, table
from filamenta.llm.jaccard_join import first_of_components
from filamenta.llm.packing import pack
from filamenta.llm.queries import vocabulary_path
from filamenta.llm.surrogates import REGISTERED_KEY, key_of, replace_personal_data
from filamenta.llm.toxicity import clean_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labelled ones among them, doesn't reject."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join one row, that with the smallest doc_id, and every row that nothing links."""
    return first_of_components(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates for personal data."""
    count = free_names(docs, "n_replaced")[0]
    return replace_personal_data(docs, key_of(spark, REGISTERED_KEY), count=count).drop(count)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens."""
    return pack(docs, vocabulary_path())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]

#: A trained classifier and a tokenizer aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = keep(stage(spark, docs, sf_dir), name)
        discard(docs)  # what the stage before wrote; the documents themselves stay
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
