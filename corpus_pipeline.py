"""A corpus pipeline over documents: five stages, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns
of documents. run() writes each stage's result to the shared folder and reads it back as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm import decontamination, jaccard_join, language_id, packing, toxicity
from loamgraph.llm.common import materialise, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; models learn from the documents' own lang."""
    return language_id.keep_identified(docs, language_id.fit_on(docs, public_tokenizers.path("piece_bpe_32k.model")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the classifier learns from the labels of documents that are left."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.keep_clean(docs, toxicity.fit_on(docs, labels))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links at a Jaccard similarity of 0.75 on five-word shingles."""
    return jaccard_join.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, in sequences of at most 2048 tokens: a row a piece."""
    return packing.best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]

#: The stages fit models and run a tokenizer, which SQL cannot express; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
