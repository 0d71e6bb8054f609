"""The training-data pipeline: rules, classifier, near duplicates, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all that the one before it kept, and is written
as Parquet before the next reads it. Stages read ``doc_id``, ``text`` and ``source`` and return the columns of ``documents``; other
columns, whatever their names, are left out. Nulls, empty texts and repeated rows are as each stage says; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from netloom.llm import mixing, ngram_join, packing, pu_quality, quality_rules
from netloom.llm._store import discard, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts have no words and go."""
    return quality_rules.kept_rows(docs).select(*COLUMNS)


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives 0.3 or more; rows with a null id are scored like others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return pu_quality.keep_good(docs, labels).select(*COLUMNS)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of least id, then of least text hash."""
    return ngram_join.keep_one_of_each_class(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says, perhaps not at all; copies are equal rows. A null source is a source of its own."""
    return mixing.mix_sources(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in their sequences; ``row_id`` tells the copies of one document apart."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_classifier),
    ("ngram_jaccard_join", keep_one_copy),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: The classifier and the tokenizer have no SQL. The first, third and fourth stage have theirs as queries of their own; the tests
#: run the pipeline against its operators one by one and put its sequences together again.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them tables in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
