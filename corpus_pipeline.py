"""The corpus pipeline: documents through five stages, each written as Parquet before the next reads it.

Every stage works on all that the stage before it kept; all but the last return the columns of ``documents``.

Defined cases, each by its stage's operator. Null, empty and blank texts, and texts without a letter, are rejected by the first two stages. A null id, language or source is a value like any
other; rows with a null id are no one's near duplicates. Rows that repeat an id stay or go alike, so they also are drawn and encoded alike; ties between near duplicates go to the smallest id. Very long texts
are read to their end by every stage. Extra columns, whatever their names, pass all stages but the last. Empty tables, of documents or labels, give no rows or no rules. Each stage's table is deleted once the next is written; the last one stays,
as it is what :func:`run` returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm.common import dropped, stored
from lakeloom.llm.language_id import fit, identify
from lakeloom.llm.mixing import mixed
from lakeloom.llm.near_duplicates import deduplicated
from lakeloom.llm.quality_rules import quality_filter
from lakeloom.llm.sentence_pieces import encoded


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what certified quality rules reject."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop letterless texts and those whose language contradicts the declared one."""
    return identify(docs, fit(docs), keep_all=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group that the n-gram Jaccard join connects."""
    return deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents to the target weights; a document drawn twice is two rows."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what was drawn; decoding is verified row by row."""
    return encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", mixture),
    ("sentence_pieces", tokens),
]

#: The kernel classifier, the flow and the transducer can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)  # read by this stage alone
        before = docs
    return docs
