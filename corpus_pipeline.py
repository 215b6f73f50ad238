"""A training corpus from raw documents, in five stages.

Each stage works on all that the one before kept; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from screenguard.llm import langid, mixing, pieces, simhash, toxicity
from screenguard.llm.common import prepare, remainder, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't rejected."""
    prepare(spark)
    return langid.keep_identified(docs, langid.fit(docs, remainder("id", 3) != 1))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("id", 5) != 0)
    return toxicity.keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights ask for."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document; in smaller portions than by default, as the stages before it fill the workers' memory."""
    return pieces.encode(docs, frequent=200_000, portion=500_000).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]

#: The stages train models and link by sketches, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
