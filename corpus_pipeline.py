"""A training corpus from the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes it
to the shared folder and the next stage reads it.  All but the last give the
columns of documents.  A table without rows passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestor.llm import decontaminate, langid, line_dedup, packing, simhash
from attestor.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    return langid.accepted(docs, langid.trained(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that many documents share, but for one copy of each."""
    return line_dedup.cleaned(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of a test item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bin and place of every piece of every document."""
    return packing.packed_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("sequences", sequences)]

#: Language models, components and best fit are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
