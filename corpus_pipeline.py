"""From raw documents to packed training sequences: five stages, each one operator of ``tallyframe.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of ``docs``. Each result is written as Parquet and read again before the next stage, so a lost executor costs
at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import language, mixing, neardup, packing, quality
from tallyframe.llm.common import documents, fold, labels, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of three in four documents."""
    trees = quality.fit_quality(docs, labels(spark, sf_dir), fold("doc_id", 4) != 2)
    return quality.accepted(docs, trees)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the kernel machine knows; those without letters go."""
    return language.accepted(docs, language.fit_language(docs, fold("doc_id", 4) != 2))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    return neardup.deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target weights of sources, languages and topics."""
    return mixing.sampled(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language id", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

# Learned models, signatures and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
