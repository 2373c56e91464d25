"""A training corpus from raw documents: rules, language, near-duplicates, leaks, segmentation.

Every stage takes the documents its predecessor kept and returns those it keeps, with the columns
of ``documents``; the last one returns their sampled segmentations. Stages learn from their own
input. Null texts count as empty and fail the rules; an empty table stays empty. Every stage sets the
session up, so that Python workers get small batches of texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.llm import decontaminate, language_id, near_dedup, quality_rules, segmentation
from duecall.llm.queries import model_proto
from duecall.llm.shared import saved
from duecall.session import configure

LEAST_LANGUAGE_SCORE = 0.2


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the list learned from ``labels``."""
    configure(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality_rules.learn_rules(docs, labels)
    return quality_rules.judge(docs, rules).where("kept").select(*docs.columns)


def apply_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, not too far from its profile."""
    configure(spark)
    found = language_id.identify(docs, language_id.learn_profiles(docs))
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.where(known).select(*docs.columns)


def apply_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    configure(spark)
    return near_dedup.drop_near_duplicates(docs)


def apply_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    configure(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.with_leaks(docs, benchmark).where("size(leaks) = 0").select(*docs.columns)


def apply_segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, each read back once."""
    configure(spark)
    return segmentation.sample_segmentations(
        docs, model_proto(), keep=["doc_id", "lang", "source"]
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", apply_quality_rules),
    ("language_id", apply_language_id),
    ("near_dedup", apply_near_dedup),
    ("decontamination", apply_decontamination),
    ("segmentation", apply_segmentation),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs


# learned lists, profiles and drawn samples have no SQL form; tests compare with brute force
ORACLE_SQL = None
