"""From raw documents to packed training bins, stage by stage.

Every stage takes the documents its predecessor kept and, but for the last, returns rows
with the same columns. A stage learns from the label table where it learns at all.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fanweave.llm.exact_dedup import drop_exact_duplicates, normalised  # noqa: E402
from fanweave.llm.labels import in_fold  # noqa: E402
from fanweave.llm.mixing import clean_ids, fit_domains, resample  # noqa: E402
from fanweave.llm.near_dedup import drop_near_duplicates  # noqa: E402
from fanweave.llm.packing import best_fit, word_count  # noqa: E402
from fanweave.llm.quality import ACCEPT, fit_quality, score_quality  # noqa: E402
from fanweave.llm.registry import query, table  # noqa: E402
from fanweave.llm.rows import fresh  # noqa: E402
from fanweave.session import stage  # noqa: E402

#: least similarity of near-duplicates; ``op6_near_dedup`` has its own
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~in_fold("doc_id", 5, 0))
    score = fresh("quality_score", docs.columns)
    accepted = score_quality(docs, model, "text", score).filter(F.col(score) >= ACCEPT)
    return accepted.select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, from a similarity of 0.8 on."""
    return drop_near_duplicates(docs, percent=NEAR_PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the domains' expected tokens meet the targets.

    Clean documents, labelled or recognised, are never left out.
    """
    labels = table(spark, sf_dir, "labels")
    return resample(docs, fit_domains(docs, labels), clean=clean_ids(labels))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a bin of 2048 words.

    Copies that mixing made have equal texts, so they never share a bin.
    """
    return best_fit(docs, word_count("text"), F.col("source"), F.xxhash64(normalised("text")))


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: classifiers and packing have no SQL form
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
