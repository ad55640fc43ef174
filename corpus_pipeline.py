"""A corpus pipeline of five stages over documents, each written as Parquet and read again.

Toxic documents go, later matches of lines go, one document of each near-duplicate group stays, documents with benchmark
passages go, and what is left is segmented. Each stage works on all that the one before kept.

Defined cases: a null or empty text is kept by every stage but near dedup, where all texts without words are copies of each other; rows that share a doc_id stay or go
together there; rows with a null doc_id stay; every stage of an empty table gives an empty one; further columns are kept, whatever their names, but by the last stage, which returns its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import read, shared_dir
from tracelake.llm.decontamination import decontaminate
from tracelake.llm.fitting import fold
from tracelake.llm.lines import dedup_lines
from tracelake.llm.near import keep_first
from tracelake.llm.segment import segmented
from tracelake.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. Labels are learned from the folds that op8 learns from."""
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    score = max(docs.columns, key=len) + "_score"  # a name that no column has
    return score_toxicity(docs, fit_toxicity(docs, labels), out=score).where(F.col(score) < 0.5).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later matches of a line leave the text, also of lines of one or two words; every document stays. n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays. 0.8 of the 5-word shingles in common or 4 bits of op4 apart link."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document: piece ids, log-probabilities and inclusion scores."""
    return segmented(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("segmentation", segmentation)]

#: The classifier, the fingerprints and the sampling are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
