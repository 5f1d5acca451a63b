"""From raw documents to a training mix: five stages, each over all rows its predecessor kept.

Every stage is a function of (spark, docs, folder of the given tables); its result is written as
Parquet in the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenmatch.llm.contamination import uncontaminated
from evenmatch.llm.minhash import one_of_each
from evenmatch.llm.mixing import repeated
from evenmatch.llm.pii import rewritten
from evenmatch.llm.quality import accepted
from evenmatch.llm.registry import table
from evenmatch.sources.storage import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data under pseudonyms; ``n_chars`` is counted again where text changed."""
    return rewritten(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix reads a document, with the repetition's number as ``epoch``."""
    return repeated(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii pseudonyms", pii_stage),
    ("mixing to target weights", mix_stage),
]

#: No SQL: the classifier and the signatures are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the given documents."""
    work = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for no, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"stage-{no}")
        if no:
            work.drop(f"stage-{no - 1}")
    return docs
