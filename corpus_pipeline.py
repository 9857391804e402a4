"""Documents to training mix: five stages, each written as Parquet and read again by the next.

1. quality: documents that the classifier rejects go.
2. near_duplicates: one document of each group of the n-gram Jaccard join stays, that with the least id.
3. decontamination: documents with a word inside a benchmark window go.
4. pii: personal data is replaced by its kind in brackets; n_chars follows.
5. mixing: documents that the mix takes, with how often (copies) and the words taken.

Stages 1 to 4 return the columns of ``documents``, whatever those are; each handles nulls, empty and
very long texts, repeated rows and empty tables as its operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, mixing, pii, quality
from tidemark.llm.common import discard, materialize, read_table, temporary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_pii(docs, length="n_chars" if "n_chars" in docs.columns else None)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).where(F.col("copies") > 0)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: No SQL expresses the trained classifiers; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What a stage stored on its way, and the table before it, go once its result is stored."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with temporary(spark) as made:
            docs = materialize(stage(spark, before, sf_dir), f"stage-{name}")
            made.remove(docs.stored_at)
        if hasattr(before, "stored_at"):
            discard(before)
    return docs
