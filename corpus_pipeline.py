"""Corpus pipeline: documents through the stages below, each written as Parquet and read again by the next.

Every stage reads whole texts, however long, and passes on other columns whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.llm.common import written
from faultloom.llm.decontaminate import drop_contaminated
from faultloom.llm.exact_dedup import drop_exact_duplicates
from faultloom.llm.labelled import fold
from faultloom.llm.mixing import mix
from faultloom.llm.near_dedup import drop_near_duplicates
from faultloom.llm.quality_knn import quality_scores


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more stay; labels of a fifth of the identifiers are not learnt from.

    NULL and empty texts are scored as empty; rows that repeat stay or go together. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_scores(docs, labels, fold("doc_id", 5) != 0, keep=docs.columns)
    return scored.where(F.col(scored.columns[-1]) >= 0.3).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest identifier stays; NULL counts as empty. Of rows that repeat
    identifier and text one stays; a row without identifier only if its text has no other."""
    return drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8), the smallest identifier stays.

    Texts without words and rows without identifier stay. Rows that share an identifier stay or go together.
    """
    return drop_near_duplicates(docs, n=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go; NULL and empty texts stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, each with how many times it is repeated.

    A NULL source is a source of its own, a NULL text has no words. Columns of the documents that are named
    like one of the mix keep their name; that of the mix becomes mix_<name>.
    """
    extra = [c for c in docs.columns if c != "doc_id"]
    return mix(docs, extra=extra).where(F.col("mix_repeats" if "repeats" in extra else "repeats") > 0)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can express neither the classifier nor the alignment; tests/llm holds every stage against brute force or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
