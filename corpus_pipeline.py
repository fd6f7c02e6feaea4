"""A training-corpus pipeline over `documents`: quality, near copies, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; all but the
last return the columns of documents. `run` writes each stage to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, packing, quality, simhash, substring_dedup
from tessella.llm.common import kept, table, unused

PASSAGE_WORDS = 50


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of score 0.5 or more."""
    model = quality.fit(docs, quality.learnable(table(spark, sf_dir, "labels")))
    name = unused(docs, "score")
    return quality.score(docs, model, name).where(F.col(name) >= 0.5).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, of the smallest doc_id, of every group of exact and near copies (five words, similarity 0.8)."""
    return simhash.without_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of PASSAGE_WORDS words or more that an earlier document holds as well."""
    removed = unused(docs, "n_removed")
    out = substring_dedup.substring_dedup(docs, window=PASSAGE_WORDS, shortest=13, count=removed)
    n = F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; one row per piece."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier, the fingerprints or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
