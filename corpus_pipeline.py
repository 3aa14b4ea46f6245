"""A corpus pipeline over the training-data operators.

Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables as the operator it calls
states; columns other than ``COLUMNS`` are left out by the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylspark.llm import jaccard, packing, secrets, toxicity
from sylspark.llm.common import materialise


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts score the bias, repeated rows stay or go together."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.rejected(docs.select(*COLUMNS), model)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays (one with an id before one without).

    Null, empty and blank texts all stay; of repeated rows one stays.
    """
    return jaccard.one_of_each(docs.select(*COLUMNS))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, null and empty texts as they are, and repeated rows."""
    return secrets.redacted(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 1024; null and empty texts are the end id alone, longer ones are cut."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxicity_stage), ("ngram_jaccard_join", jaccard_stage), ("secret_scan", secret_stage), ("best_fit_packing", packing_stage)]

#: Neither a trained classifier nor bin packing is a SQL query.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
