"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counts, jaccard, neardup, neighbours, packing, pieces, secrets, toxicity, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    return pieces.encode(_table(spark, sf_dir, "documents"), check=True)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op5_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit of all pages against a replica with planted damage: some pages altered, some lost."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    damaged = pages.where("page_id % 211 <> 5").withColumn("html", F.when(F.col("page_id") % 97 == 3, F.concat(F.lit("?"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    return warc.fixity(warc.records(pages), warc.records(damaged))


def op8_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text before and after three edits."""
    docs = _table(spark, sf_dir, "documents")
    return counts.count_edited(docs.select("doc_id", "text", counts.edits_of(F.col("text")).alias("edits")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


WARC_SQL = """
WITH r AS (
  SELECT page_id, page_id // 1024 AS segment,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
      || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS x,
    CASE WHEN page_id % 211 = 5 THEN 'missing' WHEN page_id % 97 = 3 AND html IS NOT NULL AND substr(html, 1, 1) <> '?' THEN 'corrupt' ELSE 'ok' END AS status
  FROM pages
)
SELECT page_id, segment,
  CAST(coalesce(sum(strlen(x)) OVER (PARTITION BY segment ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset,
  CAST(strlen(x) AS BIGINT) AS length, sha256(x) AS leaf, status
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_warc_fixity": WARC_SQL}
