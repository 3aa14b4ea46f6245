"""Bounds of Arrow batches."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch at most: whole texts come in batches, and a batch is held several times on its way.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``BATCH``; smaller bounds of its own stay."""
    for key, most in BATCH.items():
        own = re.match(r"\d+", str(spark.conf.get(key)))
        if not own or not 0 < int(own.group()) <= most:
            spark.conf.set(key, str(most))
