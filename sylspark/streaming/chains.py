"""Structured Streaming forms: chunked encoding, transition counts, epochs, windows over events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import SYLLABLE
from ..operators.encode import LONGEST, Vocabulary


def lines(spark: SparkSession, path: str, per_batch: int = 10) -> DataFrame:
    """Lines of the files that appear in a folder; ``per_batch`` files a trigger hold back the rest."""
    return spark.readStream.option("maxFilesPerTrigger", per_batch).text(path)


def events(spark: SparkSession, path: str, schema, per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def encode_chunks(chunks: DataFrame, vocab: Vocabulary, key: str = "stream_id") -> DataFrame:
    """Ids of texts that come in chunks (``key, seq, chunk, last``): ``key, ids``, in order of ``seq``.

    The state of a stream is the syllables that a later chunk could still change: fewer than the longest token.
    ``last`` flushes it.
    """
    import re

    pattern = re.compile(SYLLABLE)

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry = state.get[0] if state.exists else ""
        out: list[int] = []
        for f in frames:
            for _, row in f.sort_values("seq").iterrows():
                text = carry + (row["chunk"] or "")
                parts = [x.lower() if re.search("[aeiouAEIOU]", x) else x for x in pattern.findall(text)]
                if row["last"]:
                    out += vocab.ltr(parts)
                    carry = ""
                    continue
                # a syllable at the end may grow, and a token may reach over LONGEST syllables
                sure = max(0, len(parts) - LONGEST - 4)
                i = 0
                while i < sure:
                    for k in range(min(vocab.longest.get(parts[i], 0), len(parts) - i), 0, -1):
                        if (found := vocab.ids.get(tuple(parts[i : i + k]))) is not None:
                            break
                    else:
                        k, found = 1, 0
                    out.append(found)
                    i += k
                carry = "".join(parts[i:])
        state.update((carry,))
        yield pd.DataFrame({key: [group[0]], "ids": [out]})

    return chunks.groupBy(key).applyInPandasWithState(run, f"{key} string, ids array<long>", "carry string", "append", GroupStateTimeout.NoTimeout)


def edge_counts(pairs: DataFrame) -> DataFrame:
    """Running ``src, dst, weight`` of a stream of pairs; write in update mode."""
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def windowed(stream: DataFrame, ts: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts by event-time window, with late data up to the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width, slide), by).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))


def epochs(stream: DataFrame, every: int, epoch: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Run ``epoch(rows, number)`` once each ``every`` rows have come in, counted over batches; the count is kept with the checkpoint by batch id."""
    seen = {"rows": 0, "epoch": 0}

    def batch(rows: DataFrame, _: int) -> None:
        seen["rows"] += rows.count()
        if seen["rows"] // every > seen["epoch"]:
            seen["epoch"] = seen["rows"] // every
            epoch(rows, seen["epoch"])

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
