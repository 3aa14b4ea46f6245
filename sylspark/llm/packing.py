"""Best-fit packing by minimum bin slack.

The exact multiset of piece lengths is a histogram of at most ``seq_len`` entries, whatever the corpus holds.
Minimum bin slack runs over that histogram on the driver: with the longest length left as seed, a bitset
subset-sum dynamic program over the available lengths finds the fullest feasible combination, which is removed
as often as the counts allow. The result is a list of patterns; each piece finds its sequence and offset by its
rank among the pieces of its length, so the corpus itself never leaves the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import chunks, encoder
from .common import materialise, small_batches, strings, turn

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one length that one window group ranks.
RANK_ROWS = 20_000


def fullest(counts: dict[int, int], seed: int, room: int) -> dict[int, int]:
    """The multiset that holds ``seed`` and fills ``room`` as far as ``counts`` can; longer lengths first on ties."""
    left = room - seed
    steps: list[tuple[int, int, int]] = []
    reach, full, mask = 1, 1 << left, (1 << (left + 1)) - 1
    for length in sorted((x for x in counts if x <= left), reverse=True):
        free = min(counts[length] - (length == seed), left // length)
        k = 1
        while free > 0 and not reach & full:
            n = min(k, free)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            free, k = free - n, 2 * k
        if reach & full:
            break
    at, found = reach.bit_length() - 1, {seed: 1}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            at -= length * n
            found[length] = found.get(length, 0) + n
    return found


def plan(histogram: dict[int, int], seq_len: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, bins) in order; every piece of the histogram is in exactly one bin."""
    counts = {x: n for x, n in histogram.items() if n > 0}
    out = []
    while counts:
        pattern = fullest(counts, max(counts), seq_len)
        times = min(counts[x] // n for x, n in pattern.items())
        out.append((pattern, times))
        for x, n in pattern.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return out


def segments(patterns: list[tuple[dict[int, int], int]]) -> dict[int, list[np.ndarray]]:
    """By length: first rank, copies a bin, first sequence and first offset of each pattern that holds it."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for x in sorted(pattern, reverse=True):
            rows.setdefault(x, []).append((ranks.get(x, 0), pattern[x], sequence, offset))
            ranks[x] = ranks.get(x, 0) + pattern[x] * times
            offset += x * pattern[x]
        sequence += times
    return {x: [np.array(c, np.int64) for c in zip(*r)] for x, r in rows.items()}


def cut(ids: bytes, seq_len: int) -> Iterable[tuple[int, int]]:
    """(start, length) of the pieces, in ids; the first may be shorter, the others are full."""
    n = len(ids) // 4
    if n <= seq_len:
        return [(0, n)]
    first = n % seq_len or seq_len
    return [(0, first), *((s, seq_len) for s in range(first, n, seq_len))]


def pieces(docs: DataFrame, seq_len: int = 1024, tokenizer: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: ``PIECES``, and ``ids`` (array of int) if asked for."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc = encoder(tokenizer)
        turn("packing", enc.words, enc.tokens)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), strings(batch.column(1))
            rows: list[list] = [[], [], [], [], [], []]
            for at, some in chunks(texts, 4_000_000):
                for i, ids in enumerate(enc.encode_batch(some)):
                    ids += end
                    for k, (start, length) in enumerate(cut(ids, seq_len)):
                        own = ids[4 * start : 4 * (start + length)]
                        for column, v in zip(rows, (doc_ids[at + i], k, start, length, zlib.crc32(own))):
                            column.append(v)
                        if with_ids:
                            rows[5].append(np.frombuffer(own, np.uint32).astype(np.int32))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def pack(found: DataFrame, seq_len: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have ``doc_id, piece, start, length, ids_crc32``.

    ``found`` must be a written table: it is read for the histogram, for the counts behind the ranks and for
    the result. Ranks are made in two steps, counts by (length, bucket) and row numbers inside a bucket, so a
    length that a third of the pieces have isn't sorted in one task.
    """
    histogram = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # seq_len rows at most
    if any(x > seq_len for x in histogram):
        raise ValueError(f"a piece is longer than {seq_len}")
    table = segments(plan(histogram, seq_len))
    buckets = max(1, -(-max(histogram.values(), default=0) // RANK_ROWS))
    given = found.withColumn("_h", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    first = given.groupBy("length", "_h").count().select("length", "_h", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    order = Window.partitionBy("length", "_h").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = given.withColumn("_n", F.row_number().over(order) - 1).join(first, ["length", "_h"]).withColumn("_rank", F.col("_first") + F.col("_n"))
    shared = found.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        ls, rs = length.to_numpy(), rank.to_numpy()
        seq, off = np.empty(len(ls), np.int64), np.empty(len(ls), np.int64)
        for x in np.unique(ls):
            own = ls == x
            starts, copies, first_seq, first_off = shared.value[int(x)]
            k = np.searchsorted(starts, rs[own], "right") - 1
            inside = rs[own] - starts[k]
            seq[own] = first_seq[k] + inside // copies[k]
            off[own] = first_off[k] + inside % copies[k] * x
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("_p", place("length", "_rank")).select(*found.columns, "_p.sequence_id", "_p.offset")


def pack_documents(docs: DataFrame, seq_len: int = 1024, tokenizer: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into as few sequences of at most ``seq_len`` ids as minimum bin slack finds.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``). Null and
    empty texts are a piece of the end id alone; repeated rows are pieces of their own; a null ``doc_id`` stays
    null; an empty table gives no rows; other columns are not read.
    """
    return pack(materialise(pieces(docs, seq_len, tokenizer, end_id, with_ids), "pieces"), seq_len)
