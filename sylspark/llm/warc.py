"""WARC records, files of them, and Merkle fixity audits of replicas.

Records lie in segments (a file each) of consecutive ids. Leaves hash records, nodes hash the ordered leaves or
nodes below with their ranges, up to one root. Replicas are compared from the root down; only children of nodes that
differ are looked at, so what an audit compares follows the damage.
"""

from __future__ import annotations

import gzip
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Ids of a segment, and children of a node.
SEGMENT, FANOUT = 1024, 64
EOL = "\r\n"


def record(url: Column, payload: Column, kind: str = "response") -> Column:
    """Text of one WARC/1.0 record; null parts as empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.0{EOL}WARC-Type: {kind}{EOL}WARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"{EOL}Content-Type: text/html{EOL}Content-Length: "), F.octet_length(body).cast("string"), F.lit(EOL + EOL)
    )
    return F.concat(head, body, F.lit(EOL + EOL))


def records(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``page_id, segment, length, leaf`` (SHA-256 of the record); null ids are left in segment null."""
    x = record(F.col("url"), F.col("html"))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), x.alias("x"))
    return given.select("page_id", F.floor(F.col("page_id") / segment).cast("long").alias("segment"), F.octet_length("x").cast("long").alias("length"), F.sha2("x", 256).alias("leaf"))


def leaves(found: DataFrame) -> DataFrame:
    """One leaf an id: of repeated rows, the hashes in order as one."""
    return found.groupBy("page_id").agg(F.min("segment").alias("segment"), F.sum("length").alias("length"), F.array_join(F.array_sort(F.collect_list("leaf")), "").alias("leaf"))


def levels(found: DataFrame, fanout: int = FANOUT, depth: int | None = None) -> list[DataFrame]:
    """Tables ``node, length, hash`` from the leaves up to a single node, each node over ``fanout`` ids or nodes in order.

    A parent's hash covers its children's numbers, lengths and hashes. Every level is one aggregation; a group
    has ``fanout`` rows at most.
    """
    at = materialise(leaves(found.where("page_id is not null")).select(F.col("page_id").alias("node"), "length", F.sha2(F.col("leaf"), 256).alias("hash")), "level")
    out = [at]
    if depth is None:
        top = found.agg(F.max("page_id")).first()[0] or 0
        depth = 1
        while fanout**depth <= top:
            depth += 1
    for _ in range(depth):
        row = F.struct("node", "length", "hash")
        given = at.groupBy(F.floor(F.col("node") / fanout).cast("long").alias("up")).agg(F.sort_array(F.collect_list(row)).alias("rows"), F.sum("length").alias("length"))
        joined = F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["node"].cast("string"), r["length"].cast("string"), r["hash"])), ",")
        at = materialise(given.select(F.col("up").alias("node"), "length", F.sha2(joined, 256).alias("hash")), "level")
        out.append(at)
    return out


def audit(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``page_id, status`` of the leaves that differ: ``corrupt``, ``missing`` (in b) or ``added`` (in b only).

    ``a`` and ``b`` are ``records`` tables, each read once for its leaves. From the root down, a level is joined only with the children of the
    nodes that differ one level up.
    """
    b = materialise(b, "records")
    top = max(x.agg(F.max("page_id")).first()[0] or 0 for x in (a, b))
    depth = 1
    while fanout**depth <= top:
        depth += 1
    bad = None
    for x, y in reversed(list(zip(levels(a, fanout, depth), levels(b, fanout, depth)))):
        if bad is not None:
            parent = bad.select(F.col("node").alias("up"))
            x, y = (t.withColumn("up", F.floor(F.col("node") / fanout).cast("long")).join(parent, "up", "left_semi").drop("up") for t in (x, y))
        met = x.alias("x").join(y.alias("y"), "node", "full")
        differ = met.where("not (x.hash <=> y.hash and x.length <=> y.length)").select("node", F.when(F.col("x.hash").isNull(), "added").when(F.col("y.hash").isNull(), "missing").otherwise("corrupt").alias("status"))
        bad = materialise(differ, "differ")
    return bad.select(F.col("node").alias("page_id"), "status")


def fixity(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Every record of ``a`` with its place in its segment, its hash, and what the audit against ``b`` found.

    ``page_id, segment, record_offset, length, leaf, status``; the status is ``ok`` for records that agree.
    Repeated rows share a status; null ids are in no tree: status ``unnumbered``; an empty table gives no rows.
    """
    from pyspark.sql import Window

    a = materialise(a, "records")  # hashes in place of pages
    before = Window.partitionBy("segment").orderBy("page_id", "leaf").rowsBetween(Window.unboundedPreceding, -1)
    placed = a.withColumn("record_offset", F.when(F.col("page_id").isNotNull(), F.coalesce(F.sum("length").over(before), F.lit(0))))
    found = audit(a, b, fanout).where("status <> 'added'")
    status = F.when(F.col("page_id").isNull(), "unnumbered").otherwise(F.coalesce("status", F.lit("ok")))
    return placed.join(found, "page_id", "left").select("page_id", "segment", "record_offset", "length", "leaf", status.alias("status"))


def write_warc(pages: DataFrame, path: str, segment: int = SEGMENT) -> DataFrame:
    """Write gzip members, one a record, in one file a segment under ``path`` (a folder that executors share); ``file, records``.

    Rows of a segment are sorted by id and streamed, so a file is never held whole.
    """
    given = pages.where("page_id is not null").select(F.floor(F.col("page_id") / segment).cast("long").alias("segment"), "page_id", record(F.col("url"), F.col("html")).alias("x"))
    root = path.removeprefix("file://")

    def run(batches):
        import os

        os.makedirs(root, exist_ok=True)
        now, out, n, done = None, None, 0, []
        for batch in batches:
            for s, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if s != now:
                    if out:
                        out.close(), os.replace(name + ".part", name), done.append((name, n))
                    now, n, name = s, 0, f"{root}/{s:08d}.warc.gz"
                    out = open(name + ".part", "wb")
                out.write(gzip.compress(x.encode(), 6, mtime=0))
                n += 1
        if out:
            out.close(), os.replace(name + ".part", name), done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["file", "records"])

    return given.repartition("segment").sortWithinPartitions("segment", "page_id").mapInArrow(run, "file string, records long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``file, record_offset, length, url, payload`` of the records of gzipped or plain WARC files; offsets in the unpacked file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    head = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                rows, at = [], 0
                while m := head.match(raw, at):
                    fields = dict(x.split(b": ", 1) for x in m.group(1).split(b"\r\n") if b": " in x)
                    end = m.end() + int(fields.get(b"Content-Length", b"0"))
                    rows.append((name, at, end + 4 - at, fields.get(b"WARC-Target-URI", b"").decode(errors="replace"), raw[m.end() : end].decode(errors="replace")))
                    at = end + 4
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["file", "record_offset", "length", "url", "payload"])

    return files.mapInArrow(run, "file string, record_offset long, length long, url string, payload string")
