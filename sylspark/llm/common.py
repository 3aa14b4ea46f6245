"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import BATCH, small_batches  # noqa: F401

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and the session is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="sylspark-")
    return "file://" + _OWN_DIR[app]


#: Whether shuffle files go when their query has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage and survives a lost executor.

    The shuffle files of the write go when it has ended: its result is a written table, and nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)



_TURN: list = [None, ()]


def turn(operator: str, *caches: dict) -> None:
    """Called in a worker as a task of ``operator`` begins: the caches of another that ran before go, and free memory goes back.

    Workers outlive stages; what one operator remembers is of no use to the next, and counts against its executor.
    """
    if _TURN[0] not in (None, operator):
        for x in _TURN[1]:
            x.clear()
    _TURN[:] = operator, caches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):  # another C library than glibc
        pass


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def contracted(edges: DataFrame) -> DataFrame:
    """Replace the edges of each partition by a spanning forest of them (smallest node as root)."""

    def run(batches):
        roots: dict = {}

        def find(x):
            while (up := roots.get(x, x)) != x:
                roots[x] = roots.get(up, up)
                x = up
            return x

        def flush():
            pairs = [(x, find(x)) for x in roots]
            pairs = [p for p in pairs if p[0] != p[1]]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], type_), pa.array([p[1] for p in pairs], type_)], ["a", "b"])

        type_ = None
        for batch in batches:
            type_ = batch.schema.field(0).type
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                roots.setdefault(x, x)
                roots.setdefault(y, y)
                x, y = find(x), find(y)
                if x != y:
                    roots[max(x, y)] = min(x, y)
            if len(roots) > 500_000:
                yield flush()
                roots.clear()
        if roots:
            yield flush()

    return edges.select("a", "b").mapInArrow(run, edges.select("a", "b").schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Alternating large-star and small-star steps over DataFrames, each round written to the shared folder.
    Every round first contracts the edges of a partition to a spanning forest, so cliques shrink at once.
    """
    kind = edges.schema["a"].dataType
    edges = materialise(contracted(edges.select("a", "b").where("a is not null and b is not null and a <> b")), "edges")
    last = None
    while True:  # every round but the last lowers some label, so it ends
        # large star: every node's larger neighbours point at its smallest neighbour (itself included)
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every node's smaller neighbours and itself point at its smallest neighbour
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = materialise(small, "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if now == last:
            break
        last = now
    star = edges.groupBy("a").agg(F.min("b").alias("b"))
    nodes = star.select(F.col("a").cast(kind).alias("node"), F.col("b").alias("component"))
    return nodes.union(star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of unsigned integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
