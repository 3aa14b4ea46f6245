"""Embedding near duplicates by a random-projection tree forest.

Trees are fitted on a bounded sample: each node splits at the median of a random projection, and vectors near
the split go to both sides (spill). Leaves hold a bounded share of the sample; leaves that the whole table
overfills are split further, by trees of their own, inside the task that compares them. All pairs of a leaf are
compared exactly in blocks, links verified in double precision are counted once, and components are their union.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise
from .vectors import fitted, matrix, valid

SAMPLE = 50_000
#: Sample vectors and all vectors of a leaf, trees, and rows that are multiplied at once.
LEAF, FULL, TREES, ROWS = 64, 4096, 6, 512
#: Half the width of the band that goes to both sides, in distances of just linked vectors over sqrt(dimensions).
SPILL = 0.5


class Tree:
    """``nodes``: direction, threshold, children; a negative child is a leaf."""

    def __init__(self, x: np.ndarray, leaf: int, margin: float, rng: np.random.Generator):
        self.directions, self.at, self.down = [], [], []
        self.leaves, self.margin = 0, margin
        self.root = self._grow(x, leaf, rng)
        self.directions = np.array(self.directions).reshape(len(self.at), x.shape[1])

    def _grow(self, x, leaf, rng) -> int:
        if len(x) > leaf:
            d = rng.standard_normal(x.shape[1])
            d /= np.sqrt((d**2).sum())
            p = x @ d
            t = float(np.median(p))
            low, high = p <= t + self.margin, p > t - self.margin
            if max(low.sum(), high.sum()) < 0.9 * len(x):
                k = len(self.at)
                self.directions.append(d), self.at.append(t), self.down.append([0, 0])
                self.down[k] = [self._grow(x[low], leaf, rng), self._grow(x[high], leaf, rng)]
                return k
        self.leaves += 1
        return -self.leaves

    def leaves_of(self, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows) of the rows of ``x``; a row can be in several."""
        out, todo = [], [(self.root, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            if not len(rows):
                continue
            if k < 0:
                out.append((-k, rows))
                continue
            p = x[rows] @ self.directions[k]
            todo += [(self.down[k][0], rows[p <= self.at[k] + self.margin]), (self.down[k][1], rows[p > self.at[k] - self.margin])]
        return out


def _links(x: np.ndarray, ids: np.ndarray, least: float, rng, depth: int = 0):
    """(i, j) of linked rows of a leaf; an overfull one is split by trees of its own, and compared whole if that fails."""
    if len(x) > FULL and depth < 12:
        margin = SPILL * np.sqrt(2 * (1 - least) / x.shape[1])
        trees = [Tree(x, FULL // 2, margin, rng) for _ in range(3)]
        if all(t.leaves > 1 for t in trees):
            for t in trees:
                for _, rows in t.leaves_of(x):
                    for i, j in _links(x[rows], ids[rows], least, rng, depth + 1):
                        yield rows[i], rows[j]
            return
    y = x.astype(np.float32)
    for a in range(0, len(x), ROWS):
        for b in range(a, len(x), ROWS):
            i, j = np.nonzero(y[a : a + ROWS] @ y[b : b + ROWS].T >= least - 1e-4)
            i, j = i + a, j + b
            own = i < j
            i, j = i[own], j[own]
            if len(i):
                own = np.einsum("ij,ij->i", x[i], x[j]) >= least
                if own.any():
                    yield i[own], j[own]


def near_duplicates(table: DataFrame, least: float = 0.93, trees: int = TREES) -> DataFrame:
    """Link rows of ``table(vec_id, embedding, label)`` of equal label whose cosine is ``least`` or more.

    One row per vector: ``vec_id, n_links`` (other rows linked directly), ``component_id`` (the smallest id
    reachable) and ``kept``. Null, zero and non-finite vectors, null labels and null ids link with nothing (a null
    id is kept, its component null); equal vectors of a label are one class while comparing; repeated rows are
    rows that link with one another; an empty table gives no rows; other columns are not read.
    """
    spark = table.sparkSession
    usable = materialise(valid(table, ["label"]).where("vec_id is not null and label is not null"), "vectors")
    classes = materialise(usable.groupBy("label", "v").agg(F.min("vec_id").alias("c"), F.count("*").alias("copies")), "classes")
    x = fitted(classes, SAMPLE)
    x = x / np.sqrt((x**2).sum(1))[:, None] if len(x) else np.zeros((1, 1))
    margin = SPILL * np.sqrt(2 * (1 - least) / x.shape[1])
    rng = np.random.default_rng(11)
    forest = spark.sparkContext.broadcast([Tree(x, LEAF, margin, rng) for _ in range(trees)])  # SAMPLE / LEAF directions a tree, times what spills

    def scatter(batches):
        for batch in batches:
            y = matrix(batch.column(2).to_pylist())
            y = y / np.sqrt((y**2).sum(1))[:, None]
            for k, tree in enumerate(forest.value):
                for leaf, rows in tree.leaves_of(y):
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), pa.array(np.full(len(rows), leaf, np.int32)), *(batch.column(c).take(at) for c in (0, 1, 2))], ["tree", "leaf", "label", "c", "v"])

    def compare(batches):
        now, ids, rows = None, [], []

        def flush():
            y = matrix(rows)
            y = y / np.sqrt((y**2).sum(1))[:, None]
            own = np.array(ids, np.int64)
            seed = np.random.default_rng(abs(hash(now)) % 2**32)
            found = [own[np.stack(p)] for p in _links(y, own, least, seed)]
            pairs = np.unique(np.sort(np.concatenate(found, 1), 0), axis=1) if found else np.empty((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            for key in zip(*(batch.column(j).to_pylist() for j in range(5))):
                if key[:3] != now:
                    if len(ids) > 1:
                        yield flush()
                    now, ids, rows = key[:3], [], []
                ids.append(key[3]), rows.append(key[4])
        if len(ids) > 1:
            yield flush()

    kind = classes.schema["label"].dataType.simpleString()
    spread = classes.select("label", "c", "v").mapInArrow(scatter, f"tree int, leaf int, label {kind}, c long, v binary")
    met = spread.repartition("tree", "leaf", "label").sortWithinPartitions("tree", "leaf", "label")
    links = materialise(met.mapInArrow(compare, "a long, b long").distinct(), "links")
    members = usable.select("vec_id", "label", "v")
    # a class goes by its smallest id; ids are unique but for repeated rows, whose classes share the id and a component
    counts = classes.groupBy("c").agg(F.sum("copies").alias("copies"))
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    added = both.join(counts.withColumnRenamed("c", "b"), "b").groupBy("a").agg(F.sum("copies").alias("add"))
    parts = connected_components(links)
    known = classes.join(added, F.col("c") == F.col("a"), "left").join(parts, F.col("c") == F.col("node"), "left")
    known = known.select("label", "v", (F.col("copies") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("component_id"))
    found = members.join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = valid_not(table)
    out = found.union(rest.select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def valid_not(table: DataFrame) -> DataFrame:
    """The rows that take no part in linking."""
    x = F.col("embedding")
    bad = x.isNull() | (F.size(x) == 0) | F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) | ~F.exists(x, lambda e: e != 0)
    return table.where(F.coalesce(bad, F.lit(True)) | F.col("vec_id").isNull() | F.col("label").isNull()).select(F.col("vec_id").cast("long").alias("vec_id"))
