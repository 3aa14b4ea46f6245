"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are hashed by floor((a x + b) / w) for Gaussian a, in a few tables of several functions each. A query
visits perturbed buckets in the order of their estimated success probability until these add up to ``success``;
the candidates of all tables are merged and reranked by the exact inner product. For the inner product, vectors
get a component that makes their norms equal. How near neighbours are (what the estimate needs) is measured on a
bounded sample for a first pass; in a second, each query probes for its own k-th score found, if that is farther,
and where it found fewer than k, everywhere. Every vector is indexed, and buckets have no cap: crowded ones are split over several regions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64
from .vectors import fitted, matrix, valid

#: Vectors that the index is fitted on.
SAMPLE = 5000
#: Vectors of one region, and queries that a region's task compares at once.
REGION, QUERIES = 20_000, 256
TABLES, WIDTH, SUCCESS = 2, 3.0, 0.80


class Index:
    """Hash functions, and the estimate of where a query's neighbours are."""

    def __init__(self, x: np.ndarray, n: int, k: int, tables: int = TABLES, width: float = WIDTH, success: float = SUCCESS, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        self.norm = float(np.sqrt((x**2).sum(1)).max()) if len(x) else 1.0
        self.bits = max(4, min(24, round(math.log2(max(2, n) / 48))))
        self.width, self.success, self.tables = width, success, tables
        self.a = [rng.standard_normal((d + 1, self.bits)) for _ in range(tables)]
        self.b = [rng.uniform(0, width, self.bits) for _ in range(tables)]
        self.near = self._near(x, n, k)

    def _near(self, x: np.ndarray, n: int, k: int) -> float:
        """Cosine that most of the sample's k-th neighbours reach; a sample has them farther off, so it errs to more probes."""
        if len(x) < 3:
            return 0.0
        q = x[: min(200, len(x))]
        s = self.query(q) @ self.unit(x).T
        s[np.arange(len(q)), np.arange(len(q))] = -1
        k = max(1, min(len(x) - 1, round(k * len(x) / n)))
        return float(np.clip(np.quantile(-np.partition(-s, k - 1, axis=1)[:, k - 1], 0.25), 0.05, 0.98))

    def unit(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that makes norms equal, of norm 1; longer ones than the sample's longest are scaled alone."""
        rest = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1), 0))
        y = np.concatenate([x, rest[:, None]], 1)
        return y / np.maximum(np.sqrt((y**2).sum(1)), 1e-300)[:, None]

    def query(self, x: np.ndarray) -> np.ndarray:
        y = np.concatenate([x, np.zeros((len(x), 1))], 1)
        return y / np.maximum(np.sqrt((y**2).sum(1)), 1e-300)[:, None]

    def code(self, table: int, cells: np.ndarray) -> np.ndarray:
        """One 64-bit code of a row of cells."""
        out = np.full(len(cells), table + 1, np.uint64)
        for c in cells.T:
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.int64).view(np.uint64))
        return out

    def codes(self, table: int, x: np.ndarray) -> np.ndarray:
        return self.code(table, np.floor((self.unit(x) @ self.a[table] + self.b[table]) / self.width))

    def probes(self, table: int, q: np.ndarray, near: float | None = None) -> np.ndarray:
        """Codes of the buckets that hold a neighbour of the unit query, at the cosine ``near``, with the given total probability, likeliest first."""
        near = self.near if near is None else near
        c = q @ self.a[table]
        spread = math.sqrt(1 - near**2)
        cells, p = np.zeros((1, 0)), np.ones(1)
        for k in range(self.bits):
            centre = near * c[k] + self.b[table][k]
            lo = math.floor((centre - 3.5 * spread) / self.width)
            hi = math.floor((centre + 3.5 * spread) / self.width)
            edges = [0.5 * (1 + math.erf((e * self.width - centre) / spread / 2**0.5)) for e in range(lo, hi + 2)]
            own = np.diff(edges)
            p = (p[:, None] * own[None, :]).ravel()
            cells = np.concatenate([np.repeat(cells, len(own), 0), np.tile(np.arange(lo, hi + 1), len(cells))[:, None]], 1)
            if len(p) > 4096:  # partial buckets that can't matter any more: together under a hundredth
                order = np.argsort(-p)
                keep = order[: int(np.searchsorted(np.cumsum(p[order]), p.sum() - 0.01 / self.bits)) + 1]
                p, cells = p[keep], cells[keep]
        order = np.argsort(-p, kind="stable")
        return self.code(table, cells[order[: int(np.searchsorted(np.cumsum(p[order]), self.success)) + 1]])


def _region(code: np.ndarray, salt, regions: int) -> np.ndarray:
    return (mix64(code ^ mix64(np.asarray(salt).astype(np.uint64) + np.uint64(1))) % np.uint64(regions)).astype(np.int32)


def nearest(table: DataFrame, k: int = 20, every: int = 20, index: Index | None = None) -> DataFrame:
    """The ``k`` nearest found of each query (rows whose ``vec_id`` is divisible by ``every``) among all other rows.

    ``query_id, rank, vec_id, score``: the largest inner products in double precision, nearest first, ties to the
    smaller ``vec_id``. Null, zero and non-finite vectors and null ids take no part; equal vectors are one class
    while searching; of rows with one id and vector, one counts; all candidates, if fewer than ``k``; an empty
    table gives no rows; other columns are not read. Vectors must have one dimension.
    """
    spark = table.sparkSession
    given = materialise(valid(table, []).where("vec_id is not null").distinct(), "vectors")
    # of equal vectors, the k + 1 of smallest id can be among anyone's k nearest others
    from pyspark.sql import Window

    numbered = given.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")))  # top k + 1 a group: pruned before the exchange
    classes = materialise(numbered.where(F.col("n") <= k + 1).groupBy("v").agg(F.min("vec_id").alias("c"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    asked = materialise(given.where(F.col("vec_id") % every == 0).groupBy("v").agg(F.min("vec_id").alias("q")), "queries")
    n = classes.count()
    if index is None:
        index = Index(fitted(classes, SAMPLE), max(2, n), k)
    regions = max(1, -(-n * index.tables // REGION))
    shared = spark.sparkContext.broadcast(index)

    def load(batches):
        ix = shared.value
        for batch in batches:
            data = batch.column(1).to_pylist()
            x = matrix(data)
            for t in range(ix.tables):
                code = ix.codes(t, x)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(x), t, np.int32)), pa.array(code.view(np.int64))], ["c", "v", "t", "code"])

    loaded = materialise(classes.select("c", "v").mapInArrow(load, "c long, v binary, t int, code long"), "index")
    crowded = {r[0]: r[1] for r in loaded.groupBy("code").count().where(F.col("count") > REGION).select("code", F.ceil(F.col("count") / REGION).cast("int")).collect()}  # n * tables / REGION codes at most
    split = spark.sparkContext.broadcast(crowded)

    def place(batches):
        for batch in batches:
            code = batch.column(3).to_numpy().view(np.uint64)
            ids = batch.column(0).to_numpy()
            many = np.array([split.value.get(int(c), 1) for c in code.view(np.int64)], np.uint64)
            salt = mix64(ids.view(np.uint64)) % many
            yield pa.RecordBatch.from_arrays([pa.array(_region(code, salt, regions)), pa.array(np.zeros(len(ids), np.int32)), batch.column(0), batch.column(1), pa.array([x.tobytes() for x in code], pa.binary())], ["region", "kind", "id", "v", "codes"])

    def probe(batches):
        ix = shared.value
        for batch in batches:
            for q, data, own, enough in zip(*(batch.column(j).to_pylist() for j in range(4))):
                if not enough:  # all buckets
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(regions, dtype=np.int32)), pa.array(np.ones(regions, np.int32)), pa.array([q] * regions, pa.int64()), pa.array([data] * regions, pa.binary()), pa.array([b""] * regions, pa.binary())], ["region", "kind", "id", "v", "codes"])
                    continue
                x = matrix([data])
                unit = ix.query(x)[0]
                near = None if own is None else float(np.clip(own / (ix.norm * np.sqrt((x**2).sum())), 0.05, 0.98))
                if near is not None and near >= ix.near:  # was probed for that already
                    continue
                codes = np.concatenate([ix.probes(t, unit, near) for t in range(ix.tables)])
                at = [_region(codes, np.zeros(len(codes)), regions)]
                whole = [codes]
                for c in codes[np.isin(codes.view(np.int64), list(split.value))] if split.value else ():
                    for s in range(1, split.value[int(np.int64(c.view(np.int64)))]):
                        at.append(_region(np.array([c]), np.array([s]), regions)), whole.append(np.array([c]))
                at, whole = np.concatenate(at), np.concatenate(whole)
                order = np.argsort(at, kind="stable")
                at, whole = at[order], whole[order]
                starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                m = len(starts)
                cells = [x.tobytes() for x in np.split(whole, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(at[starts]), pa.array(np.ones(m, np.int32)), pa.array([q] * m, pa.int64()), pa.array([data] * m, pa.binary()), pa.array(cells, pa.binary())], ["region", "kind", "id", "v", "codes"])

    kinds = "region int, kind int, id long, v binary, codes binary"

    def search(batches):
        now, rows, codes, ids, held, ix = None, [], [], [], [], shared.value
        x = order = None

        def ready():
            nonlocal x, codes, ids
            code = np.array(codes, np.uint64)
            o = np.argsort(code, kind="stable")
            x, codes, ids = (matrix([rows[i] for i in o]) if len(o) else np.empty((0, 1))), code[o], np.array(ids, np.int64)[o]

        def answer():
            out_q, out_c, out_s = [], [], []
            if len(ids) and held:
                uniq, inverse = np.unique(codes, return_inverse=True)
                hit = np.zeros((len(held), len(uniq)), bool)
                for r, (_, _, own) in enumerate(held):
                    if not len(own):
                        hit[r] = True
                        continue
                    at = np.searchsorted(uniq, own)
                    at[at == len(uniq)] = 0
                    hit[r, at[uniq[at] == own]] = True
                y = matrix([h[1] for h in held])
                s = y @ x.T
                longest = np.sqrt((x**2).sum(1).max())
                s[~hit[:, inverse]] = -np.inf
                keep = min(ix.tables * (k + 1), s.shape[1])  # a vector can come once a table
                least = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
                for r, (q, _, _) in enumerate(held):
                    # all that tie with the last one kept, products being rounded
                    near = least[r] - 1e-9 * np.sqrt((y[r] ** 2).sum()) * longest if np.isfinite(least[r]) else least[r]
                    found = np.flatnonzero(np.isfinite(s[r]) & (s[r] >= near))
                    exact = (x[found] * y[r]).sum(1)
                    best: dict[int, float] = {}
                    for i, e in zip(ids[found].tolist(), exact.tolist()):
                        best[i] = e
                    for i, e in sorted(best.items(), key=lambda b: (-b[1], b[0]))[: k + 1]:
                        out_q.append(q), out_c.append(i), out_s.append(e)
            return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_c, pa.int64()), pa.array(out_s, pa.float64())], ["q", "c", "score"])

        for batch in batches:
            for region, kind, i, v, c in zip(*(batch.column(j).to_pylist() for j in range(5))):
                if region != now:
                    if held:
                        if order is None:
                            ready()
                        yield answer()
                    now, rows, codes, ids, held, order = region, [], [], [], [], None
                if kind == 0:
                    rows.append(v), codes.append(int.from_bytes(c, "little")), ids.append(i)
                else:
                    if order is None:
                        ready()
                        order = True
                    held.append((i, v, np.frombuffer(c, np.uint64)))
                    if len(held) == QUERIES:
                        yield answer()
                        held = []
        if held:
            yield answer()

    def met(queries: DataFrame) -> DataFrame:
        both = loaded.mapInArrow(place, kinds).union(queries.select("q", "v", "own", "enough").mapInArrow(probe, kinds))
        return both.repartition("region").sortWithinPartitions("region", "kind").mapInArrow(search, "q long, c long, score double")

    # rank classes, then their members: a class's k + 1 smallest ids suffice
    by = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    asks = asked.join(given.where(F.col("vec_id") % every == 0), "v").select("q", F.col("vec_id").alias("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        best = found.groupBy("q", "c").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
        members = best.join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
        return members.join(asks, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = materialise(met(asked.select("q", "v", F.lit(None).cast("double").alias("own"), F.lit(True).alias("enough"))), "first")
    # the k-th score found is the least that the true one can be: probe again for it, everywhere where there are fewer
    had = ranked(first).groupBy("q", "query_id").agg(F.min("score").alias("own"), F.count("*").alias("n")).groupBy("q").agg(F.min("own").alias("own"), F.min("n").alias("n"))
    again = asked.join(had, "q", "left").select("q", "v", "own", (F.coalesce("n", F.lit(0)) >= k).alias("enough"))
    return ranked(first.union(met(again))).select("query_id", "rank", "vec_id", "score")
