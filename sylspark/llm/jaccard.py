"""Exact n-gram Jaccard self-join through a token-group matrix.

Documents with the same shingle set are one representative. Representatives are partitioned into groups of
similar ones by a min-hash of their rarest shingles. The matrix of shingles against groups (the union of the
members' prefix shingles) gives, for every pair of groups, a bound on what any two of their members can share;
only pairs of groups that qualify are opened, and opened groups are compared exactly. Nothing is approximate:
the prefix is long enough that two similar sets must meet in it as often as the bound says, whatever the order, and
the order (shingles that are frequent in the whole corpus last) only decides how few pairs of groups meet by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, materialise, mix64, small_batches, strings, turn

U64 = np.uint64
#: Shingles are counted in so many buckets by their first bits; counts come by the slice, and a task hands on its own after FLUSH shingles at most.
BITS, SLICE, FLUSH = 23, 1 << 17, 1_000_000
#: A shingle is rare if its bucket counts at most so many more than the median bucket does.
RARE = 16
#: Postings gathered before a task hands them on.
POSTINGS = 500_000
#: Postings of one bucket, on average; a task holds one bucket at a time.
BUCKET = 250_000
#: Meetings of a least group's shingles from which products of matrices are tried; groups of a strip.
DENSE, STRIP = 200_000, 512
#: Opened groups up to this number are broadcast to thin out the sets that are shipped; beyond, the join alone does it.
BROADCAST_GROUPS = 4_000_000
#: Sets of one component that are compared with one another in one task.
BLOCK = 1024
#: Shingles of these sets.
HEAVY = 8_000_000
#: Distinct words whose hashes a worker keeps.
WORDS = 200_000
#: Rows of a batch that are worked on at once.
ROWS = 512


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = _Words()


def shingles(text: str, size: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence if it has fewer words; empty without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and white space \\x20 \\x09-\\x0D
    n = len(words)
    if not n:
        return np.empty(0, U64)
    h = np.fromiter(map(_WORDS.__getitem__, words), U64, n)
    take = min(n, size)
    x = np.full(n - take + 1, take, U64)
    for k in range(take):
        x = (x ^ h[k : n - take + 1 + k]) * U64(0x9E3779B97F4A7C15)
        x ^= x >> U64(32)
    x = mix64(x)
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def _sets(batches, size):
    """(part of a batch, list of shingle arrays)"""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, [shingles(x, size) for x in strings(part.column(1))]


def shingle_counts(docs: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """How often the shingles of every bucket come, as 8 log2(count + 1); the highest of these that is rare; and how many all sets have together.

    All shingles of all sets are counted. A bucket also counts others of the same first bits, which only moves a shingle later in the order.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = min(SLICE, 1 << BITS)

    def run(batches):
        turn("jaccard", _WORDS)
        counts, held, n, pack = np.zeros(1 << BITS, np.uint32), [], 0, zstandard.ZstdCompressor(level=1)

        def count():
            x = np.concatenate(held) >> U64(64 - BITS)
            x.sort()
            at = _runs(x)
            counts[x[at]] += np.diff(np.append(at, len(x))).astype(np.uint32)

        for _, sets in _sets(batches, size):
            held += sets
            n += sum(map(len, sets))
            if n >= FLUSH:
                count()
                held, n = [], 0
        if n:
            count()
        for k in range(0, 1 << BITS, width):
            x = counts[k : k + width]
            if x.any():  # the bytes of one place together, which are zeros but for the lowest
                yield pa.RecordBatch.from_arrays([pa.array([k // width], pa.int32()), pa.array([pack.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes())], pa.binary())], ["slice", "data"])

    def add(batches):
        unpack, now, held = zstandard.ZstdDecompressor(), None, None

        def flush():
            code = np.minimum(255, np.rint(8 * np.log2(held + 1.0))).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([code.tobytes()], pa.binary()), pa.array([int(held.sum())], pa.int64())], ["slice", "data", "n"])

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != now:
                    if now is not None:
                        yield flush()
                    now, held = k, np.zeros(width, np.int64)
                held += np.frombuffer(unpack.decompress(data), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
        if now is not None:
            yield flush()

    counted = docs.mapInArrow(run, "slice int, data binary").repartition(parts, "slice").sortWithinPartitions("slice")
    codes, total = np.zeros(1 << BITS, np.uint8), 0
    for r in counted.mapInArrow(add, "slice int, data binary, n long").collect():
        codes[r.slice * width : (r.slice + 1) * width] = np.frombuffer(r.data, np.uint8)
        total += r.n
    median = 2 ** (float(np.median(codes)) / 8) - 1
    return codes, int(8 * np.log2(median + RARE + 1)), total


def prefix(s: np.ndarray, codes: np.ndarray, rare: int, num: int, den: int) -> tuple[np.ndarray, int]:
    """The first shingles of ``s`` in corpus order, of which any set that is similar enough must hold one, and the set's group.

    Corpus order is by the counts of the shingles' buckets, then by hash. A group is a min-hash of the prefix's rare
    shingles, and a class of sizes, so that its members are alike and the bounds over it are tight. Neither decides
    anything but the cost.
    """
    p = len(s) - -(-num * len(s) // den) + 1
    code = codes[s >> U64(64 - BITS)]
    front = s[np.argsort(code, kind="stable")[:p]]
    few = int((code <= rare).sum())
    least = mix64(front[: min(p, few) or p] ^ U64(0x5851F42D4C957F2D)).min()
    return front, int(mix64(np.array([least ^ U64(int(np.log(len(s)) / np.log(1.25)) << 1)], U64))[0])


#: A prefix shingle of a set: its group, the set's size, and the shingle's place in corpus order (both up to 65535).
POSTING = np.dtype([("token", "<u8"), ("group", "<u8"), ("size", "<u2"), ("place", "<u2")])
#: A cell of the matrix: a shingle and a group, the sizes of the members that hold it, and its least place in them.
CELL = np.dtype([("token", "<u8"), ("group", "<u8"), ("lo", "<u2"), ("hi", "<u2"), ("place", "<u2")])
#: Two groups, the prefix shingles that they share, their sizes, and whether one is early enough in both.
PAIR = np.dtype([("g", "<u8"), ("h", "<u8"), ("c", "<u2"), ("glo", "<u2"), ("ghi", "<u2"), ("hlo", "<u2"), ("hhi", "<u2"), ("early", "u1")])
MOST = 65535


def _high(x: np.ndarray) -> np.ndarray:
    return np.where(x == MOST, np.inf, x.astype(float))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys in sorted arrays."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _cells(x: np.ndarray) -> np.ndarray:
    """The matrix cells of postings or of other cells, sorted by shingle, then group."""
    x = x[np.lexsort((x["group"], x["token"]))]
    at = _runs(x["token"], x["group"])
    out = np.empty(len(at), CELL)
    lo, hi = ("size", "size") if "size" in x.dtype.names else ("lo", "hi")
    out["token"], out["group"] = x["token"][at], x["group"][at]
    if len(at):
        out["lo"], out["hi"], out["place"] = np.minimum.reduceat(x[lo], at), np.maximum.reduceat(x[hi], at), np.minimum.reduceat(x["place"], at)
    return out


def _shared(x: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """The cells that can meet another of their shingle, and for each the least hash of its shingle's groups."""
    for _ in range(2):  # the second time without what went
        at = _runs(x["token"])
        length = np.diff(np.append(at, len(x)))
        if not len(at):
            break
        lo, hi = x["lo"].astype(float), _high(x["hi"])
        least = np.repeat(np.minimum.reduceat(lo, at), length)
        with np.errstate(invalid="ignore"):
            late = x["place"] > hi - t * np.maximum(hi, least) + 1e-6
        x = x[(np.repeat(length, length) > 1) & ~late]
    if not len(x):
        return x, np.empty(0, U64)
    at = _runs(x["token"])
    length = np.diff(np.append(at, len(x)))
    least = np.repeat(np.minimum.reduceat(mix64(x["group"]), at), length)
    some = np.repeat(length, length) > 1
    return x[some], least[some]


def _merged_pairs(x: np.ndarray) -> np.ndarray:
    x = x[np.lexsort((x["h"], x["g"]))]
    at = _runs(x["g"], x["h"])
    out = x[at].copy()
    if len(at):
        out["c"] = np.minimum(np.add.reduceat(x["c"].astype(np.int64), at), MOST)
        for k in ("glo", "hlo"):
            out[k] = np.minimum.reduceat(x[k], at)
        for k in ("ghi", "hhi", "early"):
            out[k] = np.maximum.reduceat(x[k], at)
    return out


def _met_dense(x: np.ndarray, t: float):
    """``_met`` of cells where most groups hold most shingles: by blocks of groups of about one size, whose least sizes stand for all."""
    token = np.unique(x["token"], return_inverse=True)[1]
    group, own = np.unique(x["group"], return_inverse=True)
    low, high = np.full(len(group), MOST, np.uint16), np.zeros(len(group), np.uint16)
    np.minimum.at(low, own, x["lo"])
    np.maximum.at(high, own, x["hi"])
    order = np.argsort(low, kind="stable")
    group, low, high = group[order], low[order], high[order]
    row = np.empty(len(order), np.int64)
    row[order] = np.arange(len(order))
    row = row[own]
    by = np.argsort(row, kind="stable")
    x, token, row = x[by], token[by], row[by]
    place, hi, lows, highs = x["place"].astype(float), _high(x["hi"]), low.astype(float), _high(high)
    starts = range(0, len(group), STRIP)
    cuts = np.searchsorted(row, [*starts, len(group)])

    def products(i, j):
        """Shingles in common, and those that are early in both, of the groups of two strips."""
        parts = []
        for one, other in ((i, j), (j, i)):
            of = slice(cuts[one], cuts[one + 1])
            least, h = lows[starts[other]], hi[of]
            with np.errstate(invalid="ignore"):
                late = place[of] > h - t * np.maximum(h, least) + 1e-6
                early = ~(late | (place[of] > h - t / (1 + t) * (h + least) + 1e-6))
            parts.append((row[of] - starts[one], token[of], ~late, early, min(STRIP, len(group) - starts[one])))
        both, first, width = 0, 0, min(2048, int(token.max()) + 1)
        for k in range(0, int(token.max()) + 1, width):
            m = []
            for rows, tokens, counted, early, n in parts:
                here = (tokens >= k) & (tokens < k + width)
                for which in (counted, early):
                    m.append(np.zeros((n, width), np.float32))
                    m[-1][rows[here & which], tokens[here & which] - k] = 1
            both = both + m[0] @ m[2].T
            first = first + m[1] @ m[3].T
        return both, first

    for i in range(len(starts)):
        for j in range(i + 1):
            a, b = (slice(starts[k], starts[k] + STRIP) for k in (i, j))
            fit = (highs[a][:, None] >= t * lows[b][None, :]) & (highs[b][None, :] >= t * lows[a][:, None])
            if i == j:
                fit = np.tril(fit, -1)
            if not fit.any():
                continue
            both, first = products(i, j)
            r, c = np.nonzero(fit & (both > 0))
            out = np.empty(len(r), PAIR)
            out["c"], out["early"] = np.minimum(both[r, c], MOST), first[r, c] > 0
            r, c = r + starts[i], c + starts[j]
            r, c = np.where(group[r] < group[c], r, c), np.where(group[r] < group[c], c, r)  # as in runs sorted by group
            out["g"], out["h"] = group[r], group[c]
            out["glo"], out["ghi"], out["hlo"], out["hhi"] = low[r], high[r], low[c], high[c]
            if len(out):
                yield out


def _met(x: np.ndarray, t: float):
    """Pairs of groups that share a token of merged postings, where sizes allow for similar members; in parts.

    Similar sets of sizes a and b share T = t / (1 + t) * (a + b) at least. What they share beyond the place a - t * max(a, b)
    of the one or b - t * max(a, b) of the other is less than t * max(a, b), so places beyond aren't counted; and one
    that they share is among the first size - T + 1 of either: it is early.
    Shingles of the same least group that many of the same groups hold are counted by products of matrices.
    """
    at = _runs(x["token"])
    length = np.diff(np.append(at, len(x)))
    if not len(at):
        return
    least = np.minimum.reduceat(mix64(x["group"]), at)
    family, work = np.unique(least, return_inverse=True)[1], length * (length - 1) // 2
    rest = np.ones(len(at), bool)
    for k in np.flatnonzero(np.bincount(family, weights=work) >= DENSE):
        own = family == k
        part = x[np.repeat(own, length)]
        if len(np.unique(part["group"])) ** 2 * own.sum() < 500 * work[own].sum():
            rest &= ~own
            yield from _met_dense(part, t)
    x = x[np.repeat(rest, length)]
    at = _runs(x["token"])
    length = np.diff(np.append(at, len(x)))
    for r in np.unique(length[length > 1]):
        starts = at[length == r]
        for i in range(r - 1):  # one member of each run against the later ones, some runs at a time
            step = max(1, 500_000 // (r - 1 - i))
            for k in range(0, len(starts), step):
                own = starts[k : k + step]
                a = x[np.repeat(own + i, r - 1 - i)]
                b = x[(own[:, None] + np.arange(i + 1, r)[None, :]).ravel()]
                alo, ahi, blo, bhi = a["lo"].astype(float), _high(a["hi"]), b["lo"].astype(float), _high(b["hi"])
                with np.errstate(invalid="ignore"):
                    late = (a["place"] > ahi - t * np.maximum(ahi, blo) + 1e-6) | (b["place"] > bhi - t * np.maximum(bhi, alo) + 1e-6)
                    fit = (ahi >= t * blo) & (bhi >= t * alo) & ~late
                    a, b, alo, ahi, blo, bhi = (v[fit] for v in (a, b, alo, ahi, blo, bhi))
                    early = ~((a["place"] > ahi - t / (1 + t) * (ahi + blo) + 1e-6) | (b["place"] > bhi - t / (1 + t) * (bhi + alo) + 1e-6))
                out = np.empty(len(a), PAIR)
                out["g"], out["h"], out["c"], out["early"] = a["group"], b["group"], 1, early
                out["glo"], out["ghi"], out["hlo"], out["hhi"] = a["lo"], a["hi"], b["lo"], b["hi"]
                if len(out):
                    yield out


def qualifies(x: np.ndarray, t: float) -> np.ndarray:
    """Whether some members of the two groups could be similar, by their common prefix shingles and sizes.

    Sets of sizes a >= b that are similar share t / (1 + t) * (a + b); outside the common prefix they can share
    less than t * a. The least that this leaves for the common prefix, over the sizes in the groups, is needed.
    """
    least = np.full(len(x), np.inf)
    for glo, ghi, hlo, hhi in (("glo", "ghi", "hlo", "hhi"), ("hlo", "hhi", "glo", "ghi")):
        a = np.minimum(_high(x[ghi]), _high(x[hhi]) / t)
        b = np.maximum(x[hlo].astype(float), t * a)
        with np.errstate(invalid="ignore"):
            need = np.where(np.isfinite(a), t / (1 + t) * (a + b) - t * a, 0)
        can = (a >= x[glo]) & (b <= a) & (b <= _high(x[hhi]))
        least = np.where(can, np.minimum(least, need), least)
    return (x["early"] > 0) & (x["c"] + 1e-6 >= least)


def _blobs(x: np.ndarray, bucket: np.ndarray, kind: int):
    order = np.argsort(bucket, kind="stable")
    x, bucket = x[order], bucket[order]
    at = _runs(bucket)
    ends = np.append(at[1:], len(x))
    data = pa.array([x[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array([kind] * len(at), pa.int32()), data], ["bucket", "kind", "data"])


BLOB = "bucket int, kind int, data binary"
MEMBER = np.dtype([("group", "<u8"), ("d0", "<u8"), ("d1", "<u8")])


def _buckets(batches, kinds):
    """(bucket, for each kind its arrays) of blobs sorted by bucket, one bucket at a time; arrays are merged as they come."""
    now, held = None, [[] for _ in kinds]
    for batch in batches:
        for bucket, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if bucket != now:
                if now is not None:
                    yield held
                now, held = bucket, [[] for _ in kinds]
            dtype, merge = kinds[kind]
            held[kind].append(np.frombuffer(data.as_buffer(), dtype).copy())
            if len(held[kind]) > 4096:
                held[kind] = [merge(np.concatenate(held[kind]))]
    if now is not None:
        yield held


def opened_groups(docs: DataFrame, size: int, num: int, den: int, codes, rare: int, total: int) -> DataFrame:
    """``(a, b)``: pairs of groups to open; a group with two different sets pairs with itself. ``total``: shingles of all sets."""
    spark = docs.sparkSession
    t = num / den
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, int(total * (1 - t) / BUCKET) + 1)
    parts = max(parts, -(-buckets // 8))

    def post(batches):
        turn("jaccard", _WORDS)
        held, members, n = [], [], 0

        def flush():
            x = np.concatenate(held)
            x = x[np.lexsort((x["place"], x["size"], x["group"], x["token"]))]
            x = x[_runs(x["token"], x["group"], x["size"], x["place"])]
            yield _blobs(x, mix64(x["token"]) % U64(buckets), 0)
            m = np.unique(np.array(members, MEMBER))
            yield _blobs(m, mix64(m["group"]) % U64(buckets), 1)

        for _, sets in _sets(batches, size):
            for s in sets:
                if not len(s):
                    continue
                front, group = prefix(s, codes.value, rare, num, den)
                x = np.empty(len(front), POSTING)
                x["token"], x["group"] = front, group
                x["size"], x["place"] = min(MOST, len(s)), np.minimum(np.arange(len(front)), MOST)
                held.append(x)
                members.append((x["group"][0], *np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<u8")))
                n += len(x)
                if n >= POSTINGS:
                    yield from flush()
                    held, members, n = [], [], 0
        if n:
            yield from flush()

    def pairs_of(pairs):
        x = _merged_pairs(np.concatenate(pairs))
        return x, mix64(x["g"] ^ mix64(x["h"])) % U64(buckets)

    def gather(batches):
        """Cells of shingles of several groups, by the least hash of these, so that what the same groups share comes together."""
        turn("jaccard", _WORDS)
        for held, members in _buckets(batches, [(POSTING, lambda x: x), (MEMBER, np.unique)]):
            if members:
                m = np.unique(np.concatenate(members))
                at = _runs(m["group"])
                several = m["group"][at][np.diff(np.append(at, len(m))) > 1]
                x = np.zeros(len(several), CELL)
                x["group"] = several
                if len(x):
                    yield _blobs(x, mix64(several) % U64(buckets), 1)
            if held:
                x, least = _shared(_cells(np.concatenate(held)), t)
                if len(x):
                    yield _blobs(x, mix64(least) % U64(buckets), 0)

    def meet(batches):
        turn("jaccard", _WORDS)
        for held, several in _buckets(batches, [(CELL, lambda x: x), (CELL, lambda x: x)]):
            if several:
                g = np.concatenate(several)["group"]
                x = np.zeros(len(g), PAIR)
                x["g"], x["h"], x["c"], x["ghi"], x["hhi"], x["early"] = g, g, MOST, MOST, MOST, 1
                yield _blobs(*pairs_of([x]), 0)
            if held:
                pairs, n = [], 0
                for x in _met(_cells(np.concatenate(held)), t):
                    pairs.append(x)
                    n += len(x)
                    if n > POSTINGS:
                        pairs = [pairs_of(pairs)[0]]
                        n = len(pairs[0])
                        if n > POSTINGS // 2:
                            yield _blobs(*pairs_of(pairs), 0)
                            pairs, n = [], 0
                if n:
                    yield _blobs(*pairs_of(pairs), 0)

    def judge(batches):
        turn("jaccard", _WORDS)
        for (held,) in _buckets(batches, [(PAIR, _merged_pairs)]):
            x = _merged_pairs(np.concatenate(held))
            x = x[qualifies(x, t)]
            yield pa.RecordBatch.from_arrays([pa.array(x["g"].copy().view(np.int64)), pa.array(x["h"].copy().view(np.int64))], ["a", "b"])

    def by_bucket(df):
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket")

    cells = by_bucket(docs.mapInArrow(post, BLOB)).mapInArrow(gather, BLOB)
    met = by_bucket(cells).mapInArrow(meet, BLOB)
    return materialise(by_bucket(met).mapInArrow(judge, "a long, b long"), "opened")


def _linked(digests: list[bytes], copies: np.ndarray, side: np.ndarray, sets: list[np.ndarray], cross: bool, num: int, den: int):
    """(digest, linked copies, root) of the sets of one block, or of pairs across two blocks."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    token = np.concatenate(sets)
    row = np.repeat(np.arange(m, dtype=np.int32), n)
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    del order
    length = np.diff(np.append(_runs(token), len(token)))
    del token
    start = np.cumsum(length) - length
    both = np.zeros(m * m, np.int64)
    few = min(12, m)
    for d in range(2, few + 1):  # shingles of few sets: their pairs one by one
        own = start[length == d]
        for i in range(d):
            for j in range(i):
                if len(own):
                    both += np.bincount(row[own + i] * m + row[own + j], minlength=m * m)
    both = both.reshape(m, m)
    both = both + both.T
    most = np.flatnonzero(length > few)
    width = max(256, 2_000_000 // m)
    for k in range(0, len(most), width):  # shingles of many: a product of matrices
        own = most[k : k + width]
        part = np.zeros((m, len(own)), np.float32)
        part[np.concatenate([row[start[c] : start[c] + length[c]] for c in own]), np.repeat(np.arange(len(own)), length[own])] = 1
        both += (part @ part.T).astype(np.int64)
    link = den * both >= num * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(link, False)
    if cross:
        link &= side[:, None] != side[None, :]
    roots = list(range(m))

    def find(x):
        while roots[x] != x:
            roots[x] = roots[roots[x]]
            x = roots[x]
        return x

    for i in range(m):
        for j in np.flatnonzero(link[i, :i]):
            a, b = find(i), find(int(j))
            if a != b:
                a, b = (a, b) if digests[a] < digests[b] else (b, a)
                roots[b] = a
    add = link @ copies
    return [(digests[i], int(add[i]), digests[find(i)]) for i in range(m) if add[i]]


def _compare(size: int, num: int, den: int):
    def run(batches):
        turn("jaccard", _WORDS)
        now, held, unpack = None, [], zstandard.ZstdDecompressor()

        def flush():
            out = []
            if len(held) > 1:
                one = now[1] == now[2]
                out = _linked([h[0] for h in held], np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held]), [h[3] for h in held], not one, num, den)
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary()), pa.array([now[3] > 1] * len(out), pa.bool_())], ["digest", "add", "root", "many"])

        for batch in batches:
            for c, i, j, many, digest, copies, b, data in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if now is None or (c, i, j) != now[:3]:
                    if held:
                        yield flush()
                    now, held = (c, i, j, many), []
                held.append((digest, copies, b, shingles(unpack.decompress(data).decode("utf-8", "surrogatepass"), size)))
        if held:
            yield flush()

    return run


def similar(docs: DataFrame, size: int = 2, num: int = 60, den: int = 100, detail: bool = False) -> DataFrame:
    """Link ``docs(doc_id, text)`` whose shingle sets have Jaccard ``num / den`` or more, exactly.

    Returns per row ``doc_id, n_shingles, n_similar`` (other rows linked directly) and ``component_id`` (the
    smallest id reachable by links, itself included). Words are runs of other than ASCII white space, A-Z in
    lower case. Null, empty and blank texts have no shingle and link with nothing; repeated rows are rows of
    their own that link with one another; a null ``doc_id`` counts as a row, but is a component's id only if
    no row of it has one; an empty table gives no rows; other columns are not read. Shingles are compared by
    64-bit hash, sets by 128-bit hash. With ``detail``, also ``text_hash`` (xxhash64) and ``class``, which the rows of
    a component have in common (null without shingles).
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    codes, rare, total = shingle_counts(docs, size)
    codes = spark.sparkContext.broadcast(codes)
    pairs = opened_groups(docs, size, num, den, codes, rare, total)
    across = pairs.where("a <> b")
    ids = connected_components(across)
    alone = pairs.where("a = b").select(F.col("a").alias("node")).join(ids, "node", "left_anti")
    part_of = materialise(ids.union(alone.select("node", F.col("node").alias("component"))), "parts")
    few = part_of.select("node").limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    open_ = spark.sparkContext.broadcast(np.sort(part_of.select("node").toArrow().column(0).to_numpy().view(U64)) if few else None)

    def describe(batches):
        turn("jaccard", _WORDS)
        pack = zstandard.ZstdCompressor(level=3)
        for batch, sets in _sets(batches, size):
            n, digests, groups, data = [], [], [], []
            for s, text in zip(sets, batch.column(1)):
                n.append(len(s))
                if not len(s):
                    digests.append(None), groups.append(None), data.append(None)
                    continue
                raw = s.tobytes()
                g = prefix(s, codes.value, rare, num, den)[1]
                digests.append(xxhash.xxh3_128_digest(raw))
                groups.append(g - (g >> 63 << 64))
                o = open_.value
                k = 0 if o is None else int(np.searchsorted(o, U64(g)))
                data.append(pack.compress(text.as_py().encode("utf-8", "surrogatepass")) if o is None or k < len(o) and int(o[k]) == g else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(groups, pa.int64()), pa.array(data, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "digest", "grp", "data"],
            )

    rows = materialise(docs.mapInArrow(describe, "doc_id long, text_hash long, n_shingles long, digest binary, grp long, data binary"), "sets")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low"))
    # where each set of an opened group is compared, from keys alone; the texts then move twice, by set and by task
    keys = rows.where("data is not null").select("digest", F.col("grp").alias("node"), "n_shingles").distinct().join(part_of, "node")
    keys = materialise(keys.join(classes, "digest").select("component", "node", "digest", "copies", "n_shingles"), "keys")
    nodes = materialise(keys.groupBy("component", "node").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("weight")), "nodes")
    a, b = (nodes.select("component", F.col("node").alias(k), F.col("sets").alias(f"n{k}")) for k in ("a", "b"))
    costs = pairs.join(a, "a").join(b.drop("component"), "b").groupBy("component").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.col("na") + F.col("nb"))).alias("cost"))
    blocks = nodes.groupBy("component").agg(F.sum("sets").alias("n"), F.max("sets").alias("widest"), F.max("weight").alias("heaviest"), F.ceil(F.greatest(F.sum("sets") / F.lit(BLOCK), F.sum("weight") / F.lit(HEAVY))).cast("int").alias("many")).where("n > 1")
    # a large component is cut into blocks of groups with the same least neighbour; of two blocks, the groups that are opened with one of the other are compared
    narrow = (F.col("many") > 1) & (F.col("widest") <= BLOCK // 2) & (F.col("heaviest") <= HEAVY // 2) & ((F.col("many") > 8) | (F.col("cost") < F.col("n") * F.col("many")))
    blocks = blocks.join(costs, "component").select("component", "many", narrow.alias("narrow"))
    placed = materialise(keys.join(blocks, "component"), "placed")
    dense = placed.where("not narrow").withColumn("b", F.pmod(F.xxhash64("digest"), F.col("many").cast("long"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many").cast("long") - 1)))
    dense = dense.select("component", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "many", "digest", "copies", "b")
    ends = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    ends = nodes.join(blocks.where("narrow").select("component"), "component").join(ends, "node")
    before = Window.partitionBy("component").orderBy("least", "node").rowsBetween(Window.unboundedPreceding, -1)
    nth = F.floor(F.coalesce(F.sum("sets").over(before), F.lit(0)) * 2 / BLOCK) + F.floor(F.coalesce(F.sum("weight").over(before), F.lit(0)) * 2 / HEAVY)
    ends = materialise(ends.select("component", "node", nth.cast("long").alias("block")), "blocks")
    a, b = (ends.select(F.col("node").alias(k), F.col("block").alias(f"b{k}")) for k in ("a", "b"))
    sides = pairs.join(a, "a").join(b, "b").select(F.least("ba", "bb").alias("i"), F.greatest("ba", "bb").alias("j"), F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ba").alias("b")), F.struct(F.col("b").alias("node"), F.col("bb").alias("b")))).alias("x"))
    sides = sides.select("i", "j", "x.node", "x.b").distinct()
    sparse = placed.where("narrow").join(sides, "node").select("component", "i", "j", "many", "digest", "copies", "b")
    texts = rows.where("data is not null").groupBy("digest").agg(F.first("data").alias("data"))
    spread = dense.union(sparse).join(texts, "digest").select("component", "i", "j", "many", "digest", "copies", "b", "data")
    compared = spread.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = materialise(compared.mapInArrow(_compare(size, num, den), "digest binary, add long, root binary, many boolean"), "links")
    roots = links.where("not many").select("digest", "root")
    over = links.where("many").select(F.col("digest").alias("a"), F.col("root").alias("b"))
    if not over.isEmpty():  # components compared in several blocks
        roots = roots.union(connected_components(over))
    linked = links.groupBy("digest").agg(F.sum("add").alias("add"))
    known = classes.join(linked, "digest", "left").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    known = materialise(known, "classes")
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    result = known.join(lowest, "root").select("digest", (F.col("copies") - 1 + F.coalesce("add", F.lit(0))).alias("n_similar"), "component_id", F.col("root").alias("class"))
    out = rows.select("doc_id", "text_hash", "n_shingles", "digest").join(result, "digest", "left")
    out = out.withColumn("n_similar", F.coalesce("n_similar", F.lit(0))).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "n_similar", "component_id", *(["text_hash", "class"] if detail else []))


def one_of_each(docs: DataFrame, size: int = 2, num: int = 60, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component one row of the smallest id stays.

    Rows without words (null, empty and blank texts) stay, repeated ones too. Of rows with one id and text, the one
    with the least hash of all its columns stays. All columns are kept, whatever their names; the texts are shuffled
    once, by id and hash; an empty table gives no rows.
    """
    used = {c.lower() for c in docs.columns}

    def fresh(name: str) -> str:
        while name in used:
            name += "_"
        return name

    own, digest, other, nth, whole = map(fresh, ("kept_id", "kept_hash", "text_digest", "nth_row", "row_digest"))
    found = similar(docs, size, num, den, detail=True).where("class is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    keys = found.groupBy("class").agg(first.alias("k")).select(F.col("k.doc_id").alias(own), F.col("k.text_hash").alias(digest))
    has = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    given = docs.withColumns({other: F.xxhash64("text"), whole: F.xxhash64(*docs.columns)})
    met = given.where(has).join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.col(other) == F.col(digest)))
    met = met.withColumn(nth, F.row_number().over(Window.partitionBy(own, digest).orderBy(whole)))
    return met.where(F.col(nth) == 1).select(*docs.columns).union(docs.where(~has))
