"""Counterfactual-regularised toxicity classifier.

A logistic model over the words of a text and the beginnings of words. Identity terms of the labelled texts are
swapped for others of their list, and training penalises the square of what a swap changes in the score, so a
neutral mention of a group doesn't count against a text. Fitted on a bounded sample; scores every whole text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, strings, turn

WORD = re.compile(r"[^\W\d_]+")
#: Lists of identity terms; within a list, one is swapped for the next. In the order of languages en, de, fr, es.
IDENTITIES = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrants", "natives", "foreigners", "refugees"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "hindus"), ("ausländer", "einheimische", "flüchtlinge"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous"), ("étrangers", "immigrés", "réfugiés"),
    ("mujeres", "hombres", "niñas", "niños"), ("musulmanes", "cristianos", "judíos", "hindúes"), ("extranjeros", "inmigrantes", "refugiados"),
)
STARTS = (4, 5, 6)
#: Distinct runs of non-space characters whose features a worker keeps.
CACHE = 250_000


def features_of(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    return [zlib.crc32(word.encode()), *(zlib.crc32(f"{word[:k]}*".encode()) for k in STARTS if len(word) >= k)]


def _swaps(identities) -> dict[str, str]:
    return {x: group[(k + 1) % len(group)] for group in identities for k, x in enumerate(group) if len(group) > 1}


def text_features(text: str) -> np.ndarray:
    """Sorted distinct features of the whole text."""
    return np.array(sorted({f for w in set(WORD.findall(text.lower())) for f in features_of(w)}), np.uint32)


def counterfactual(text: str, swaps: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Features that swapping the text's identity terms removes and adds."""
    words = set(WORD.findall(text.lower()))
    if not words & swaps.keys():
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    other = {swaps.get(w, w) for w in words}
    a, b = ({f for w in x for f in features_of(w)} for x in (words, other))
    return np.array(sorted(a - b), np.uint32), np.array(sorted(b - a), np.uint32)


@dataclass(frozen=True)
class Model:
    """Weights by feature hash; ``score`` of a text is the logistic of their sum and the bias."""

    bias: float
    weights: dict[int, float]
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    def __reduce__(self):
        return Model, (self.bias, self.weights)

    def _of(self, chunk: str) -> tuple[int, ...]:
        return tuple(f for w in WORD.findall(chunk) for f in features_of(w) if f in self.weights)

    def score(self, text: str) -> float:
        cache = self._cache
        if len(cache) > CACHE:
            cache.clear()
        found: set[int] = set()
        for chunk in set(text.lower().split()):
            own = cache.get(chunk)
            if own is None:
                cache[chunk] = own = self._of(chunk)
            if own:
                found.update(own)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[f] for f in sorted(found)), -500, 500))))


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Labelled rows to learn from, ``rows`` at most, by the least hash of their id: ``doc_id, toxic``.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out; ids labelled both ways count as their mean.
    """
    given = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    given = given.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    return given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 10_000, features: int = 4000, penalty: float = 1.0, ridge: float = 2e-4, rounds: int = 400, identities=IDENTITIES) -> Model:
    """Fit on at most ``rows`` labelled documents, which are all that reaches the driver, as hashed features.

    Of several texts of one id, the one of the least hash counts; null texts count as empty; without labelled rows, or with
    rows of one label, the model is a bias alone.
    """
    swaps = _swaps(identities)
    small_batches(docs.sparkSession)

    def extract(batches):
        turn("toxicity")
        for batch in batches:
            texts = strings(batch.column(0))
            data = [text_features(x).tobytes() for x in texts]
            pairs = [counterfactual(x, swaps) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(data, pa.binary()), *(pa.array([p[k].tobytes() for p in pairs], pa.binary()) for k in (0, 1))], ["toxic", "f", "minus", "plus"])

    few = F.broadcast(sample(docs, labels, rows))  # bounded by ``rows``
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(few, "doc_id")
    chosen = met.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")
    got = chosen.mapInArrow(extract, "toxic int, f binary, minus binary, plus binary").toArrow()
    y = np.array(got.column("toxic").to_pylist(), float)
    x, minus, plus = ([np.frombuffer(b, np.uint32) for b in got.column(k).to_pylist()] for k in ("f", "minus", "plus"))
    return train(x, y, minus, plus, features, penalty, ridge, rounds)


def train(x: list[np.ndarray], y: np.ndarray, minus: list[np.ndarray], plus: list[np.ndarray], features: int, penalty: float, ridge: float, rounds: int) -> Model:
    n = len(y)
    if not n:
        return Model(-20.0, {})
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    if not 0 < y.sum() < n:
        return Model(base, {})
    # rows in a fixed order, whatever order they came in
    order = sorted(range(n), key=lambda i: (x[i].tobytes(), y[i]))
    x, y, minus, plus = [x[i] for i in order], y[order], [minus[i] for i in order], [plus[i] for i in order]
    every, column = np.unique(np.concatenate(x), return_inverse=True)
    row = np.repeat(np.arange(n), [len(a) for a in x])
    total = np.bincount(column, minlength=len(every))
    bad = np.bincount(column, weights=y[row], minlength=len(every))
    p = y.mean()
    z = np.abs(bad - total * p) / np.sqrt(total * p * (1 - p) + 1e-9)
    z[(total < 3) | (z < 5)] = -1
    moved = np.unique(np.concatenate([*minus, *plus]))
    top = np.argsort(-z, kind="stable")[:features]
    names = np.union1d(every[top[z[top] > 0]], moved)
    if not len(names):
        return Model(base, {})
    new = np.searchsorted(names, every)
    new[new == len(names)] = 0
    keep = (names[new] == every)[column]
    row, column = row[keep], new[column[keep]]

    def flat(groups):
        r = np.repeat(np.arange(n), [len(g) for g in groups])
        return r, np.searchsorted(names, np.concatenate(groups)) if len(r) else r

    (mr, mc), (pr, pc) = flat(minus), flat(plus)
    swapped = max(1, sum(1 for g in minus if len(g)))
    w, b = np.zeros(len(names)), base
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum())) * (1 - 0.5) + 0.5 / n  # half balanced
    for k in range(1, rounds + 1):
        score = np.bincount(row, weights=w[column], minlength=n) + b
        g = weight * (1 / (1 + np.exp(-score)) - y)
        change = np.bincount(pr, weights=w[pc], minlength=n) - np.bincount(mr, weights=w[mc], minlength=n)
        c = 2 * penalty * change / swapped
        grad = np.bincount(column, weights=g[row], minlength=len(names)) + ridge * w
        grad += np.bincount(pc, weights=c[pr], minlength=len(names)) - np.bincount(mc, weights=c[mr], minlength=len(names))
        grad = np.append(grad, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    used = np.abs(w) > 1e-4
    return Model(float(b), dict(zip(names[used].tolist(), w[used].tolist())))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; no shuffle.

    Null and empty texts score the bias alone; repeated rows are rows of their own; a null ``doc_id`` is hashed as
    empty text, so it is held out; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 features of each selected word at most

    def run(batches):
        turn("toxicity", shared.value._cache)
        for batch in batches:
            found = np.array([shared.value.score(x) for x in strings(batch.column(1))], float)
            out = [b"" if d is None else str(d).encode() for d in batch.column(0).to_pylist()]
            held = pa.array([zlib.crc32(d) % 5 == 0 for d in out], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), held, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def rejected(docs: DataFrame, model: Model, reject: bool = False) -> DataFrame:
    """The rows of ``docs`` whose text the model doesn't reject (or, with ``reject``, those it does), all columns kept.

    Null and empty texts score the bias alone, repeated rows are judged alike and all stay or go; rows are never joined, so
    null ids and columns of any name are no matter; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        turn("toxicity", shared.value._cache)
        for batch in batches:
            yield batch.filter(pa.array([(shared.value.score(x) >= 0.5) == reject for x in strings(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
