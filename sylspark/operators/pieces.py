"""Texts by the pieces between their spaces: what a piece gives is worked out once a worker and looked up after that.

A space is a syllable of its own and no other syllable reaches over one, so that the syllables of a text are those of its
pieces with a space between. Texts are walked as bytes; the tables of a worker are bounded by entries and by bytes.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import small_batches
from ..functions.text import SYLLABLE

#: Pieces that are remembered, the bytes of the longest, and bytes of text after which counts are handed on.
MOST, LONG, TEXT = 500_000, 256, 64 << 20
#: Bytes of text that are laid out as arrays at once.
PART = 4 << 20

_SYLLABLE = re.compile(SYLLABLE)
_VOWEL = re.compile("[aeiouAEIOU]")


def cut(piece: bytes) -> list[str]:
    """The syllables of a piece, as ``syllabify`` gives them."""
    text = piece.decode()
    found = _SYLLABLE.findall(text)
    return found if text == text.lower() else [s.lower() if _VOWEL.search(s) else s for s in found]


class Remembered(dict):
    """What ``make`` gives of a piece; emptied when it is full, and long pieces are made anew."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, piece: bytes):
        value = self.make(piece)
        if len(piece) <= LONG:
            if len(self) >= MOST:
                self.clear()
            self[piece] = value
        return value


def texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _counted(batches: Iterable[pa.RecordBatch], give: Callable[[Counter, Counter, int], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``give`` of the pieces, of what begins (True) and ends (False) texts with a sign, and of the spaces between pieces."""
    pieces, ends, spaces, size = Counter(), Counter(), 0, 0
    for batch in batches:
        for text in texts(batch.column(0)):
            if not text:
                continue
            own = text.split(b" ")
            pieces.update(own)
            ends[own[0], True] += 1
            ends[own[-1], False] += 1
            spaces += len(own) - 1
            size += len(text)
            if size > TEXT:
                yield give(pieces, ends, spaces)
                pieces, ends, spaces, size = Counter(), Counter(), 0, 0
    yield give(pieces, ends, spaces)


def spelled(text: Column) -> Column:
    """The syllables of a text, joined."""

    @F.arrow_udf("string")
    def run(text: pa.Array) -> pa.Array:
        of = Remembered(lambda p: "".join(cut(p)).encode() if p != p.lower() else p).__getitem__
        return pa.array([None if t is None else b" ".join(map(of, t.split(b" "))) for t in texts(text)], pa.binary()).cast(pa.string())

    return run(text)


def syllable_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``syl, freq``."""
    small_batches(docs.sparkSession)

    def give(pieces, ends, spaces):
        found: Counter = Counter({" ": spaces} if spaces else {})
        for piece, n in pieces.items():
            for s in cut(piece):
                found[s] += n
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["syl", "n"])

    return docs.select(text).mapInArrow(lambda batches: _counted(batches, give), "syl string, n long").groupBy("syl").agg(F.sum("n").alias("freq"))


def counts(docs: DataFrame, text: str = "text", syllables: bool = True) -> DataFrame:
    """``l, r, freq`` of neighbouring syllables, and of single ones with ``r`` null: one walk over the texts.

    Pairs are those of every piece between two spaces, less the spaces that no text begins or ends with.
    """
    small_batches(docs.sparkSession)

    def give(pieces, ends, spaces):
        found: Counter = Counter()
        for piece, n in pieces.items():
            before = " "
            for s in cut(piece):
                found[before, s] += n
                before = s
            found[before, " "] += n
        if syllables:  # of every piece, what follows something
            own: Counter = Counter()
            for (_, r), n in found.items():
                own[r] += n
            own[" "] = spaces
        for (piece, first), n in ends.items():
            s = cut(piece) or [" "]
            found[(" ", s[0]) if first else (s[-1], " ")] -= n
        if syllables:
            for s, n in own.items():
                found[s, None] = n
        found = {p: n for p, n in found.items() if n}
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.string()), pa.array([p[1] for p in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["l", "r", "n"])

    return docs.select(text).mapInArrow(lambda batches: _counted(batches, give), "l string, r string, n long").groupBy("l", "r").agg(F.sum("n").alias("freq"))


def pair_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``l, r, freq`` of neighbouring syllables."""
    return counts(docs, text, syllables=False)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``s, n``: words, as what stands between white space, as their syllables with a space between, of which they have two at least.

    Words are cut where they are counted.
    """
    small_batches(docs.sparkSession)

    def give(words):
        found: Counter = Counter()
        for word, n in words.items():
            s = cut(word)
            if len(s) > 1:
                found[" ".join(s)] += n
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["s", "n"])

    def run(batches):
        words, size = Counter(), 0
        for batch in batches:
            for text in texts(batch.column(0)):
                if text:
                    words.update(text.split())  # bytes: ASCII white space only
                    size += len(text)
                    if size > TEXT:
                        yield give(words)
                        words, size = Counter(), 0
        yield give(words)

    return docs.select(text).mapInArrow(run, "s string, n long").groupBy("s").agg(F.sum("n").alias("n"))


class Table:
    """Pieces by number: how many syllables each has, and columns of what is found in it, behind one another."""

    def __init__(self, find: Callable[[list[str]], Iterable[tuple[int, ...]]], columns: int):
        self.find, self.columns = find, columns
        self.clear()

    def clear(self) -> None:
        self.numbers, self.bytes, self.length, self.first = {}, 0, array("q"), array("q", [0])
        self.found = [array("q") for _ in range(self.columns)]

    def number(self, piece: bytes) -> int:
        k = self.numbers.get(piece)
        if k is None:
            s = cut(piece)
            for row in self.find(s):
                for column, x in zip(self.found, row):
                    column.append(x)
            k = self.numbers[piece] = len(self.length)
            self.length.append(len(s))
            self.first.append(len(self.found[0]))
            self.bytes += len(piece)
        return k

    def rows(self, own: list[bytes], apart: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of every find in the texts ``own``: the text's number, the number of syllables before the piece, and its columns."""
        if len(self.numbers) > MOST or self.bytes > TEXT:
            self.clear()
        split = [t.split(b" ") for t in own] if apart else [[t] for t in own]
        of = self.number
        at = np.fromiter((of(p) for s in split for p in s), np.int64)
        text = np.repeat(np.arange(len(own)), np.fromiter(map(len, split), np.int64, len(own)))
        size = np.array(self.length)[at] + 1  # and the space after it
        ends = np.cumsum(size)
        starts = ends - size
        new = np.flatnonzero(np.diff(text, prepend=-1))  # the first piece of each text
        starts -= np.repeat(starts[new], np.diff(new, append=len(text)))
        first = np.array(self.first)
        n = first[at + 1] - first[at]
        pick = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(text, n), np.repeat(starts, n), [np.array(c)[pick] for c in self.found]


def parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Rows of a batch that have a text, a few megabytes at once, and the texts."""
    at, own, size = [], [], 0
    for k, t in enumerate(texts(batch.column(1))):
        if t:
            at.append(k), own.append(t)
            size += len(t)
        if size > PART:
            yield np.array(at, np.int64), own
            at, own, size = [], [], 0
    if own:
        yield np.array(at, np.int64), own


def finds(docs: DataFrame, find: Callable[[list[str]], Iterable[tuple[int, ...]]], names: list[str], apart: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and int columns ``names`` of what ``find`` gives of the syllables of every piece; the first is a position, and is counted from the beginning of the text. With ``apart`` false, what is to be found may have spaces in it: the pieces are whole texts."""
    small_batches(docs.sparkSession)

    def run(batches):
        table = Table(find, len(names))
        for batch in batches:
            for at, own in parts(batch):
                row, before, columns = table.rows(own, apart)
                columns[0] += before
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[row])), *(pa.array(c, pa.int32()) for c in columns)], [key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} int" for n in names))


def sums(docs: DataFrame, measure: Callable[[list[str]], tuple[int, ...]], names: list[str], apart: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and long columns ``names``: what ``measure`` gives of the syllables of a text's pieces and of a space between two, added up, for texts of a syllable at least."""
    small_batches(docs.sparkSession)

    def run(batches):
        of = Remembered(lambda p: np.array(measure(cut(p)), np.int64)).__getitem__
        space = np.array(measure([" "]), np.int64)
        for batch in batches:
            for at, own in parts(batch):
                split = [t.split(b" ") for t in own] if apart else [[t] for t in own]
                size = np.fromiter(map(len, split), np.int64, len(own))
                flat = np.array([of(p) for s in split for p in s])
                total = np.add.reduceat(flat, np.cumsum(size) - size) + (size - 1)[:, None] * space
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(np.ascontiguousarray(total[:, k])) for k in range(len(names)))], [key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} long" for n in names))
