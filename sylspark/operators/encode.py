"""Longest-match encoding and decoding over a vocabulary of syllable sequences."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import small_batches
from ..functions.text import syllabify
from .pieces import Remembered, cut, texts

LONGEST = 32


class Vocabulary:
    """``ids`` by tuple of syllables, longest ``LONGEST``; 0 is for what is unknown."""

    def __init__(self, rows: list[tuple[tuple[str, ...], int]], tokens: dict[int, str] | None = None):
        self.ids = {tuple(s): i for s, i in rows if 0 < len(s) <= LONGEST}
        self.tokens = tokens or {i: "".join(s) for s, i in rows}
        self.apart = not any(" " in s for s in self.ids if len(s) > 1)
        self.encoders: dict[str, Remembered] = {}
        self.spelling = self.sent = None
        self.longest: dict[str, int] = {}
        self.longest_to: dict[str, int] = {}
        for s in self.ids:
            self.longest[s[0]] = max(self.longest.get(s[0], 0), len(s))
            self.longest_to[s[-1]] = max(self.longest_to.get(s[-1], 0), len(s))

    def ltr(self, s: list[str]) -> list[int]:
        """Longest match from the left."""
        s, out, i, n = tuple(s), [], 0, len(s)
        while i < n:
            for k in range(min(self.longest.get(s[i], 0), n - i), 0, -1):
                if (found := self.ids.get(s[i : i + k])) is not None:
                    out.append(found)
                    i += k
                    break
            else:
                out.append(0)
                i += 1
        return out

    def rtl(self, s: list[str]) -> list[int]:
        """From the end, the longest match that starts where a match can end: anywhere, as unknown syllables pass."""
        s, out, j = tuple(s), [], len(s)
        while j:
            for k in range(min(self.longest_to.get(s[j - 1], 0), j), 0, -1):
                if (found := self.ids.get(s[j - k : j])) is not None:
                    out.append(found)
                    j -= k
                    break
            else:
                out.append(0)
                j -= 1
        return out[::-1]


    def encoder(self, mode: str) -> Remembered:
        """By piece, the bytes of its ids and that of the space after it."""
        if mode not in self.encoders:
            run, space = getattr(self, mode), array("q", [self.ids.get((" ",), 0)]).tobytes()
            self.encoders[mode] = Remembered(lambda p: array("q", run(cut(p))).tobytes() + space)
        return self.encoders[mode]

    def spelled(self) -> tuple[np.ndarray, pa.Array]:
        """Ids in order, and their tokens with an empty one for what is unknown at the end."""
        if self.spelling is None:
            ids = sorted(self.tokens)
            self.spelling = np.array(ids, np.int64), pa.array([*(self.tokens[i] for i in ids), ""], pa.string())
        return self.spelling

    def shared(self):
        """Sent once to every worker; what a worker remembers stays with it."""
        if self.sent is None:
            self.sent = SparkSession.getActiveSession().sparkContext.broadcast(self)
        return self.sent

    def __getstate__(self):
        return self.__dict__ | {"encoders": {}, "spelling": None, "sent": None}


def load(vocab: DataFrame, most: int = 2_000_000) -> Vocabulary:
    """From ``token, token_id``; a vocabulary is bounded, which is checked."""
    small_batches(vocab.sparkSession)
    rows = vocab.select("token", syllabify(F.col("token")).alias("s"), "token_id").limit(most + 1).toArrow().to_pylist()
    if len(rows) > most:
        raise ValueError(f"a vocabulary of more than {most} tokens isn't broadcast")
    return Vocabulary([(tuple(r["s"]), r["token_id"]) for r in rows], {r["token_id"]: r["token"] for r in rows})


def encode(text: Column, vocab: Vocabulary, mode: str = "ltr") -> Column:
    """Ids of a text. No token of several syllables has a space in it, so that pieces between spaces stand for themselves; if one has, texts are encoded whole."""
    shared = vocab.shared()

    @F.arrow_udf("array<long>")
    def run(text: pa.Array) -> pa.Array:
        v = shared.value
        if v.apart:
            of = v.encoder(mode).__getitem__
            parts = [b"".join(map(of, t.split(b" ")))[:-8] if t else b"" for t in texts(text)]
        else:
            parts = [array("q", getattr(v, mode)(cut(t))).tobytes() if t else b"" for t in texts(text)]
        ends = np.cumsum([0, *map(len, parts)]) // 8
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int64)))

    return run(text)


def decoded(ids: Column, vocab: Vocabulary) -> Column:
    """The tokens of an id array, joined; nothing for what is unknown."""
    shared = vocab.shared()

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        known, tokens = shared.value.spelled()
        flat = pc.fill_null(ids.flatten(), 0).to_numpy()
        at = np.searchsorted(known, flat)
        at[at < len(known)] = np.where(known[at[at < len(known)]] == flat[at < len(known)], at[at < len(known)], len(known))
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_numpy()])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens.take(pa.array(at))), "")

    return run(ids)


def decode(rows: DataFrame, vocab: DataFrame | Vocabulary, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key, text`` of the id arrays that aren't empty; ``vocab`` is loaded, or ``token, token_id``."""
    v = vocab if isinstance(vocab, Vocabulary) else load(vocab)
    return rows.where(F.size(ids) > 0).select(key, decoded(F.col(ids), v).alias("text"))
