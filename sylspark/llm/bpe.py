"""Byte-level BPE ids with caches of the ids of words, for whole texts."""

from __future__ import annotations

import os
import re
from array import array
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The byte-level pre-tokeniser's pattern; the files' own library agrees with it.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same pattern for the standard library, which is faster; equal on texts without characters of _ODD.
SIMPLE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters on whose class two Unicode tables could differ, or that the simple pattern would put elsewhere.
_ODD = re.compile("[^\x00-\x1b\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞]")
#: A space before white space, or at the end: there, words cannot be cut at spaces.
_WIDE = re.compile(r" (?:\s|$)")
#: A line end inside white space, or at the end of it and of the text: there, words cannot be cut before line ends.
_BLANK = re.compile(r"\s\n(?:\s|$)")
#: Words that may stand beside others in one text for the library.
_WORD = re.compile(r"\n?\S+").fullmatch
CACHE = 500_000
#: Ids that the words hold at most before the next batch.
IDS = 16_000_000
#: Words given to the library in one text.
TOGETHER = 200


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _part(word: str) -> str:
    """What a word is in its text: after a space; with a line end as it is; at the text's begin (marked by a space) as it is."""
    if word[:1] == " ":
        return word[1:]
    return word if word[:1] in ("", "\n") else " " + word


class Words:
    """Ids by word in one array, and how often a word was seen; ``at`` gives a word its place, new ones the next."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = defaultdict(count().__next__)
        self.used, self.ids = 0, np.empty(1 << 16, np.uint32)
        self.starts, self.lengths, self.seen = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def __len__(self) -> int:
        return len(self.at)

    def places(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """Places of ``words``, and those among them that are new."""
        n = len(self.at)
        places = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        if len(self.at) > len(self.starts):
            more = np.zeros(len(self.at), np.int64)
            self.starts, self.lengths, self.seen = (np.concatenate([x, more]) for x in (self.starts, self.lengths, self.seen))
        return places, list(islice(reversed(self.at), len(self.at) - n))

    def put(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used // 2 + len(ids), np.uint32)])
        places, _ = self.places(words)
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[places] = self.used + np.cumsum(lengths) - lengths
        self.lengths[places] = lengths
        self.used += len(ids)

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each has."""
        starts, lengths = self.starts[places], self.lengths[places]
        found = [np.empty(0, np.uint32)]
        for k in range(0, len(places), 100_000):  # what is made on the way is no larger for a long text
            some = lengths[k : k + 100_000]
            ends = np.cumsum(some)
            found.append(self.ids[np.repeat(starts[k : k + 100_000] - ends + some, some) + np.arange(ends[-1])])
        return np.concatenate(found), lengths

    def shrink(self) -> None:
        """Only words seen more than once since the last time stay; none if those are too many as well."""
        places = np.flatnonzero(self.seen > 1)
        ids, lengths = self.gather(places)
        names = list(self.at) if len(places) <= CACHE // 2 and len(ids) <= IDS // 2 else []
        self.clear()
        if names:
            self.put([names[i] for i in places.tolist()], ids, lengths)


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.

    Texts are cut at single spaces and before line ends, where the pattern always cuts too, and the ids of each
    different word of a batch are looked up. Words not seen yet are given to ``tokenizers`` many in one text, whose
    ids are taken apart by the bytes that they stand for. Texts with wider white space are cut by the pattern, and
    their pre-tokens are looked up; those with characters outside the Latin ranges go to the library as they are.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words = Words()
        self.tokens: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        #: how many bytes an id stands for: its string has one character for each
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for x, i in vocabulary.items():
            self.n_bytes[i] = len(x)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_tokens(self, tokens: set[str]) -> None:
        new = [x for x in tokens if x not in self.tokens]
        for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.tokens[x] = array("I", e.ids).tobytes()

    def _learn_alone(self, words: list[str], parts: list[str]) -> None:
        found = self._library(parts)
        if found:
            self.words.put(words, np.concatenate(found), np.array([len(x) for x in found]))

    def _learn_words(self, words: list[str]) -> None:
        """Words without a space before them have one in front here; those that begin a line have none."""
        alone = [x for x in words if not _WORD(x)]
        self._learn_alone(alone, [_part(x) for x in alone])
        if alone:
            words = [x for x in words if _WORD(x)]
        for start in range(0, len(words), TOGETHER):
            some = words[start : start + TOGETHER]
            parts = [_part(x) for x in some]
            ids = self._library(["".join(parts)])[0]
            ends = np.cumsum([len(x.encode()) for x in parts])
            own = np.cumsum(self.n_bytes[ids])
            cuts = np.searchsorted(own, ends)
            if own[-1] == ends[-1] and (own[cuts] == ends).all():
                self.words.put(some, ids, np.diff(cuts, prepend=-1))
            else:  # a file whose ids aren't bytes, or whose pre-tokeniser goes on past words
                self._learn_alone(some, parts)

    def _places(self, words: list[str]) -> np.ndarray:
        """Where words are; those not seen yet are learnt."""
        places, new = self.words.places(words)
        try:
            self._learn_words(new)
        except BaseException:  # else they would have a place without ids
            self.words.clear()
            raise
        return places

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that can be cut at spaces and line ends."""
        if len(self.words) > CACHE or self.words.used > IDS:
            self.words.shrink()
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        at = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        kinds = coded.indices.to_numpy()
        places = self._places(coded.dictionary.to_pylist())
        self.words.seen[places] += np.bincount(kinds, minlength=len(places))
        places = places[kinds]
        begin = [" " + x for x in lists.values.take(pa.array(at[:-1])).to_pylist()]  # no space is before them
        places[at[:-1]] = self._places(begin)
        ids, lengths = self.words.gather(places)
        data = memoryview(ids.tobytes())
        ends = 4 * np.concatenate([[0], np.cumsum(lengths)])[at]
        return [bytes(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if len(self.tokens) > CACHE:
            self.tokens.clear()
        plan, need_tokens, plain = [], set(), []
        for x in texts:
            if _ODD.search(x):
                plan.append((0, x))
            elif _WIDE.search(x) or "\n" in x and _BLANK.search(x):
                own = SIMPLE.findall(x)
                need_tokens.update(own)
                plan.append((1, own))
            else:
                plan.append((2, len(plain)))
                plain.append(x)
        self._learn_tokens(need_tokens)
        done = self._plain(plain) if plain else []
        tokens, out = self.tokens, []
        for kind, x in plan:
            if kind == 2:
                out.append(done[x])
            elif kind == 1:
                out.append(b"".join([tokens[t] for t in x]))
            else:
                out.append(array("I", self.tokenizer.encode_batch_fast([x], add_special_tokens=False)[0].ids).tobytes())
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder a Python worker."""
    key = path or ""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path)
    return _ENCODERS[key]


def chunks(texts: list[str], chars: int = 1_000_000):
    """Consecutive slices of about so many characters, one text at least."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= chars:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]
