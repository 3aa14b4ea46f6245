"""SentencePiece encoding and decoding by streaming Viterbi.

The encoder goes over a text once and keeps, for every position of a window no longer than the longest piece,
the surviving piece that ends there and a back-pointer to where it begins. Whenever all back-pointer paths from
the window meet in one boundary, the ids before it are committed and forgotten, so memory doesn't follow the text.
A word's first character begins no longer piece of the word before, so that all paths meet there: what is committed
from there to the next word is remembered by the word.

For unigram models the survivor is the piece of the largest summed score. For BPE models, whose merges aren't a
best sum, it is the only piece that the merges can leave at the end of that prefix: one that forms, with the
survivor before it, a pair that the merges keep apart. Prefixes of a merged text are merged alike, so there is
exactly one, and the ids are those of the merges.
"""

from __future__ import annotations

import re
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, strings

SPACE = "▁"
CACHE = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model, by text: id and score. ``kind`` is ``bpe`` or ``unigram``."""

    def __init__(self, scores: dict[str, tuple[int, float]], unknown: int, byte_ids: list[int] | None, kind: str, prefix: bool = True, texts: list[str] | None = None):
        self.scores, self.unknown, self.byte_ids, self.kind, self.prefix = scores, unknown, byte_ids, kind, prefix
        self.longest = max(map(len, scores), default=1)
        self.texts = texts or []
        self._apart: dict[tuple[str, str], bool] = {}
        self._words: dict[str, bytes] = {}
        self._plain: dict[int, str] | None = None
        self._starts: dict[str, bool] | None = None
        #: whether pieces never go on past a space, so that every space is a boundary of all paths
        self.cut = all(SPACE not in x.lstrip(SPACE) for x in scores)

    @classmethod
    def load(cls, path: str | None = None) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path or default_path())
        n = sp.get_piece_size()
        scores = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        by = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        bytes_ = [by[f"<0x{b:02X}>"] for b in range(256)] if len(by) == 256 else None
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto())
        kind = {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]
        return cls(scores, sp.unk_id(), bytes_, kind, proto.normalizer_spec.add_dummy_prefix, [sp.id_to_piece(i) for i in range(n)])

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves of a short text: best score first, leftmost on ties."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                found = self.scores.get(parts[i] + parts[i + 1])
                if found and (best is None or found[1] > best[0]):
                    best = (found[1], i)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def apart(self, a: str, b: str) -> bool:
        found = self._apart.get((a, b))
        if found is None:
            if len(self._apart) > CACHE:
                self._apart.clear()
            self._apart[a, b] = found = self.merged(a + b) == [a, b]
        return found

    def stream(self, text: str):
        """Pieces of normalised ``text``, committed as soon as all surviving paths go through one boundary.

        ``open_`` has the boundaries in the window from which the characters since could begin a piece that is longer;
        only paths through these, or through the last boundary, survive. The window is no longer than the longest piece.
        """
        if self._starts is None:
            alone = {x for x in self.scores if self.kind == "unigram" or len(x) == 1 or self.merged(x) == [x]}
            self._starts = {x[:k]: False for x in self.scores for k in range(1, len(x))} | {x: x in alone for x in self.scores}
        starts, apart, scores, bpe, most = self._starts, self._apart, self.scores, self.kind == "bpe", 2 * self.longest
        start = 0  # everything before is committed
        last: list[str | None] = [""]  # from start on: the surviving piece that ends at a position
        sums = [0.0]
        open_: list[int] = []
        for end in range(1, len(text) + 1):
            if last[-1] is not None:
                open_.append(end - 1)
            live, chosen, total = [], None, 0.0
            for b in open_:
                x = text[b:end]
                whole = starts.get(x)
                if whole is None:
                    continue
                live.append(b)
                if not whole or bpe and chosen is not None:
                    continue
                if bpe:
                    before = last[b - start]
                    if before:
                        ok = apart.get((before, x))
                        if not (self.apart(before, x) if ok is None else ok):
                            continue
                    chosen = x
                else:
                    score = sums[b - start] + scores[x][1]
                    if chosen is None or score > total:
                        chosen, total = x, score
            if chosen is None and last[-1] is not None:  # a character that no piece has alone
                before = last[-1]
                if not (bpe and before and live) or self.apart(before, text[end - 1]):
                    chosen, total = text[end - 1], (0.0 if bpe else sums[-1]) - 1e4
                    if not live:
                        live = [end - 1]
            last.append(chosen)
            if not bpe:
                sums.append(total)
            open_ = live
            if open_ and open_[0] > start and (len(open_) == 1 or end - start > most):
                meet = open_[0] if len(open_) == 1 else self._meet(last, start, open_)
                if meet > start:
                    yield from self._back(last, start, meet)
                    last, sums, start = last[meet - start :], sums[meet - start :], meet
        if text:
            yield from self._back(last, start, len(text))

    @staticmethod
    def _back(last: list[str | None], start: int, at: int) -> list[str]:
        out = []
        while at > start:
            out.append(last[at - start])
            at -= len(out[-1])
        return out[::-1]

    @staticmethod
    def _meet(last: list[str | None], start: int, live: list[int]) -> int:
        """The last boundary that the paths to all of ``live`` go through."""
        paths = set(live)
        while len(paths) > 1:
            top = max(paths)
            paths.remove(top)
            paths.add(top - len(last[top - start]))
        return paths.pop()

    def _ids(self, pieces) -> bytes:
        out = array("I")
        for x in pieces:
            found = self.scores.get(x)
            if found:
                out.append(found[0])
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in x.encode("utf-8", "replace"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit bytes; spaces as ``SPACE``, one put in front."""
        if not text:
            return b""
        words = self._words
        if len(words) > CACHE:
            words.clear()
        if not self.cut or "  " in text or text[0] == " " or SPACE in text:
            x = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
            return b"".join(self._ids(self.stream(c)) for c in (self._runs(x) if self.cut else [x]))
        # without double spaces every word is committed at the next one, so words can be remembered
        out = []
        for w in text.split(" "):
            found = words.get(w)
            if found is None:
                words[w] = found = self._ids(self.stream(SPACE + w))
            out.append(found)
        return b"".join(out)

    @staticmethod
    def _runs(x: str) -> list[str]:
        return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", x)

    def decode(self, ids) -> str:
        """Text of ids: bytes joined, ``SPACE`` as space, the one in front dropped."""
        if self._plain is None:
            of_bytes = set(self.byte_ids or ())
            self._plain = {i: x.replace(SPACE, " ") for i, x in enumerate(self.texts) if i not in of_bytes}
        plain = self._plain
        try:
            text = "".join([plain[i] for i in ids])
            return text[1:] if self.prefix and text.startswith(" ") else text
        except KeyError:  # bytes among them
            pass
        out, held = [], bytearray()
        back = {i: b for b, i in enumerate(self.byte_ids)} if self.byte_ids else {}
        for i in ids:
            if i in back:
                held.append(back[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(plain[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if self.prefix and text.startswith(" ") else text


_LOADED: dict[str, Pieces] = {}


def loaded(path: str | None = None) -> Pieces:
    """One model a Python worker."""
    key = path or ""
    if key not in _LOADED:
        _LOADED[key] = Pieces.load(path)
    return _LOADED[key]


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True, check: bool = False) -> DataFrame:
    """``doc_id, n_ids, ids_crc32`` (``ids``, and with ``check`` whether they decode to the text, ``restored``) of every whole text of ``docs(doc_id, text)``.

    Null and empty texts have no ids; repeated rows and null ids are rows of their own; an empty table gives no
    rows; other columns are not read. One pass, no shuffle.
    """

    def run(batches):
        model = loaded(path)
        for batch in batches:
            texts = strings(batch.column(1))
            data = [model.encode(x) for x in texts]
            out = [batch.column(0), pa.array([len(d) // 4 for d in data], pa.int64()), pa.array([zlib.crc32(d) for d in data], pa.int64())]
            if with_ids:
                ends = [0]
                for d in data:
                    ends.append(ends[-1] + len(d) // 4)
                flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(data))])
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
            if check:
                out.append(pa.array([model.decode(array("I", d)) == x for d, x in zip(data, texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_ids", "ids_crc32"] + ["ids"] * with_ids + ["restored"] * check)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long" + ", ids array<int>" * with_ids + ", restored boolean" * check)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded(ids)`` with the column ``text``; null ids decode to null, other columns stay."""
    names = encoded.columns
    at = names.index("ids")

    def run(batches):
        model = loaded(path)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "text"])

    return encoded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", text string")
