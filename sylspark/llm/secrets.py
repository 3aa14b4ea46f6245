"""Secret scans: three base patterns, and dictionary-primed zstandard novelty for what they miss."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, strings, turn

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
#: A run that could be a key: long enough, and both letters and digits in it, or letters of changing case.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: What can be a value in a candidate: ``=`` is in it only as padding at the end.
PART = re.compile(r"[A-Za-z0-9+/_.-]+(?:=+(?![A-Za-z0-9+/_=.-]))?")
SENSITIVE = re.compile(r"(?i:passw|secret|token|api.?key|credential|private|bearer|auth|access|signature)", re.A)
#: Words that identifiers are made of; a string that they explain is no secret.
IDENTIFIERS = (
    "get set put post delete create update remove insert select where from import export return class public private protected static final const "
    "function lambda async await yield value values index count length size name names path file files user users group groups id ids key keys item "
    "items list map array string integer float double boolean true false null none config configuration setting settings option options parameter "
    "request response client server session cookie header headers body content type token secret password username database table column row query "
    "result results error exception message status code default example sample test http https www com org net index.html utf-8 localhost "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 12345678 2020-01-01 2021 2022 2023 2024 2025"
)
#: Characters on either side of a candidate that its novelty is measured against, and before it that must be sensitive.
AROUND, BEFORE = 400, 48
#: Share of the bytes of random text from which a candidate can't be told from it.
NOVELTY = 0.92
_DIGITS, _LOWER = string.digits, string.ascii_lowercase
#: Hexadecimal, base 32, 36, 62 and 64, and all that a candidate can have.
ALPHABETS = (_DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER + "234567", _LOWER.upper() + "234567", _DIGITS + _LOWER, _DIGITS + _LOWER.upper(), _DIGITS + string.ascii_letters, _DIGITS + string.ascii_letters + "+/", _DIGITS + string.ascii_letters + "-_", _DIGITS + string.ascii_letters + "+/_.-")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three base patterns, leftmost and non-overlapping per kind, in code points."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _cost(context: str, identifiers: str = IDENTIFIERS):
    """A function that gives the bytes a text adds to a zstandard frame primed with the identifiers and ``context``."""
    primer = zstandard.ZstdCompressionDict((identifiers + "\n" + context).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own = zstandard.ZstdCompressor(level=9, dict_data=primer, write_checksum=False, write_content_size=False, write_dict_id=False)
    empty = len(own.compress(b""))
    return lambda x: len(own.compress(x.encode())) - empty


def marginal_bytes(candidate: str, context: str, identifiers: str = IDENTIFIERS) -> int:
    """Bytes that ``candidate`` adds to a zstandard frame primed with the identifiers and the surrounding text."""
    return _cost(context, identifiers)(candidate)


@functools.lru_cache(maxsize=4096)
def _random(alphabet: str, length: int) -> tuple[str, ...]:
    return tuple("".join(random.Random(f"{alphabet}{length}{k}").choices(alphabet, k=length)) for k in range(3))


def _like(x: str) -> tuple[str, ...]:
    """Random texts of the length of ``x`` in the smallest of the alphabets that keys are written in that has its characters."""
    own = set(x.rstrip("="))
    return _random(next((a for a in ALPHABETS if own <= set(a)), ALPHABETS[-1]), len(x))


def _mixed(x: str) -> bool:
    """Whether letters change case as often as in random text, and not only for the first of a word."""
    upper = [c.isupper() for c in x if c.isalpha()]
    return sum(a != b for a, b in zip(upper, upper[1:])) >= 0.3 * len(x) and any(a and b for a, b in zip(upper, upper[1:])) and len(upper) >= 16


def is_novel(candidate: str, context: str, identifiers: str = IDENTIFIERS, novelty: float = NOVELTY) -> bool:
    """Whether a candidate costs what random text does: ``novelty`` of its length, or of what random text of its alphabet and length costs here.

    Other occurrences of the candidate in the context explain nothing and are left out.
    """
    cost = _cost(context.replace(candidate, " "), identifiers)
    own = cost(candidate)
    if own >= novelty * len(candidate):
        return True
    if own < 0.5 * novelty * len(candidate):  # no random text of 16 letters or more costs less
        return False
    return own >= novelty * sum(map(cost, _like(candidate))) / 3


def novel_spans(text: str, taken: list[tuple[int, int, str]], identifiers: str = IDENTIFIERS, novelty: float = NOVELTY) -> list[tuple[int, int, str]]:
    """Candidates in a sensitive context, outside ``taken``, that neither the text nor the dictionary compresses.

    In ``name=value`` the parts are judged, with the name as context; the whole only if no part of it is found.
    """

    def novel(start: int, end: int) -> bool:
        x = text[start:end]
        if end - start < 16 or not (any(c.isdigit() for c in x) and any(c.isalpha() for c in x) or _mixed(x)):
            return False
        if any(s < end and start < e for s, e, _ in taken) or not SENSITIVE.search(text, max(0, start - BEFORE), start):
            return False
        context = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
        return is_novel(x, context, identifiers, novelty)

    found = []
    for m in CANDIDATE.finditer(text):
        parts = [p.span() for p in PART.finditer(text, *m.span())] if "=" in m.group() else []
        own = [p for p in parts if p != m.span() and novel(*p)]
        found += [(*p, "novel") for p in own or [m.span()] * novel(*m.span())]
    return found


def spans(text: str | None, identifiers: str = IDENTIFIERS, novelty: float = NOVELTY) -> list[tuple[int, int, str]]:
    """All spans by start, then kind in the order of ``KINDS``."""
    base = base_spans(text or "")
    return sorted(base + novel_spans(text or "", base, identifiers, novelty), key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str, found: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    parts, at = [], 0
    for start, end, _ in sorted(found):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def scan(docs: DataFrame, identifiers: str = IDENTIFIERS, novelty: float = NOVELTY) -> DataFrame:
    """Secrets of every whole text of ``docs(doc_id, text)``.

    Returns ``doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans``; offsets are code points, ends
    exclusive. Null and empty texts have no span (the hash is that of the empty string); repeated rows and
    null ids are rows of their own; an empty table gives none; other columns are not read. One pass, no shuffle.
    """

    def run(batches):
        turn("secrets")
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            hashes, all_spans = [], []
            for text in strings(batch.column(1)):
                found = spans(text, identifiers, novelty)
                for k in KINDS:
                    counts[k].append(sum(1 for s in found if s[2] == k))
                hashes.append(hashlib.sha256(_joined([s for s in found if s[2] != "novel"]).encode()).hexdigest())
                all_spans.append(_joined(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(hashes, pa.string()), pa.array(all_spans, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redacted(docs: DataFrame, mark: str = "[secret]", identifiers: str = IDENTIFIERS, novelty: float = NOVELTY) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` and ``n_chars`` set anew where a text changed; all rows and columns stay.

    Null texts stay null, empty ones empty; repeated rows are rows of their own; of other columns only ``n_chars`` is
    touched, and only where the text changed; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches):
        turn("secrets")
        for batch in batches:
            at = names.index("text")
            old = batch.column(at).to_pylist()
            new = [x and (redact(x, s, mark) if (s := spans(x, identifiers, novelty)) else x) for x in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([n if a is b or a == b else len(b) for n, a, b in zip(batch.column(k).to_pylist(), old, new)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
