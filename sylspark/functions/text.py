"""Characters, words and syllables as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _any(letters: str) -> str:
    return "[" + letters + letters.upper() + "]"


_V = "(?:" + "|".join(f"{_any(v)}{_any(v)}?" for v in "aeiou") + ")"
_N, _M, _W, _Y = (_any(c) for c in "nmwy")
_CORE = "bcdfghjklpqrstvz"
_AFTER = _any("bcdhgjklqrstz")


def _twice(letters: str) -> str:
    return "(?:" + "|".join(x for c in letters for x in (c + c, (c + c).upper())) + ")"


#: One ordered alternation: the first that matches is the next syllable, else one code point.
SYLLABLE = "(?s)" + "|".join(
    [f"{_N}{_N}{_Y}{_V}", f"{_N}{_N}{_Y}{_W}{_V}", f"{_N}{_N}{_W}{_V}", f"{_N}{_N}{_V}", f"{_N}{_Y}{_V}", f"{_N}{_Y}{_W}{_V}", f"{_N}{_AFTER}{_W}{_V}", f"{_N}{_any('bdgkt')}{_Y}{_V}", f"{_N}{_AFTER}{_V}", f"{_N}{_V}"]
    + [f"{_M}{_M}{_any('wy')}{_V}", f"{_M}{_M}{_V}", f"{_M}{_AFTER}{_W}{_V}", f"{_M}{_any('bdgkt')}{_Y}{_V}", f"{_M}{_AFTER}{_V}", f"{_M}{_V}", f"{_any('wy')}{_V}"]
    + [f"{_twice('bdgkpst')}{_W}{_V}", f"{_twice('bdgkpt')}{_Y}{_V}", f"{_twice(_CORE)}{_V}"]
    + [f"{_any(_CORE)}{_W}{_V}", f"{_any('bdfghklpqrstvz')}{_Y}{_V}", f"{_any(_CORE)}{_V}", _V, "."]
)
WORD = r"[\p{L}\p{N}_']+"
LINE_END = "\r\n|\n|\r"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def syllabify(text: Column) -> Column:
    """Array of syllables, in lower case but for single characters that are no vowel; joined they are as long as the text."""
    return F.transform(F.regexp_extract_all(text, F.lit(SYLLABLE), 0), lambda s: F.when(s.rlike("[aeiouAEIOU]"), ascii_lower(s)).otherwise(s))


def syllables(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, pos, syl`` of every syllable."""
    return docs.select(key, F.posexplode(syllabify(F.col(text))).alias("pos", "syl"))


def syllable_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``syl, freq``: pieces between spaces are counted first, and each distinct one is cut once."""
    from ..operators.pieces import syllable_counts

    return syllable_counts(docs, text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def word_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, pos, word`` in lower case."""
    return docs.select(key, F.posexplode(words(F.lower(F.col(text)))).alias("pos", "word"))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line_no, line`` of the lines that aren't empty."""
    return docs.select(key, F.posexplode(F.split(F.col(text), LINE_END)).alias("line_no", "line")).where("line <> ''")


def clean_line(line: Column) -> Column:
    """Without what follows the first ``#`` or ``;``, and without white space at the end."""
    return F.regexp_replace(F.regexp_replace(line, "[#;][^\n]*", ""), r"[ \t\r\n\f\x0B]+$", "")


def graphemes(text: Column) -> Column:
    """Extended grapheme clusters."""
    return F.regexp_extract_all(text, F.lit(r"\X"), 0)


def fold(text: Column) -> Column:
    """Latin for Cyrillic look-alikes, and base vowels for toned ones."""
    return F.translate(text, "оаекмнрстухОАЕКМНРСТУХáéíóúàèìòùâêîôû", "oaekmhpctyxOAEKMHPCTYXaeiouaeiouaeiou")


def confusable(text: Column) -> Column:
    return text.rlike("[\\x{0370}-\\x{03FF}\\x{0400}-\\x{04FF}]")


#: Bits of ``char_class``.
CLASSES = {"letter": r"\p{L}", "mark": r"\p{M}", "digit": r"\p{N}", "punct": r"\p{P}", "symbol": r"\p{S}", "space": r"[\p{Z}\t\n\r]"}


def char_counts(text: Column) -> list[Column]:
    return [F.regexp_count(text, F.lit(p)).cast("long").alias(f"n_{k}") for k, p in CLASSES.items()]


def quantise(x: Column, bits: int = 8) -> Column:
    """Fixed point with so many fraction bits, saturating at 16 bits signed."""
    scaled = F.floor(x * float(1 << bits) + 0.5)
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), scaled)).cast("int")


def log_quantise(w: Column) -> Column:
    """``(log2 w + 32) * 1024`` from 0 to 65535; 0 for what isn't positive."""
    return F.when(w > 0, F.greatest(F.lit(0), F.least(F.lit(65535), F.floor((F.log2(w) + 32) * 1024)))).otherwise(F.lit(0)).cast("int")
