"""Rule morphology, phonology, language identification, register."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .resources import COLLOQUIAL, FORMAL, LANGUAGE_HITS, NASALS, PREFIXES, SUBJECTS
from .text import ascii_lower

MORPH = "struct<prefix:string,stem:string,noun_class:int,plural:boolean,pos:string,confidence:double>"


def morph(word: Column) -> Column:
    """First noun or infinitive prefix that leaves two letters, else a subject marker that leaves three, else the whole."""
    w = F.regexp_replace(ascii_lower(word), "(?s)'.*$", "")
    out = None

    def row(prefix, cls, plural, pos, confidence):
        fields = (F.lit(prefix), F.substring(w, len(prefix or "") + 1, 1 << 30), F.lit(cls), F.lit(plural), F.lit(pos), F.lit(confidence))
        return F.struct(*(f.alias(n) for f, n in zip(fields, ("prefix", "stem", "noun_class", "plural", "pos", "confidence")))).cast(MORPH)

    for p, cls, plural, verb, confidence in PREFIXES:
        when = w.startswith(p) & (F.char_length(w) > len(p) + 1) & ~F.substring(w, len(p) + 1, 1).isin("-", " ")
        out = (F.when if out is None else out.when)(when, row(p, cls, plural, "verb" if verb else "noun", confidence))
    for k, m in enumerate(SUBJECTS):
        out = out.when(w.startswith(m) & (F.char_length(w) > len(m) + 2), row(m, k + 1, None, "verb", 0.55))
    return out.otherwise(row(None, None, None, None, 0.3))


def stem(word: Column, least: float = 0.7) -> Column:
    m = morph(word)
    return F.when(m["confidence"] >= least, m["stem"]).otherwise(F.regexp_replace(ascii_lower(word), "(?s)'.*$", ""))


def phonology(word: Column) -> Column:
    """Joined morphemes: i and u before another vowel become glides, o before a is rounded."""
    x = F.regexp_replace(word, "-", "")
    x = F.regexp_replace(x, "i([aeou])", "1$1")
    x = F.regexp_replace(x, "u([aeio1])", "2$1")
    x = F.regexp_replace(x, "o(a)", "2$1")
    return F.translate(x, "12", "yw")


def underlying(word: Column) -> Column:
    """Array of forms before nasal assimilation, longest cluster first."""
    forms = F.array().cast("array<string>")
    for cluster, (nasal, initials) in NASALS.items():
        own = F.array(*(F.concat(F.lit(f"{nasal}+{i}"), F.substring(word, len(cluster) + 1, 1 << 30)) for i in initials))
        forms = F.concat(forms, F.when(word.startswith(cluster), own).otherwise(F.array().cast("array<string>")))
    return forms


def language_hits(text: Column) -> dict[str, Column]:
    """Hits by language: words of a list, and words that begin as some do; a word can be both."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)

    def of(starts: str, listed: str) -> Column:
        n = F.size(F.filter(tokens, lambda w: w.isin(*listed.split())))
        return n + F.size(F.filter(tokens, lambda w: w.rlike(f"^(?:{starts.replace(' ', '|')})."))) if starts else n

    return {k: of(*v).cast("long") for k, v in LANGUAGE_HITS.items()}


def register(words: Column, text: Column) -> Column:
    """Formal words less colloquial ones and less up to five marks of emphasis."""
    formal = F.size(F.filter(words, lambda w: w.isin(*sorted(FORMAL))))
    casual = F.size(F.filter(words, lambda w: w.isin(*sorted(COLLOQUIAL))))
    return (formal - casual - F.least(F.lit(5), F.char_length(F.regexp_replace(text, "[^!?]", "")))).cast("long")
