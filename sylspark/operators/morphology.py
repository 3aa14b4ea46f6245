"""Affixes, roots and decomposition from word statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_rows


def word_counts(docs: DataFrame, least: int = 1) -> DataFrame:
    """``word, freq`` of words of three letters or more, apostrophes dropped."""
    w = word_rows(docs).select(F.translate("word", "'", "").alias("word")).where("char_length(word) >= 3")
    return w.groupBy("word").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)


def _cuts(words: DataFrame, most: int) -> DataFrame:
    return words.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.char_length("word") - 1, F.lit(most)))))


def affixes(words: DataFrame, most: int = 5) -> DataFrame:
    """``side, affix, rest, freq``: every word cut after its first and before its last k letters."""
    x = _cuts(words, most)
    pre = x.select(F.lit("prefix").alias("side"), F.expr("substring(word, 1, k)").alias("affix"), F.expr("substring(word, k + 1)").alias("rest"), "freq")
    suf = x.select(F.lit("suffix").alias("side"), F.expr("right(word, k)").alias("affix"), F.expr("left(word, char_length(word) - k)").alias("rest"), "freq")
    return pre.unionByName(suf)


def affix_counts(words: DataFrame, most: int = 5) -> DataFrame:
    return affixes(words, most).groupBy("side", "affix").agg(F.sum("freq").alias("freq"), F.count("*").alias("types"))


def pmi(words: DataFrame, most: int = 3) -> DataFrame:
    """``affix, rest, pmi`` of prefixes with what follows them, 0 at least."""
    x = affixes(words, most).where("side = 'prefix'").groupBy("affix", "rest").agg(F.sum("freq").alias("n"))
    total = x.agg(F.sum("n").alias("total"))
    a = x.groupBy("affix").agg(F.sum("n").alias("na"))
    b = x.groupBy("rest").agg(F.sum("n").alias("nb"))
    j = x.join(a, "affix").join(b, "rest").crossJoin(F.broadcast(total))  # one row
    p = F.log2((F.col("n") / F.col("total")) / (F.col("na") / F.col("total") * (F.col("nb") / F.col("total")) + 1e-9))
    return j.select("affix", "rest", "n", F.greatest(p, F.lit(0.0)).alias("pmi"))


def branching(words: DataFrame, most: int = 6) -> DataFrame:
    """Suffixes with two or more different letters before them: ``suffix, letters, freq``."""
    x = _cuts(words, most).select(F.expr("right(word, k)").alias("suffix"), F.expr("substring(word, char_length(word) - k, 1)").alias("before"), "freq")
    return x.groupBy("suffix").agg(F.countDistinct("before").alias("letters"), F.sum("freq").alias("freq")).where("letters >= 2 and freq >= 2")


def root_votes(words: DataFrame, prefixes: DataFrame, most: int = 5) -> DataFrame:
    """``word, prefix, root``: the longest known prefix that leaves two letters is taken off; votes are the root's words."""
    x = _cuts(words, most).where("char_length(word) - k >= 2").select("word", "freq", "k", F.expr("substring(word, 1, k)").alias("prefix"))
    met = x.join(F.broadcast(prefixes.select("prefix")), "prefix")  # affixes are bounded by their length and frequency
    best = met.groupBy("word", "freq").agg(F.max_by("prefix", "k").alias("prefix"))
    rooted = best.withColumn("root", F.expr("substring(word, char_length(prefix) + 1)"))
    return rooted.groupBy("root").agg(F.count("*").alias("votes"), F.sum("freq").alias("freq"))


def decompose(words: DataFrame, roots: DataFrame, least: int = 2, longest: int = 12) -> DataFrame:
    """``word, prefix, root, suffix, score``: the best root that a word contains; words without one stay whole.

    Instead of comparing every word with every root, the words' substrings are joined with the roots by equality.
    Scores: root length to the power 2.5, more for an empty side; ties to the longer, then the leftmost root.
    """
    n = F.char_length("word")
    cut = words.select("word", F.explode(F.sequence(F.lit(1), n)).alias("i")).withColumn("len", F.explode(F.sequence(F.lit(least), F.lit(longest)))).where(F.col("i") + F.col("len") - 1 <= n)
    cut = cut.withColumn("root", F.expr("substring(word, i, len)")).join(roots.select("root").distinct(), "root")
    factor = F.when(F.col("i") == 1, 1.5).otherwise(1.0) * F.when(F.col("i") + F.col("len") - 1 == n, 1.5).otherwise(1.0)
    score = F.pow(F.col("len").cast("double"), F.lit(2.5)) * factor
    top = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), F.desc("len"), "i"))
    best = cut.withColumn("score", score).withColumn("n", top).where("n = 1").select("word", "i", "len", "root", "score")
    x = words.select("word").join(best, "word", "left")
    return x.select(
        "word", F.expr("coalesce(substring(word, 1, i - 1), '')").alias("prefix"), F.expr("coalesce(root, word)").alias("root"), F.expr("coalesce(substring(word, i + len), '')").alias("suffix"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def confidence(score: Column) -> Column:
    return 1 / (1 + F.exp(-score / 20))
