"""Pair grammars: counting, one rewrite, training, pruning, expansion, vocabularies."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 32_768


def pair_counts(seq: DataFrame, key: str = "doc_id", pos: str = "pos", sym: str = "sym", locked: str | None = None) -> DataFrame:
    """``l, r, freq`` of neighbours in order; overlaps count; a boundary whose left symbol is ``locked`` doesn't."""
    after = F.lead(sym).over(Window.partitionBy(key).orderBy(pos))
    pairs = seq.select(F.col(sym).alias("l"), after.alias("r"), *( [F.col(locked).alias("locked")] if locked else []))
    if locked:
        pairs = pairs.where(~F.col("locked"))
    return pairs.where("r is not null").groupBy("l", "r").agg(F.count("*").alias("freq"))


def array_pair_counts(seq: DataFrame, column: str) -> DataFrame:
    """The same over an array column, without a window: pairs of a row are made where the row is."""
    a = F.col(column)
    pair = F.arrays_zip(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))).alias("l"), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))).alias("r"))
    return seq.select(F.explode(pair).alias("p")).select("p.l", "p.r").groupBy("l", "r").agg(F.count("*").alias("freq"))


def text_pair_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``l, r, freq`` of neighbouring syllables: pieces between spaces are counted first, and each distinct one is cut once.

    What is asked of the counts is asked of them alone; were symbols cut in Spark, a filter on them would be moved to the texts.
    """
    from .pieces import pair_counts

    return pair_counts(docs, text)


def symbols_and_pairs(docs: DataFrame, pairs: Column, text: str = "text") -> DataFrame:
    """``token, ord``: syllables (0) and what is written together of the pairs ``l, r, freq`` that are asked for (1), by one walk over the texts."""
    from .pieces import counts

    single = F.col("r").isNull()
    token = F.when(single, F.col("l")).when(pairs, F.concat("l", "r"))
    return counts(docs, text).select(token.alias("token"), F.when(single, 0).otherwise(1).alias("ord")).where("token is not null")


def best_pairs(pairs: DataFrame, k: int = 1) -> DataFrame:
    """Most frequent first; ties to the larger left, then the larger right symbol."""
    return pairs.orderBy(F.desc("freq"), F.desc("l"), F.desc("r")).limit(k)


def replace_once(seq: DataFrame, left, right, new, key: str = "doc_id", pos: str = "pos", sym: str = "sym") -> DataFrame:
    """Leftmost non-overlapping occurrences of (left, right) become ``new``; ``key, pos, sym`` with old positions."""
    by = Window.partitionBy(key).orderBy(pos)
    x = seq.select(key, pos, sym).withColumn("m", F.coalesce((F.col(sym) == left) & (F.lead(sym).over(by) == right), F.lit(False)))
    run = F.col(pos) - F.sum(F.col("m").cast("int")).over(by)
    nth = F.row_number().over(Window.partitionBy(key, "run", "m").orderBy(pos))
    start = F.col("m") & ((nth % 2 == 1) if left == right else F.lit(True))
    x = x.withColumn("run", run).withColumn("start", start)
    x = x.withColumn("gone", F.coalesce(F.lag("start").over(by), F.lit(False)))
    return x.where("not gone").select(key, pos, F.when(F.col("start"), F.lit(new)).otherwise(F.col(sym)).alias(sym))


def text_replaced(docs: DataFrame, left: str, right: str, new: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n, replaced``: syllables of a text after ``replace_once``, and how many of them are ``new``; by the pieces between spaces, unless a space is replaced."""
    from .pieces import sums

    def measure(s):
        out = _rewritten(s, left, right, new)
        return len(out), out.count(new)

    return sums(docs, measure, ["n", "replaced"], " " not in (left, right), key, text)


def repair(sequences: list[tuple[list[str], int]], least: int = 3, max_rules: int = LIMIT, max_depth: int = 128, depth: dict[str, int] | None = None, known: set[str] | None = None) -> list[tuple[str, str, int]]:
    """(left, right, frequency) of the rules in order, over weighted sequences; a rule's symbol is its expansion.

    Pairs are counted once and kept up to date where a rewrite touches them; the heap holds the largest
    frequency, ties to the larger left, then the larger right symbol. ``depth`` has the depths of symbols of earlier
    rules and gets those of new ones. With ``known`` symbols, the first rule whose symbol is known already is the last.
    """
    seqs = [list(s) for s, _ in sequences]
    weight = [w for _, w in sequences]
    count: dict = defaultdict(int)
    where: dict = defaultdict(set)
    for k, s in enumerate(seqs):
        for p in zip(s, s[1:]):
            count[p] += weight[k]
            where[p].add(k)

    class Key(tuple):
        def __lt__(self, other):
            return tuple.__gt__(self, other)

    heap = [Key((n, *p)) for p, n in count.items()]
    heapq.heapify(heap)
    depth = {} if depth is None else depth
    rules = []
    while heap and len(rules) < max_rules:
        n, a, b = heapq.heappop(heap)
        p = (a, b)
        if count.get(p, 0) != n:
            continue
        if n < least:
            break
        d = 1 + max(depth.get(a, 0), depth.get(b, 0))
        if d > max_depth:
            count[p] = 0
            continue
        new = a + b
        depth.setdefault(new, d)
        rules.append((a, b, n))
        if known is not None:
            if new in known:
                break
            known.add(new)
        changed = set()
        for k in where.pop(p):
            s, w = seqs[k], weight[k]
            for q in zip(s, s[1:]):
                count[q] -= w
                changed.add(q)
            out = _rewritten(s, a, b, new)
            seqs[k] = out
            for q in zip(out, out[1:]):
                count[q] += w
                where[q].add(k)
                changed.add(q)
        for q in changed:
            if count[q] > 0:
                heapq.heappush(heap, Key((count[q], *q)))
    return rules


def _rewritten(s: list[str], a: str, b: str, new: str) -> list[str]:
    out, i = [], 0
    while i < len(s):
        if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
            out.append(new)
            i += 2
        else:
            out.append(s[i])
            i += 1
    return out


def _applied(s: list[str], order: dict[tuple[str, str], int]) -> list[str]:
    """``s`` after the rules in their order."""
    last = -1
    while len(s) > 1:
        at = [k for p in zip(s, s[1:]) if (k := order.get(p, -1)) > last]
        if not at:
            break
        last = min(at)
        a, b = next(p for p in zip(s, s[1:]) if order.get(p) == last)
        s = _rewritten(s, a, b, a + b)
    return s


#: Distinct pieces of words that the driver trains on in one round.
PIECES = 150_000


def train(docs: DataFrame, text: str = "text", least: int = 3, max_rules: int = LIMIT, max_depth: int = 128, pieces: int | None = None) -> DataFrame:
    """``rule_id, l, r, freq``: Re-Pair over the corpus, with white space as a locked boundary.

    The corpus is reduced to its distinct words with their counts, which is all that rules inside words depend on; these
    stay in partitions. Every round takes the rules down to a frequency: a pair that is rarer has no part in them, as
    rewrites only lower counts, so words fall apart at such pairs, equal pieces add up, and the driver trains on the
    pieces. The frequency is chosen so that there are ``pieces`` of them or fewer, if more than the most frequent pairs are
    asked for. A rule whose symbol was there before raises counts, and ends its round. Then the rules are applied to all words.
    The rules are those of ``repair`` over all words. A word moves as one string, its symbols with a space between: none has one in it.
    """
    from .graph import _written as materialise
    from .pieces import word_counts

    spark = docs.sparkSession
    pieces = pieces or PIECES
    seq = materialise(word_counts(docs, text), "words")
    known = {r[0] for r in seq.select(F.explode(F.split("s", " ")).alias("y")).where("char_length(y) > 1").distinct().collect()}  # syllables: bounded by their patterns
    rules: list[tuple[str, str, int]] = []
    depth: dict[str, int] = {}
    width = 2048
    while len(rules) < max_rules:
        last = F.size("s") - 1
        zipped = F.arrays_zip(F.slice("s", 1, last).alias("l"), F.slice("s", F.lit(2), last).alias("r"))
        pairs = materialise(seq.select(F.split("s", " ").alias("s"), "n").select(F.explode(zipped).alias("p"), "n").groupBy("p.l", "p.r").agg(F.sum("n").alias("freq")).where(F.col("freq") >= least), "pairs")

        def top(k):
            found = [r for r in pairs.orderBy(F.desc("freq")).limit(k + 1 + deep).collect()]
            return [r for r in found if 1 + max(depth.get(r.l, 0), depth.get(r.r, 0)) <= max_depth], len(found) <= k + deep

        deepest = [y for y, d in depth.items() if d >= max_depth]
        deep = pairs.where(F.col("l").isin(deepest) | F.col("r").isin(deepest)).count() if deepest else 0
        while True:
            found, whole = top(width)
            if not found:
                return _ruled(spark, rules)
            freqs = [r.freq for r in found]
            level = least if whole else min(freqs[-1] + 1, freqs[0])
            kept = {(r.l, r.r) for r in found if r.freq >= level} if level > freqs[-1] or whole else {(r.l, r.r) for r in pairs.where(F.col("freq") >= level).collect()}
            cut = materialise(_pieces(seq, spark.sparkContext.broadcast(kept)), "pieces")
            n = cut.count()
            if n <= pieces or level >= freqs[0]:
                break
            width = max(1, min(width, len(found)) // 2)
        if n < pieces // 3:
            width *= 2
        new = repair([(r.s.split(" "), int(r.n)) for r in cut.toLocalIterator()], level, max_rules - len(rules), max_depth, depth, known)
        rules += new
        if len(rules) >= max_rules:
            break
        seq = materialise(_reduced(seq, spark.sparkContext.broadcast({(a, b): k for k, (a, b, _) in enumerate(new)})).groupBy("s").agg(F.sum("n").alias("n")), "words")
    return _ruled(spark, rules)


def _ruled(spark, rules: list[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], "rule_id long, l string, r string, freq long")


def _pieces(seq: DataFrame, shared) -> DataFrame:
    """``s, n``: the longest runs of pairs of the shared set, and how often they are there."""

    def run(batches):
        kept = shared.value
        for batch in batches:
            found: dict[str, int] = defaultdict(int)
            for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s, at = s.split(" "), 0
                for i in range(1, len(s) + 1):
                    if i == len(s) or (s[i - 1], s[i]) not in kept:
                        if i - at > 1:
                            found[" ".join(s[at:i])] += n
                        at = i
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["s", "n"])

    return seq.mapInArrow(run, "s string, n long").groupBy("s").agg(F.sum("n").alias("n"))


def _reduced(seq: DataFrame, shared) -> DataFrame:
    """The sequences after the shared rules; those of one symbol have no pair any more."""

    def run(batches):
        order = shared.value
        for batch in batches:
            done = [(_applied(s.split(" "), order), n) for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            done = [x for x in done if len(x[0]) > 1]
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(s) for s, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["s", "n"])

    return seq.mapInArrow(run, "s string, n long")


def effective(rules: DataFrame, id_: str = "rule_id", left: str = "l", right: str = "r") -> DataFrame:
    """``rules`` with ``eff_freq``: the frequency less that of the rules that use it, 0 at least, and ``dead``."""
    used = rules.select(F.explode(F.array(left, right)).alias("child"), "freq").groupBy("child").agg(F.sum("freq").alias("inside"))
    x = rules.join(used, rules[id_] == used["child"], "left").drop("child")
    x = x.withColumn("eff_freq", F.greatest(F.col("freq") - F.coalesce("inside", F.lit(0)), F.lit(0)).cast("long")).drop("inside")
    return x.withColumn("dead", F.col("eff_freq") < 3)


def vocabulary(*sources: DataFrame) -> DataFrame:
    """``token, kind, token_id``: sources ``token, ord`` in order of priority; the first of equal tokens stays; ids are dense."""
    every = None
    for k, s in enumerate(sources):
        own = s.select("token", F.col("ord").cast("long").alias("ord"), F.lit(k).alias("kind"))
        every = own if every is None else every.unionByName(own)
    first = every.where("token not like '%[UNK]%' and token <> ''").groupBy("token").agg(F.min(F.struct("kind", "ord")).alias("f"))
    return first.select("token", F.col("f.kind").alias("kind"), F.col("f.ord").alias("ord"))


def compress(seq: Column, rules: dict[tuple[str, str], str]) -> Column:
    """Eager stack reduction, left to right, over an array column."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            stack: list[str] = []
            for y in x if x is not None else ():
                stack.append(y)
                while len(stack) > 1 and (stack[-2], stack[-1]) in rules:
                    b, a = stack.pop(), stack.pop()
                    stack.append(rules[a, b])
            return stack

        return s.map(one)

    return run(seq)
