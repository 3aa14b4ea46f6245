"""Weighted transition graphs over token chains: edges, entropy, components, symbols, prediction."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..batches import small_batches
from .pieces import parts


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, chain, pos, token``: ASCII lower case, words and single punctuation; ``. ? !`` end a chain."""
    from ..functions.text import ascii_lower

    x = docs.select(key, F.posexplode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(r"[^\s!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]"), 0)).alias("pos", "token"))
    end = F.col("token").isin(".", "?", "!").cast("int")
    chain = F.coalesce(F.sum(end).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("chain", chain)


_TOKEN = re.compile(rb"[^\s!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]")


#: Bytes of tokens whose pairs are counted at once.
TOKENS = 32 << 20


def text_edges(docs: DataFrame, text: str = "text") -> DataFrame:
    """``edges`` of the chains of ``tokens``, made and first counted where the texts are: a token and the next, unless the first ends a chain."""
    small_batches(docs.sparkSession)

    def counted(tokens, stays):
        known = pa.concat_arrays(tokens).dictionary_encode()
        at, words, joined = known.indices.to_numpy().astype(np.int64), known.dictionary, np.concatenate(stays)
        if not len(at):
            return pa.RecordBatch.from_pydict({"src": [], "dst": [], "n": []}, pa.schema([("src", pa.string()), ("dst", pa.string()), ("n", pa.int64())]))
        pairs = (at[:-1] * len(words) + at[1:])[joined[:-1]]
        pairs, n = np.unique(pairs, return_counts=True)
        return pa.RecordBatch.from_arrays([words.take(pa.array(pairs // len(words))), words.take(pa.array(pairs % len(words))), pa.array(n, pa.int64())], ["src", "dst", "n"])

    def run(batches):
        ends, tokens, stays, size = pa.array([".", "?", "!"]), [], [], 0
        for batch in batches:
            for _, own in parts(batch):
                found = [_TOKEN.findall(t.lower()) for t in own]  # bytes: ASCII only
                tokens.append(pa.array([x for f in found for x in f], pa.binary()).cast(pa.string()))
                stay = ~pc.is_in(tokens[-1], ends).to_numpy(zero_copy_only=False)
                last = np.cumsum([len(f) for f in found]) - 1
                stay[last[last >= 0]] = False
                stays.append(stay)
                size += tokens[-1].nbytes
                if size > TOKENS:
                    yield counted(tokens, stays)
                    tokens, stays, size = [], [], 0
        if tokens:
            yield counted(tokens, stays)

    return docs.select(F.lit(0).alias("key"), text).mapInArrow(run, "src string, dst string, n long").groupBy("src", "dst").agg(F.sum("n").alias("weight"))


def edges(chain: DataFrame, keys: list[str], order: list[str], token: str = "token") -> DataFrame:
    """``src, dst, weight``: how often one token follows another in a chain."""
    after = F.lead(token).over(Window.partitionBy(*keys).orderBy(*order))
    return chain.select(F.col(token).alias("src"), after.alias("dst")).where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def cap_out_degree(e: DataFrame, k: int = 16) -> DataFrame:
    """The ``k`` heaviest edges of each source; ties to the smaller target."""
    n = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return e.withColumn("n", n).where(F.col("n") <= k).drop("n")


def with_priors(e: DataFrame, priors: DataFrame) -> DataFrame:
    return e.select("src", "dst", F.col("weight").cast("double")).unionByName(priors.select("src", "dst", F.col("weight").cast("double"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def gated(e: DataFrame) -> DataFrame:
    """Without edges to targets that begin or end with a stop or a comma."""
    return e.where(~F.col("dst").rlike("^[.,]|[.,]$"))


def entropy(e: DataFrame) -> DataFrame:
    """``node, degree, entropy`` in bits of each node's out-edges."""
    p = F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))
    return e.withColumn("p", p).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum(-F.col("p") * F.log2("p")).alias("entropy"))


def probabilities(e: DataFrame) -> DataFrame:
    return e.withColumn("p", F.col("weight") / F.sum("weight").over(Window.partitionBy("src")))


def ngram_prior(e: DataFrame, vocabulary: int | None = None, scale: float = 8.0) -> DataFrame:
    """``src, dst, weight``: ``scale * (1 + log2((f12 + .01) / (f1 + .01 V)))``, 0.1 at least."""
    f1 = F.sum("weight").over(Window.partitionBy("src"))
    v = F.lit(vocabulary) if vocabulary else F.col("v")
    x = e if vocabulary else e.crossJoin(F.broadcast(e.agg(F.countDistinct("src").alias("v"))))  # one row
    w = F.lit(scale) * (1 + F.log2((F.col("weight") + 0.01) / (f1 + 0.01 * v)))
    return x.select("src", "dst", F.greatest(w, F.lit(0.1)).alias("weight"))


def _written(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/sylspark-{spark.sparkContext.applicationId}"
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Edges that are finished on the driver instead of by further rounds.
LOCAL = 50_000


def components_of(pairs: list[tuple]) -> dict:
    """The smallest node of each node's strongly connected component, by two depth-first searches without recursion."""
    out: dict = {}
    back: dict = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b), out.setdefault(b, [])
        back.setdefault(b, []).append(a), back.setdefault(a, [])
    order, seen = [], set()
    for root in out:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(out[root]))]
        while stack:
            node, rest = stack[-1]
            nxt = next((y for y in rest if y not in seen), None)
            if nxt is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(out[nxt])))
    found: dict = {}
    for root in reversed(order):
        if root in found:
            continue
        found[root] = root
        members, todo = [root], [root]
        while todo:
            for y in back[todo.pop()]:
                if y not in found:
                    found[y] = root
                    members.append(y), todo.append(y)
        least = min(members)
        for y in members:
            found[y] = least
    return found


def strong_components(e: DataFrame, local: int | None = None) -> DataFrame:
    """``node, scc`` (the smallest node of the strongly connected component).

    Trimming of nodes without in- or out-edges, then colouring: the smallest reachable label forwards, and within a
    colour backwards from its root, until nothing is left or what is left has ``local`` edges at most, which the driver
    finishes. Tables are written between rounds, of which there may be as many as it takes.
    """
    local = LOCAL if local is None else local
    kind = e.schema["src"].dataType
    e = _written(e.where("weight > 0 and src <> dst").select("src", "dst").distinct(), "edges")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    done = None
    live = _written(nodes, "nodes")
    while True:
        while True:  # trim
            own = e.select(F.col("src").alias("node")).distinct().intersect(e.select(F.col("dst").alias("node")).distinct())
            single = live.join(own, "node", "left_anti")
            if single.isEmpty():
                break
            part = single.select("node", F.col("node").alias("scc"))
            done = part if done is None else done.union(part)
            live = _written(live.join(own, "node", "left_semi"), "nodes")
            e = _written(e.join(live.withColumnRenamed("node", "src"), "src", "left_semi").join(live.withColumnRenamed("node", "dst"), "dst", "left_semi"), "edges")
        if live.isEmpty():
            break
        rest = e.select("src", "dst").limit(local + 1).collect() if local else []
        if 0 < len(rest) <= local:  # every live node has an edge
            part = e.sparkSession.createDataFrame(list(components_of([tuple(r) for r in rest]).items()), StructType([StructField("node", kind), StructField("scc", kind)]))
            done = part if done is None else done.union(part)
            break
        colour = live.select("node", F.col("node").alias("c"))
        while True:  # smallest label that reaches a node
            step = e.join(colour, e["src"] == colour["node"]).select(F.col("dst").alias("node"), "c").groupBy("node").agg(F.min("c").alias("n"))
            new = _written(colour.join(step, "node", "left").select("node", F.least("c", F.coalesce("n", "c")).alias("c"), (F.coalesce("n", "c") < F.col("c")).alias("moved")), "colour")
            colour = new.select("node", "c")
            if new.where("moved").isEmpty():
                break
        found = colour.where("node = c")
        same = e.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        same = _written(same, "inside")
        while True:  # what reaches its colour's root
            back = same.join(found.select(F.col("node").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct()
            more = _written(back.join(found, ["node", "c"], "left_anti").select("node", "c"), "back")
            if more.isEmpty():
                break
            found = _written(found.union(more), "found")
        part = found.select("node", F.col("c").alias("scc"))
        done = part if done is None else done.union(part)
        live = _written(live.join(found, "node", "left_anti"), "nodes")
        e = _written(e.join(live.withColumnRenamed("node", "src"), "src", "left_semi").join(live.withColumnRenamed("node", "dst"), "dst", "left_semi"), "edges")
    return done if done is not None else nodes.select("node", F.col("node").alias("scc"))


def component_metrics(e: DataFrame, labels: DataFrame) -> DataFrame:
    """``scc, members, internal, external, coherence`` from labels ``node, scc``."""
    a, b = labels.select(F.col("node").alias("src"), F.col("scc").alias("s")), labels.select(F.col("node").alias("dst"), F.col("scc").alias("d"))
    x = e.join(a, "src").join(b, "dst")
    inside = x.groupBy(F.col("s").alias("scc")).agg(F.sum((F.col("s") == F.col("d")).cast("long")).alias("internal"), F.sum((F.col("s") != F.col("d")).cast("long")).alias("external"))
    m = labels.groupBy("scc").agg(F.count("*").alias("members")).join(inside, "scc", "left").na.fill(0, ["internal", "external"])
    n = F.col("internal") + F.col("external")
    return m.withColumn("coherence", F.when(n > 0, F.col("internal") / n).otherwise(F.lit(0.0)))


def candidates(m: DataFrame, least: float = 0.05, freq: str = "freq", min_freq: int = 5) -> DataFrame:
    return m.withColumn("rho", F.col("coherence") / (1 + F.log(F.col("members").cast("double")))).where((F.col("rho") >= least) & (F.col(freq) >= min_freq))


def promoted(m: DataFrame, epochs: int = 2, coherence: float = 0.01, bits: float = 5.0, min_freq: int = 5) -> DataFrame:
    c = F.when(F.col("members") == 1, F.lit(1.0)).otherwise(F.col("coherence"))
    return m.where((F.col("stable") >= epochs) & (c >= coherence) & (F.col("entropy") <= bits) & (F.col("freq") >= min_freq))


def stability(now: DataFrame, before: DataFrame) -> DataFrame:
    """``scc, stable``: one more if the number of members is what it was, else 0."""
    b = before.select("scc", F.col("members").alias("was"), F.col("stable").alias("had"))
    return now.join(b, "scc", "left").select("scc", "members", F.when(F.col("members") == F.col("was"), F.coalesce("had", F.lit(0)) + 1).otherwise(F.lit(0)).cast("long").alias("stable"))


def transitions(e: DataFrame, symbols: DataFrame) -> DataFrame:
    """``src_sym, dst_sym, weight`` between symbols ``node, symbol``."""
    a, b = symbols.select(F.col("node").alias("src"), F.col("symbol").alias("src_sym")), symbols.select(F.col("node").alias("dst"), F.col("symbol").alias("dst_sym"))
    return e.join(a, "src").join(b, "dst").where("src_sym <> dst_sym").groupBy("src_sym", "dst_sym").agg(F.sum("weight").alias("weight"))


def decay(q: Column, factor: float) -> Column:
    """A quantised log weight after a decay by ``factor``, 0 at least."""
    import math

    return F.greatest(q - round(abs(math.log2(factor)) * 1024), F.lit(0)).cast("int")


def two_hops(starts: DataFrame, e: DataFrame, width: int = 10, least: float = 2.0, k: int = 5) -> DataFrame:
    """``start, token, score``: the ``k`` best tokens one or two steps on, by summed log weights of the best path."""
    pruned = cap_out_degree(e.where(F.col("weight") >= least), width).withColumn("lw", F.log(F.col("weight").cast("double")))
    one = starts.join(pruned, starts["start"] == pruned["src"]).select("start", F.col("dst").alias("token"), F.col("lw").alias("score"))
    two = one.join(pruned, one["token"] == pruned["src"]).select("start", F.col("dst").alias("token"), (F.col("score") + F.col("lw")).alias("score"))
    best = one.union(two).groupBy("start", "token").agg(F.max("score").alias("score"))
    n = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("score"), "token"))
    return best.withColumn("rank", n).where(F.col("rank") <= k)


def activate(state: DataFrame, e: DataFrame, direct: float = 0.9, spread: float = 0.3, least: float = 0.01) -> DataFrame:
    """One step of spreading activation of ``node, a``: kept, passed on by weight, normalised, small ones dropped."""
    passed = state.join(e, state["node"] == e["src"]).select(F.col("dst").alias("node"), (F.col("a") * spread * F.col("weight") / (F.col("weight") + 1)).alias("a"))
    x = state.select("node", (F.col("a") * direct).alias("a")).union(passed).groupBy("node").agg(F.sum("a").alias("a"))
    total = x.agg(F.sum("a").alias("t"))
    return x.crossJoin(F.broadcast(total)).select("node", (F.col("a") / F.col("t")).alias("a")).where(F.col("a") > least)  # one row


def beam(adjacency: dict[int, list[tuple[int, float]]], start: int, width: int = 10, depth: int = 20, entropies: dict[int, float] | None = None) -> list[tuple[list[int], float]]:
    """Paths and scores: log weights less penalties for repetition, loops and odd entropy, normalised by length ** 0.7."""
    import math

    beams = [([start], 0.0)]
    for _ in range(depth):
        grown = []
        for path, score in beams:
            for nxt, w in adjacency.get(path[-1], ()):
                if w <= 0:
                    continue
                s = score + math.log(w) - 0.15 * path.count(nxt) - (0.25 if len(path) > 1 and path[-2] == nxt else 0)
                if entropies:
                    s -= 0.08 * abs(entropies.get(nxt, 0.0) - 0.6)
                s -= 0.12 * sum(p[-1] == nxt for p, _ in grown)
                grown.append((path + [nxt], s))
        if not grown:
            break
        grown.sort(key=lambda b: (-b[1] / len(b[0]) ** 0.7, b[0]))
        beams = grown[:width]
    return [(p, s / len(p) ** 0.7) for p, s in beams]


def ranks(cases: DataFrame, predicted: DataFrame) -> DataFrame:
    """Metrics by category and over all (category null): ``cases, top1, top3, top5, mrr``.

    ``cases(case_id, start, prefix, expected, category)`` against ``predicted(start, token, score)``: the rank is among the
    predictions that begin with the prefix.
    """
    met = cases.join(predicted, "start").where(F.expr("startswith(token, prefix)"))
    n = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "token"))
    hit = met.withColumn("r", n).where("token = expected").groupBy("case_id").agg(F.min("r").alias("r"))
    x = cases.join(hit, "case_id", "left")
    at = [F.avg(F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0))).alias(f"top{k}") for k in (1, 3, 5)]
    return x.rollup("category").agg(F.count("*").alias("cases"), *at, F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"))
