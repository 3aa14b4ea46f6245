"""URL filters: rules first, then a tree of path templates per host with smoothed labelled purity.

Paths are counted by (host, shape) before anything is shuffled by host: variable segments (numbers, hashes,
dates) become wildcards from their form, and segments under a parent of too many children become one wildcard.
Sibling branches of the same form and of the same labelled class are merged. What the rules say of the URLs
that they cover is the label; a template whose smoothed share of blocked URLs exceeds one half is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: (verdict, host and path). The longest rule that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Segments of a template; what follows is part of the last one. Levels that no path has cost nothing.
DEPTH = 32
#: Distinct children from which a parent's children are one wildcard.
CHILDREN = 64
#: Labelled URLs that the parent's rate counts as, in a node's rate.
STRENGTH = 4.0
#: Copies of the template table for the join with the URLs, so that a hot host's URLs are in several tasks.
SALTS = 8


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and without ``://``. A-Z of the host in lower case."""
    at = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    host = F.translate(F.regexp_extract(url, at, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, host).otherwise(""), F.when(has, F.regexp_extract(url, at, 2)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of the longest fitting rule and its verdict; null if none fits."""
    best = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        then = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, then) if best is None else best.when(fits, then)
    return best if best is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def shape(path: Column, depth: int = 4) -> Column:
    """Segments of a path with digits, hashes and dates as wildcards; at most ``depth``, the last with the rest."""
    x = F.regexp_replace(path, r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "{date}")
    x = F.regexp_replace(x, r"\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}\b", "{hex}")
    x = F.regexp_replace(x, r"[0-9]+", "{n}")
    return F.split(F.regexp_replace(x, "^/", ""), "/", depth)


def _depth(tree: DataFrame) -> int:
    return tree.agg(F.max(F.size("t"))).first()[0] or 0


def _generalise(tree: DataFrame, children: int) -> DataFrame:
    """``tree(host, shape, t, n, good, bad)``: children of crowded parents become one wildcard, level by level."""
    for k in range(_depth(tree)):
        head = F.slice("t", 1, k)
        at = tree.where(F.size("t") > k).select("host", head.alias("head"), F.get("t", F.lit(k)).alias("x")).distinct()
        crowded = at.groupBy("host", "head").agg(F.count("*").alias("c")).where(F.col("c") > children).drop("c").withColumn("wide", F.lit(True))
        step = tree.withColumn("head", head).join(crowded, ["host", "head"], "left")
        wild = F.when(F.col("wide") & (F.size("t") > k), F.concat(F.col("head"), F.array(F.lit("*")), F.slice("t", k + 2, DEPTH))).otherwise(F.col("t"))
        tree = materialise(step.withColumn("t", wild).select("host", "shape", "t", "n", "good", "bad"), "tree")
    return tree


def _merge(tree: DataFrame) -> DataFrame:
    """Siblings whose subtrees have the same form and whose labels are of the same class become one branch, from the leaves up."""
    for k in reversed(range(_depth(tree))):
        own = tree.where(F.size("t") > k)
        # shapes that are one template count once in the form of what is below
        each = own.groupBy("host", F.slice("t", 1, k).alias("head"), F.get("t", F.lit(k)).alias("x"), F.slice("t", k + 2, DEPTH).alias("rest")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        node = each.groupBy("host", "head", "x").agg(
            F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.bit_xor(F.xxhash64("rest")).alias("form")
        )
        n = F.col("good") + F.col("bad")
        rate, margin = (F.col("bad") + 1) / (n + 2), F.sqrt(0.25 / (n + 2))
        kind = F.when(n == 0, "none").when(rate - margin > 0.5, "bad").when(rate + margin < 0.5, "good").otherwise("mixed")
        node = node.withColumn("kind", kind)
        same = node.groupBy("host", "head", "form", "kind").agg(F.count("*").alias("c"), F.min("x").alias("name"))
        to = node.join(same, ["host", "head", "form", "kind"]).where("c > 1 and kind <> 'mixed'").select("host", "head", "x", F.concat(F.lit("~"), "name", F.lit(":"), "kind").alias("to"))
        step = tree.withColumn("head", F.slice("t", 1, k)).withColumn("x", F.get("t", F.lit(k))).join(to, ["host", "head", "x"], "left")
        t = F.when(F.col("to").isNotNull(), F.concat(F.col("head"), F.array("to"), F.slice("t", k + 2, DEPTH))).otherwise(F.col("t"))
        tree = materialise(step.withColumn("t", t).select("host", "shape", "t", "n", "good", "bad"), "tree")
    return tree


def templates(pages: DataFrame, rules=RULES, children: int = CHILDREN, strength: float = STRENGTH) -> DataFrame:
    """``host, shape, template, rate``: for each shape of a host its template and the template's smoothed blocked share."""
    host, path = parts(F.col("url"))
    given = pages.select(host.alias("host"), path.alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.col("r.verdict")
    counted = given.groupBy("host", shape(F.col("path"), DEPTH).alias("shape")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum((verdict == "allow").cast("long")), F.lit(0)).alias("good"), F.coalesce(F.sum((verdict == "block").cast("long")), F.lit(0)).alias("bad")
    )
    counted = materialise(counted.withColumn("t", F.col("shape")).select("host", "shape", "t", "n", "good", "bad"), "paths")
    tree = _merge(_generalise(counted, children)).withColumn("template", F.array_join("t", "/"))
    total = counted.agg(((F.sum("bad") + 1) / (F.sum("good") + F.sum("bad") + 2)).alias("all")).first()["all"] or 0.5
    # every node's rate is smoothed by its parent's, from the host down
    levels = tree.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("t")))).withColumn("node", F.slice("t", 1, F.col("k")))
    sums = levels.groupBy("host", "node").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    path = levels.select("host", "template", "k", "node").distinct().join(sums, ["host", "node"]).groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("k", "good", "bad"))).alias("path"))
    rate = F.aggregate("path", F.lit(float(total)), lambda r, x: (x["bad"] + strength * r) / (x["good"] + x["bad"] + strength))
    rated = path.select("host", "template", rate.alias("rate"))
    return materialise(tree.join(rated, ["host", "template"]).select("host", "shape", "template", "rate"), "templates")


def judge(pages: DataFrame, rules=RULES, children: int = CHILDREN, strength: float = STRENGTH) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, rate`` of every row of ``pages(page_id, url)``.

    The verdict is the rule's, else ``block`` where the template's rate exceeds one half, else ``allow``. Null
    URLs and those without ``://`` have an empty host and path and are judged like any host; repeated rows and null ids are
    rows of their own; an empty table gives no rows; other columns are not read.
    """
    host, path = parts(F.col("url"))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    given = given.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", shape(F.col("path"), DEPTH))
    given = given.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)))
    known = templates(pages, rules, children, strength).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = given.join(known, ["host", "shape", "salt"], "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("rate") > 0.5, "block").otherwise("allow"))
    return met.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", "rate")
