"""Queries over transition graphs of documents, conversations, events and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import resources as R
from ..operators import graph as G
from .catalogue import query, table
from .scalars import values

TOK = r"""t0 AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\s!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]')) AS token, unnest(range(len(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\s!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]')))) AS pos FROM documents),
tok AS (SELECT doc_id, pos, token, coalesce(sum((token IN ('.', '?', '!'))::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chain FROM t0)"""
EDGES = f"{TOK}, e0 AS (SELECT token AS src, lead(token) OVER (PARTITION BY doc_id, chain ORDER BY pos) AS dst FROM tok), e AS (SELECT src, dst, count(*) AS weight FROM e0 WHERE dst IS NOT NULL GROUP BY src, dst)"


def _edges(spark, d):
    return G.text_edges(table(spark, d, "documents"))


@query(f"WITH {TOK} SELECT token, count(*) AS freq FROM tok GROUP BY token")
def lexeme_freq(spark, d):
    return G.tokens(table(spark, d, "documents")).groupBy("token").agg(F.count("*").alias("freq"))


@query(f"WITH {EDGES} SELECT * FROM e")
def bigram_edges(spark, d):
    return _edges(spark, d)


@query(f"WITH {EDGES} SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM e) WHERE n <= 16")
def out_degree_cap(spark, d):
    return G.cap_out_degree(_edges(spark, d), 16)


@query(f"WITH {EDGES} SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM e) WHERE n <= 3")
def edge_topk(spark, d):
    return G.cap_out_degree(_edges(spark, d), 3)


PHRASES = values((a, b, w) for a, b, w, _ in R.PHRASES)


@query(f"WITH {EDGES}, p(src, dst, weight) AS (VALUES {PHRASES}) SELECT src, dst, sum(w)::DOUBLE AS weight FROM (SELECT src, dst, weight::DOUBLE AS w FROM e UNION ALL SELECT src, dst, weight::DOUBLE FROM p) GROUP BY src, dst")
def bulk_prior_merge(spark, d):
    priors = spark.createDataFrame([(a, b, w) for a, b, w, _ in R.PHRASES], "src string, dst string, weight double")
    return G.with_priors(_edges(spark, d), priors)


@query(f"WITH p(src, dst, weight, category) AS (VALUES {values(R.PHRASES)}) SELECT category, count(*) AS phrases, round(avg(weight::DOUBLE), 6) AS mean_weight FROM p GROUP BY category")
def phrase_seed_weights(spark, d):
    p = spark.createDataFrame(R.PHRASES, "src string, dst string, weight double, category string")
    return p.groupBy("category").agg(F.count("*").alias("phrases"), F.round(F.avg("weight"), 6).alias("mean_weight"))


@query(f"WITH {EDGES} SELECT * FROM e WHERE NOT regexp_matches(dst, '^[.,]|[.,]$')")
def gated_edges(spark, d):
    return G.gated(_edges(spark, d))


@query(f"WITH {EDGES} SELECT dst, count(*) AS in_degree, sum(weight)::BIGINT AS in_weight FROM e GROUP BY dst")
def reverse_adjacency(spark, d):
    return _edges(spark, d).groupBy("dst").agg(F.count("*").alias("in_degree"), F.sum("weight").alias("in_weight"))


@query(f"WITH {EDGES}, p AS (SELECT src, weight / sum(weight) OVER (PARTITION BY src) AS p FROM e) SELECT src AS node, count(*) AS degree, round(sum(-p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY src")
def node_entropy(spark, d):
    return G.entropy(_edges(spark, d)).withColumn("entropy", F.round("entropy", 6) + F.lit(0.0))


@query(f"WITH {EDGES} SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS p FROM e")
def transition_prob(spark, d):
    return G.probabilities(_edges(spark, d)).select("src", "dst", F.round("p", 6).alias("p"))


@query(f"WITH {EDGES}, v AS (SELECT count(DISTINCT src) AS v FROM e) SELECT src, dst, round(greatest(8.0 * (1 + log2((weight + 0.01) / (sum(weight) OVER (PARTITION BY src) + 0.01 * v))), 0.1)::DOUBLE, 5) AS weight FROM e, v")
def ngram_prior(spark, d):
    return G.ngram_prior(_edges(spark, d)).withColumn("weight", F.round("weight", 5))


EVENTS = "ev AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT src, dst, count(*) AS weight FROM ev WHERE dst IS NOT NULL GROUP BY src, dst)"


@query(f"WITH {EVENTS} SELECT src, dst, weight, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS p FROM e")
def event_transitions(spark, d):
    e = G.edges(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return G.probabilities(e).withColumn("p", F.round("p", 6))


@query("WITH x AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) SELECT src, dst, count(*) AS weight FROM x WHERE dst IS NOT NULL GROUP BY src, dst")
def basket_edges(spark, d):
    return G.edges(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey")


@query("WITH x AS (SELECT o_orderstatus AS src, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) SELECT src, dst, count(*) AS weight FROM x WHERE dst IS NOT NULL GROUP BY src, dst")
def order_status_chain(spark, d):
    return G.edges(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus")


@query("WITH x AS (SELECT role AS src, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, text) AS dst FROM conversations) SELECT src, dst, count(*) AS weight FROM x WHERE dst IS NOT NULL GROUP BY src, dst")
def role_chain(spark, d):
    return G.edges(table(spark, d, "conversations"), ["conv_id"], ["turn", "text"], "role")


@query()
def strong_components(spark, d):
    """Strongly connected components of the basket graph of all rows."""
    return G.strong_components(basket_edges(spark, d))


@query()
def scc_metrics(spark, d):
    e = basket_edges(spark, d)
    return G.component_metrics(e, G.strong_components(e)).withColumn("coherence", F.round("coherence", 6))


def _label_parts(spark, d):
    """Nodes of the event graph by type, as given components with their measures."""
    x = table(spark, d, "events").groupBy(F.col("event_type").alias("scc")).agg(F.countDistinct("user_id").alias("members"), F.count("*").alias("freq"), F.avg("value").alias("v"))
    return x


PARTS = "x AS (SELECT event_type AS scc, count(DISTINCT user_id) AS members, count(*) AS freq, avg(value) AS v FROM events GROUP BY event_type)"


@query(f"WITH {PARTS}, y AS (SELECT *, freq / (freq + members)::DOUBLE AS coherence FROM x) SELECT scc, members, freq, round(coherence / (1 + ln(members)), 6) AS rho FROM y WHERE coherence / (1 + ln(members)) >= 0.05 AND freq >= 5")
def candidates(spark, d):
    x = _label_parts(spark, d).withColumn("coherence", F.col("freq") / (F.col("freq") + F.col("members")))
    return G.candidates(x).select("scc", "members", "freq", F.round("rho", 6).alias("rho"))


@query(f"WITH {EDGES} SELECT src, dst, greatest(CAST(greatest(0, least(65535, floor((log2(weight::DOUBLE) + 32) * 1024))) AS INTEGER) - 156, 0)::INTEGER AS q FROM e")
def decay_once(spark, d):
    from ..functions.text import log_quantise

    return _edges(spark, d).select("src", "dst", G.decay(log_quantise(F.col("weight").cast("double")), 0.9).alias("q"))


@query("WITH n AS (SELECT user_id AS scc, count(*) AS members FROM events GROUP BY user_id), b AS (SELECT user_id AS scc, count(*) AS was FROM events WHERE event_id % 7 <> 0 OR user_id % 2 = 0 GROUP BY user_id) SELECT n.scc, members, CASE WHEN members = was THEN 4 ELSE 0 END::BIGINT AS stable FROM n LEFT JOIN b USING (scc)")
def stability_step(spark, d):
    e = table(spark, d, "events")
    now = e.groupBy(F.col("user_id").alias("scc")).agg(F.count("*").alias("members"))
    was = e.where("event_id % 7 <> 0 or user_id % 2 = 0").groupBy(F.col("user_id").alias("scc")).agg(F.count("*").alias("members")).withColumn("stable", F.lit(3))
    return G.stability(now, was)


@query(f"WITH {EVENTS}, p AS (SELECT src, weight / sum(weight) OVER (PARTITION BY src) AS p FROM e), h AS (SELECT src AS scc, sum(-p * log2(p)) AS entropy FROM p GROUP BY src), {PARTS} SELECT x.scc, freq, round(entropy, 6) AS entropy FROM x JOIN h USING (scc) WHERE freq >= 5 AND entropy <= 5 AND freq / (freq + members)::DOUBLE >= 0.01")
def promote_step(spark, d):
    e = G.edges(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    h = G.entropy(e).select(F.col("node").alias("scc"), "entropy")
    x = _label_parts(spark, d).join(h, "scc").withColumn("stable", F.lit(2)).withColumn("coherence", F.col("freq") / (F.col("freq") + F.col("members")))
    return G.promoted(x).select("scc", "freq", F.round("entropy", 6).alias("entropy"))


@query("WITH x AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) SELECT src % 25 AS src_sym, dst % 25 AS dst_sym, count(*) AS weight FROM x WHERE dst IS NOT NULL AND src % 25 <> dst % 25 GROUP BY 1, 2")
def symbol_transitions(spark, d):
    e = basket_edges(spark, d)
    s = table(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 25).alias("symbol"))
    return G.transitions(e, s)


@query(f"WITH {TOK}, r AS (SELECT doc_id, pos, token, length(token) > 6 AS noun FROM tok), x AS (SELECT doc_id, pos, token, lag(noun) OVER w AS a, lead(noun) OVER w AS b FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT CASE WHEN a AND b THEN 'genitive' WHEN NOT a AND b THEN 'particle' WHEN NOT b THEN 'connector' ELSE 'none' END AS role, count(*) AS n FROM x WHERE token IN ('a', 'de', 'en', 'er', 'of') GROUP BY 1")
def hybrid_roles(spark, d):
    """Role of a small word by what is beside it; long words stand in for nouns."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    noun = F.char_length("token") > 6
    x = G.tokens(table(spark, d, "documents")).select("token", F.lag(noun).over(by).alias("a"), F.lead(noun).over(by).alias("b")).where(F.col("token").isin("a", "de", "en", "er", "of"))
    role = F.when(F.col("a") & F.col("b"), "genitive").when(~F.col("a") & F.col("b"), "particle").when(~F.col("b"), "connector").otherwise("none")
    return x.groupBy(role.alias("role")).agg(F.count("*").alias("n"))


TWO = "pr AS (SELECT src, dst, ln(weight) AS lw FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM e WHERE weight >= 2) WHERE n <= 10), one AS (SELECT start, dst AS token, lw AS score FROM starts JOIN pr ON start = src), two AS (SELECT start, dst AS token, score + lw AS score FROM one JOIN pr ON token = src), best AS (SELECT start, token, max(score) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL), top AS (SELECT start, token, score, CAST(row_number() OVER (PARTITION BY start ORDER BY score DESC, token) AS INTEGER) AS rank FROM best)"


@query(f"WITH {EVENTS}, starts AS (SELECT DISTINCT src AS start FROM e), {TWO} SELECT start, token, round(score, 6) AS score, rank FROM top WHERE rank <= 5")
def predict_two_hop(spark, d):
    e = G.edges(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return G.two_hops(e.select(F.col("src").alias("start")).distinct(), e).withColumn("score", F.round("score", 6))


@query(f"WITH {EVENTS}, s AS (SELECT event_type AS node, count(*) / (SELECT count(*) FROM events)::DOUBLE AS a FROM events GROUP BY event_type), u AS (SELECT node, a * 0.9 AS a FROM s UNION ALL SELECT dst, a * 0.3 * weight / (weight + 1) FROM s JOIN e ON node = src), x AS (SELECT node, sum(a) AS a FROM u GROUP BY node) SELECT node, round(a / (SELECT sum(a) FROM x), 6) AS a FROM x WHERE a / (SELECT sum(a) FROM x) > 0.01")
def activation_step(spark, d):
    ev = table(spark, d, "events")
    state = ev.groupBy(F.col("event_type").alias("node")).agg(F.count("*").alias("c")).crossJoin(F.broadcast(ev.agg(F.count("*").alias("t")))).select("node", (F.col("c") / F.col("t")).alias("a"))
    e = G.edges(ev, ["user_id"], ["ts", "event_id"], "event_type")
    return G.activate(state, e).withColumn("a", F.round("a", 6))


EVAL = f"WITH {EVENTS}, starts AS (SELECT DISTINCT src AS start FROM e), {TWO}, k AS (SELECT event_id AS case_id, event_type AS start, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS expected, CAST(user_id % 4 AS BIGINT) AS category FROM events), c AS (SELECT *, left(expected, 1) AS prefix FROM k WHERE expected IS NOT NULL), h AS (SELECT case_id, token = expected AS ok, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, token) AS r FROM c JOIN top USING (start) WHERE rank <= 5 AND starts_with(token, prefix)), b AS (SELECT case_id, min(r) AS r FROM h WHERE ok GROUP BY case_id)"


def _eval(spark, d):
    ev = table(spark, d, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    cases = ev.select(F.col("event_id").alias("case_id"), F.col("event_type").alias("start"), after.alias("expected"), (F.col("user_id") % 4).alias("category")).where("expected is not null").withColumn("prefix", F.substring("expected", 1, 1))
    e = G.edges(ev, ["user_id"], ["ts", "event_id"], "event_type")
    return G.ranks(cases, G.two_hops(e.select(F.col("src").alias("start")).distinct(), e))


@query(EVAL + " SELECT category, count(*) AS cases, " + ", ".join(f"round(avg(coalesce((r <= {k})::INT, 0)), 6) AS top{k}" for k in (1, 3, 5)) + ", round(avg(coalesce(1.0 / r, 0))::DOUBLE, 6) AS mrr FROM c LEFT JOIN b USING (case_id) GROUP BY ROLLUP (category)")
def eval_rollup(spark, d):
    return _eval(spark, d).select("category", "cases", *(F.round(c, 6).alias(c) for c in ("top1", "top3", "top5", "mrr")))


@query("WITH x AS (SELECT source AS category, avg(quality) AS now FROM documents JOIN labels USING (doc_id) GROUP BY source), y AS (SELECT source AS category, avg(quality) AS base FROM documents JOIN labels USING (doc_id) WHERE doc_id % 3 <> 0 GROUP BY source) SELECT category, round(base - now, 6) AS drop FROM x FULL JOIN y USING (category) WHERE base - now > 0.02")
def eval_regression(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", F.col("source").alias("category"), "quality")
    base = x.where("doc_id % 3 <> 0").groupBy("category").agg(F.avg("quality").alias("base"))
    return x.groupBy("category").agg(F.avg("quality").alias("now")).join(base, "category", "full").where("base - now > 0.02").select("category", F.round(F.col("base") - F.col("now"), 6).alias("drop"))


@query(f"WITH {EDGES} SELECT count(*) AS edges, count(DISTINCT src) AS sources, max(weight) AS heaviest, round(avg(weight), 6) AS mean_weight FROM e")
def telemetry(spark, d):
    return _edges(spark, d).agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.max("weight").alias("heaviest"), F.round(F.avg("weight"), 6).alias("mean_weight"))


@query("SELECT event_id, round(least(10.0, greatest(1.0, 1 + 2 * (1 - value / 100.0) + 5 * greatest(0, value / 200.0 - 0.3) + 0.1 * (user_id % 10)))::DOUBLE, 6) AS wait FROM events")
def crawl_backoff(spark, d):
    v = F.col("value")
    w = 1 + 2 * (1 - v / 100.0) + 5 * F.greatest(F.lit(0.0), v / 200.0 - 0.3) + 0.1 * (F.col("user_id") % 10)
    return table(spark, d, "events").select("event_id", F.round(F.least(F.lit(10.0), F.greatest(F.lit(1.0), w)), 6).alias("wait"))


@query("WITH a AS (SELECT event_type, count(*) AS n, sum(value) AS s FROM events WHERE event_id % 2 = 0 GROUP BY event_type), b AS (SELECT event_type, count(*) AS n, sum(value) AS s FROM events WHERE event_id % 2 = 1 GROUP BY event_type) SELECT event_type, coalesce(b.n, 0) - coalesce(a.n, 0) AS d_n, round(coalesce(b.s, 0) - coalesce(a.s, 0), 4) AS d_s FROM a FULL JOIN b USING (event_type)")
def snapshot_comparison(spark, d):
    e = table(spark, d, "events")
    a, b = (e.where(f"event_id % 2 = {k}").groupBy("event_type").agg(F.count("*").alias(f"n{k}"), F.sum("value").alias(f"s{k}")) for k in (0, 1))
    x = a.join(b, "event_type", "full").na.fill(0)
    return x.select("event_type", (F.col("n1") - F.col("n0")).alias("d_n"), F.round(F.col("s1") - F.col("s0"), 4).alias("d_s"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_hours(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(coalesce((date_diff('second', prev, ts) > 1800)::INT, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY ALL".replace("SELECT user_id, session,", "SELECT user_id, session::BIGINT AS session,"))
def event_sessions(spark, d):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce((F.date_trunc("second", "ts").cast("long") - F.date_trunc("second", F.lag("ts").over(by)).cast("long") > 1800).cast("long"), F.lit(0))
    x = table(spark, d, "events").withColumn("gap", gap).withColumn("session", F.sum("gap").over(by))
    return x.groupBy("user_id", "session").agg(F.count("*").alias("n"))
