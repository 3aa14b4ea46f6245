"""What is worked out by the pieces between spaces is what whole texts give."""

import random

import pytest
from pyspark.sql import functions as F

from sylspark.functions import text as T
from sylspark.operators import encode as E
from sylspark.operators import grammar as G
from sylspark.operators import graph
from sylspark.operators import pieces as P
from sylspark.operators import truth
from sylspark.plans import grammars

ODD = ["", " ", "  ", " a", "a ", "tt ttt tTtt", None, "Webale nnyo, MPA! ggwe-embwa 12", "ŋŋoma é\n\n  nnYa", "bBa BBa x" * 40, "\t   \x00 😊😊 'n'", "abakiga na baka " * 3, "z" * 700 + " " + "ba" * 300]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["ba", "ki", "t", "T", "na", "n", " ", " ", "é", ".", "\n", "W", "so"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()


def syllables(docs):
    return docs.where("text is not null").select("doc_id", T.syllabify(F.col("text")).alias("s"))


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)


def asked_of_texts(df):
    """Whether a filter of the plan cuts texts."""
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x and ("regexp" in x or "RLIKE" in x)]


def test_pairs_and_syllables(docs, monkeypatch):
    s = syllables(docs)
    assert same(G.text_pair_counts(docs), G.array_pair_counts(s, "s"))
    assert same(T.syllable_counts(docs), s.select(F.explode("s").alias("syl")).groupBy("syl").agg(F.count("*").alias("freq")))


def test_limits_of_a_worker_change_nothing():
    """Counts that are handed on early, and remembered pieces that are dropped, add up to the same."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(ODD)], ["text"])

    def give(pieces, ends, spaces):
        return [sorted(pieces.items()), sorted(ends.items()), spaces]

    whole = list(P._counted([batch], give))
    most, text = P.MOST, P.TEXT
    try:
        P.TEXT, P.MOST = 10, 2
        parts = list(P._counted([batch], give))
        cache = P.Remembered(P.cut)
        assert [cache[p] for p in [b"bba", b"nnya", b"bba", b"z" * 999, b"ka"]] == [["bba"], ["nnya"], ["bba"], ["z"] * 999, ["ka"]] and len(cache) <= 2
    finally:
        P.TEXT, P.MOST = text, most
    assert len(whole) == 1 and len(parts) > 5
    assert sum(n for x in parts for _, n in x[0]) == sum(n for _, n in whole[0][0]) and sum(x[2] for x in parts) == whole[0][2]


@pytest.mark.parametrize("name", ["locked_pair_freq", "rule_eff_freq", "vocab_dedup"])
def test_filters_on_pairs_cut_no_text(spark, sf_dir, name):
    assert not asked_of_texts(getattr(grammars, name)(spark, sf_dir))


def test_vocabulary_takes_one_walk(spark, sf_dir, docs):
    plan = grammars._vocab(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp_extract_all(text" not in plan
    got = {(r.token, r.ord) for r in G.symbols_and_pairs(docs, F.expr("freq >= 3")).collect()}
    want = {(r.syl, 0) for r in T.syllable_counts(docs).collect()} | {(r.l + r.r, 1) for r in G.array_pair_counts(syllables(docs), "s").where("freq >= 3").collect()}
    assert got == want
    single = P.counts(docs).where("r is null").select(F.col("l").alias("syl"), "freq")
    assert same(single, T.syllable_counts(docs))


@pytest.mark.parametrize("tokens", [["a", "ba", "ki", "t", "tt", "naba", "kiba", "n", ".", "bakina", "\n", "so", " "], ["ba", "ki", "ba ki", "na", " ", "t"]])
def test_encoding_by_pieces(spark, docs, tokens):
    """Texts are encoded as their syllables are, also where a token has a space inside, and decoded by lookup."""
    v = E.load(spark.createDataFrame([(t, 7 * k + 1) for k, t in enumerate(tokens)], "token string, token_id long"))
    assert v.apart == ("ba ki" not in tokens)
    plain = E.Vocabulary([(s, i) for s, i in v.ids.items()])
    x = docs.select("doc_id", E.encode(F.col("text"), v).alias("a"), E.encode(F.col("text"), v, "rtl").alias("b"))
    got = {r.doc_id: (r.a, r.b) for r in x.collect()}
    want = {r.doc_id: (plain.ltr(list(r.s)), plain.rtl(list(r.s))) for r in syllables(docs).collect()}
    assert all(got[k] == want.get(k, ([], [])) for k in got) and len(got) == docs.count()
    back = {r.doc_id: r.text for r in E.decode(x, v, "a").collect()}
    spell = {i: t for t, i in zip(tokens, range(1, 7 * len(tokens), 7))}
    assert back == {k: "".join(spell.get(i, "") for i in a) for k, (a, _) in got.items() if a}
    assert same(docs.select("doc_id", P.spelled(F.col("text")).alias("t")).where("t is not null"), syllables(docs).select("doc_id", F.array_join("s", "").alias("t")))


def test_decoding_moves_no_ids(spark, sf_dir):
    plan = grammars.decode_join(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan


@pytest.mark.parametrize("patterns", [["a", "ba", "na", "n", "bana", "kiba", "baki", "nn"], ["ba", "na ba", " ba", "ki"]])
def test_matches_by_pieces(spark, docs, patterns, monkeypatch):
    """Against windows over the syllables of whole texts, with small parts and a table that is emptied, also for patterns with a space."""
    monkeypatch.setattr(P, "PART", 50)
    p = spark.createDataFrame([(t, k) for k, t in enumerate(patterns, 1)], "pattern string, mask int").select("pattern", F.size(T.syllabify(F.col("pattern"))).alias("n"), "mask")
    found = truth.matches(T.syllables(docs), p)
    assert found.count() > 50
    assert same(truth.text_matches(docs, p), found)
    assert same(truth.text_longest(docs, p), truth.longest_at(found))
    assert same(truth.text_locked(docs, p), truth.locked(found))


def test_table_of_pieces_may_be_emptied(monkeypatch):
    texts = [t.encode() for t in ODD if t]
    find = lambda s: [(i, len(x)) for i, x in enumerate(s) if x in ("ba", "t")]
    whole = [[c.tolist() for c in (r, b, *cs)] for r, b, cs in (P.Table(find, 2).rows(texts[k : k + 3], True) for k in range(0, len(texts), 3))]
    monkeypatch.setattr(P, "MOST", 2)
    table = P.Table(find, 2)
    assert [[c.tolist() for c in (r, b, *cs)] for r, b, cs in (table.rows(texts[k : k + 3], True) for k in range(0, len(texts), 3))] == whole


@pytest.mark.parametrize("pair", [("t", "t"), ("ba", "ki"), ("ba", " "), ("x", "ba")])
def test_sums_by_pieces(docs, pair):
    out = G.replace_once(T.syllables(docs), *pair, "new", sym="syl")
    want = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum((F.col("syl") == "new").cast("long")).alias("replaced"))
    assert same(G.text_replaced(docs, *pair, "new"), want)


@pytest.mark.parametrize("name", ["truth_matches", "truth_longest_prefix", "span_boundary_range_join", "unk_rate", "pair_replace_once"])
def test_texts_are_not_taken_apart_into_rows(spark, sf_dir, name):
    """No syllable is moved: the one exchange spreads texts of few splits."""
    plan = getattr(grammars, name)(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Window", "Aggregate", "Generate", "Join"))


@pytest.mark.parametrize("most", [1, 32 << 20])
def test_edges_where_the_texts_are(spark, docs, most, monkeypatch):
    """Against windows over the chains of whole texts, counted at once and a few texts at a time; what isn't ASCII is no white space and keeps its case."""
    monkeypatch.setattr(graph, "TOKENS", most)
    odd = [(900 + k, t) for k, t in enumerate(["A b. C", ".", "..", "\n", "ÉA éa \x0b x\x1cy\x85z", "a?b!c", "end", "Start", None, "the the the the"])]
    x = docs.unionAll(spark.createDataFrame(odd, "doc_id long, text string"))
    found = graph.text_edges(x)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert same(found, graph.edges(graph.tokens(x), ["doc_id", "chain"], ["pos"]))
    assert graph.text_edges(x.where("doc_id = 903")).count() == 0


def test_edge_queries_sort_no_tokens(spark, sf_dir):
    from sylspark.plans import graphs

    for name in ("telemetry", "bulk_prior_merge", "bigram_edges"):
        assert "Window" not in getattr(graphs, name)(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_cut_where_they_are_counted(spark, docs):
    """Against splitting texts and cutting words in rows; white space is ASCII, and a word moves once, as a string."""
    x = docs.unionAll(spark.createDataFrame([(800, "ba\tki\x0bba ki so BaKi\fbaki\x1cba  \r\n")], docs.schema))
    words = x.select(F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''").select(T.syllabify(F.col("w")).alias("s")).where("size(s) > 1")
    found = P.word_counts(x)
    assert found.schema["s"].dataType.simpleString() == "string"
    assert same(found, words.groupBy(F.array_join("s", " ").alias("s")).agg(F.count("*").alias("n")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and plan.count("Aggregate") == 1
