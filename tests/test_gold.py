import pandas as pd
import pytest
from pyspark.sql import functions as F

from sylspark.functions import language as L
from sylspark.functions import numerals as N
from sylspark.functions import text as T
from sylspark.operators import encode as E
from sylspark.operators import grammar as G
from sylspark.operators import graph, similarity, truth


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r.y for r in df.select("k", expr(F.col("x")).alias("y")).orderBy("k").collect()]


def test_syllables(spark):
    cases = {"Webale nnyo": "we,ba,le, ,nnyo", "omwana": "o,m,wa,na", "mpa": "m,pa", "nnyabo": "nnya,bo", "ggwe": "ggwe", "embwa": "e,mbwa", "ŋŋoma": "ŋ,ŋ,o,ma", "Xa 1": "X,a, ,1", "": ""}
    assert column(spark, list(cases), lambda x: F.array_join(T.syllabify(x), ",")) == list(cases.values())


def test_phonology(spark):
    cases = {"ki-agenda": "kyagenda", "ki-ogera": "kyogera", "tu-asoma": "twasoma", "omwana": "omwana", "ssebo-nnyabo": "ssebonnyabo"}
    assert column(spark, list(cases), L.phonology) == list(cases.values())


def test_stems(spark):
    cases = {"omwana": "ana", "abaganda": "ganda", "okukolima": "olima", "okulabirira": "labirira", "xyz": "xyz"}
    assert column(spark, list(cases), L.stem) == list(cases.values())
    assert column(spark, ["xyz"], lambda w: L.morph(w)["confidence"]) == [0.3]


def test_graphemes(spark):
    sizes = column(spark, ["h", "😊", "👩🏽", "🇺🇬", "e\u0301"], lambda x: F.octet_length(T.graphemes(x)[0]))
    assert sizes == [1, 4, 8, 8, 3]
    assert column(spark, ["Ŋŋooyo"], F.char_length) == [6]


def test_matches(spark):
    seq = spark.createDataFrame([(1, k, s) for k, s in enumerate(["a", "ba", "ka", "so"])], "doc_id int, pos int, syl string")
    patterns = spark.createDataFrame([("baka", 2, 1), ("kaso", 2, 2), ("bami", 2, 4)], "pattern string, n int, mask int")
    found = sorted(map(tuple, truth.matches(seq, patterns).collect()))
    assert found == [(1, 1, 2, 1), (1, 2, 2, 2)]
    assert sorted(r.pos for r in truth.locked(truth.matches(seq, patterns)).collect()) == [0, 1, 2, 3]


def test_best_pair_ties(spark):
    pairs = spark.createDataFrame([(1, 2, 5), (1, 3, 5), (0, 9, 5)], "l int, r int, freq int")
    assert tuple(G.best_pairs(pairs).first()) == (1, 3, 5)


@pytest.mark.parametrize("n,words", [(11, "kkumi n'emu"), (20, "abiri"), (99, "kyenda mu mwenda"), (500, "tutaano"), (1000, "lukumi"), (0, "zeero"), (-3, "minus ssatu"), (2_000_000, "bukadde bubiri")])
def test_number_words(n, words):
    assert N.number_words(n) == words


def test_numbers_come_back():
    for n in [*range(0, 5000), 10_000, 25_000, 30_007, 123_000, 10**6, 3 * 10**6 + 12, 7 * 10**12]:
        assert N.words_number(N.number_words(n)) == n, n
    assert N.words_number("") is None and N.words_number("nothing") is None


def test_phones(spark):
    raw = ["0770123456", "+254 722 123456", "255 71 234-5678", "722123456", "07701", None]
    got = column(spark, raw, N.phone)
    assert [tuple(g) if g else None for g in got] == [("256", "77", "0123456"), ("254", "722", "123456"), ("255", "71", "2345678"), None, None, None]
    assert column(spark, raw[:1], lambda x: N.phone_display(N.phone(x), x)) == ["+256 77 012 3456"]
    assert column(spark, raw[:2], lambda x: N.operator(N.phone(x))) == ["MTN", None]
    assert N.phone_words("12", "full") == "emu bbiri" and N.phone_words("1234", "grouped") == N.number_words(123) + ", nnya"


def test_hours(spark):
    cases = [(1, "okumakya", 7), (6, "ttuntu", 12), (7, "ekiro", 1), (6, "ttumbi", 0), (12, "okumakya", 6), (12, "akawungeezi", 18), (6, "ekiro", None)]
    df = spark.createDataFrame([c[:2] for c in cases], "h int, p string").select(N.hour_24(F.col("h"), F.col("p")).alias("y"))
    assert [r.y for r in df.collect()] == [c[2] for c in cases]


def test_dates(spark):
    got = column(spark, ["on 3/4/2021, or 2020-12-31; 40/1/2000"], N.numeric_dates)[0]
    assert [tuple(g) for g in got] == [(3, 4, 2021, "dmy"), (31, 12, 2020, "ymd")]
    assert column(spark, ["Gatonnya", "december", "nothing"], N.month_number) == [1, 12, None]


def test_pack_mask(spark):
    from sylspark.sources.artefacts import pack_mask

    assert spark.range(1).select(pack_mask(F.lit(1), F.lit(2), F.lit(4)).alias("m")).first().m == (4 << 40) | (2 << 20) | 1


def naive_repair(seqs, least, rules):
    seqs = [list(s) for s in seqs]
    out = []
    for _ in range(rules):
        count = pd.Series([p for s in seqs for p in zip(s, s[1:])]).value_counts()
        if not len(count) or count.iloc[0] < least:
            break
        n = count.iloc[0]
        a, b = max(p for p, c in count.items() if c == n)
        out.append((a, b, n))
        new = []
        for s in seqs:
            t, i = [], 0
            while i < len(s):
                if s[i : i + 2] == [a, b]:
                    t.append(a + b)
                    i += 2
                else:
                    t.append(s[i])
                    i += 1
            new.append(t)
        seqs = new
    return out


def test_repair_is_the_naive_one():
    import random

    rng = random.Random(1)
    seqs = [[rng.choice("abcd") for _ in range(rng.randrange(1, 30))] for _ in range(60)]
    assert G.repair([(s, 1) for s in seqs], 3, 40) == naive_repair(seqs, 3, 40)
    assert G.repair([(s, 1) for s in seqs], 3, 40) == G.repair([(s, 1) for s in seqs], 3, 40)


def test_longest_match_modes():
    v = E.Vocabulary([(("a",), 1), (("b",), 2), (("c",), 3), (("a", "b"), 4), (("b", "c"), 5)])
    assert v.ltr(["a", "b", "c"]) == [4, 3] and v.rtl(["a", "b", "c"]) == [1, 5]
    assert v.ltr(["x", "a"]) == [0, 1] and v.rtl(["x", "a"]) == [0, 1] and v.rtl([]) == []


def test_compress(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "s array<string>")
    assert df.select(G.compress(F.col("s"), {("a", "b"): "ab", ("ab", "c"): "abc"}).alias("y")).first().y == ["abc"]


def test_strong_components(spark):
    import random

    rng = random.Random(7)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    e = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight long")
    reach = {n: {n} for p in pairs for n in p}
    for _ in range(30):
        for a, b in pairs:
            for n in reach:
                if a in reach[n]:
                    reach[n].add(b)
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in reach if any(n in p for p in pairs if p[0] != p[1])}
    assert {r.node: r.scc for r in graph.strong_components(e).collect()} == want


def test_beam():
    paths = graph.beam({1: [(2, 8.0), (3, 2.0)], 2: [(3, 4.0)], 3: []}, 1, width=2, depth=2)
    assert paths[0][0] == [1, 2, 3]


def test_word_vectors(spark):
    w = spark.createDataFrame([("ab",)], "word string")
    v = spark.createDataFrame([("<ab", [3.0, 0.0]), ("ab>", [0.0, 4.0]), ("<ab>", [0.0, 0.0])], "gram string, vector array<double>")
    assert similarity.word_vectors(w, v).first().vector == pytest.approx([0.6, 0.8])


def test_training_takes_every_word_and_rule(spark):
    """Rare words together carry frequent pairs; rounds, runs and symbols of two origins change nothing."""
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice(["ba", "ka", "so", "b", "B", "bBa", "bba", "-", "--", "mi", "nya"]) for _ in range(rng.randrange(1, 12))) for _ in range(150)] + ["-" * n for n in range(1, 20)]
    docs = spark.createDataFrame([(" ".join(words[k : k + 50]),) for k in range(0, len(words), 50)], "text string").cache()
    whole = docs.select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''").groupBy("w").count().select(T.syllabify(F.col("w")).alias("s"), "count").collect()
    want = G.repair([(list(r[0]), r[1]) for r in whole])
    assert len(want) > 20
    for pieces in (60, 100_000):
        got = sorted(map(tuple, G.train(docs, pieces=pieces).collect()))
        assert [g[1:] for g in got] == want
    shallow = G.repair([(list(r[0]), r[1]) for r in whole], max_depth=3)
    assert [r[1:] for r in sorted(map(tuple, G.train(docs, max_depth=3).collect()))] == shallow
    assert G.train(docs, max_rules=7).count() == 7


def test_registered_training_has_no_cap(spark, sf_dir):
    from sylspark.plans import grammars

    got = grammars.rule_training(spark, sf_dir).agg(F.count("*").alias("n"), F.min("freq").alias("least")).first()
    assert got.n > 500 and (got.least == 3 or got.n == G.LIMIT)


@pytest.mark.parametrize("local", [0, None])
def test_strong_components_in_rounds_and_on_the_driver(spark, local):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 5), (6, 0), (5, 5)]
    e = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight long")
    assert {r.node: r.scc for r in graph.strong_components(e, local).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6}


def test_long_chain_of_cycles(spark):
    """More components in a chain than any number of rounds."""
    pairs = [p for k in range(60) for p in ((2 * k, 2 * k + 1), (2 * k + 1, 2 * k), (2 * k + 1, 2 * k + 2))][:-1]
    e = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight long")
    assert {r.node: r.scc for r in graph.strong_components(e).collect()} == {n: n // 2 * 2 for n in range(120)}


def test_basket_components_are_whole(spark, sf_dir):
    from sylspark.plans import graphs

    e = graphs.basket_edges(spark, sf_dir)
    ids = {r[0] for r in e.where("src <> dst").select(F.explode(F.array("src", "dst"))).distinct().collect()}
    got = {r.node: r.scc for r in graphs.strong_components(spark, sf_dir).collect()}
    assert set(got) == ids and len(ids) > 40


def test_nearest_of_all_labels(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 2), (3, [1.0, 0.2], None), (4, [0.0, 1.0], 1), (5, None, 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in similarity.nearest_of_all(e.where("vec_id in (1, 4)"), e, 2, block=1).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (4, 1, 3), (4, 2, 2)]


def test_register_split_has_both_sides(spark):
    from sylspark.plans import scalars

    x = spark.createDataFrame([(1, 2, 5), (2, 0, 5), (3, -1, 5), (4, 0, 5), (5, 3, 5), (6, -4, 5)], "doc_id long, rating long, n_words long")
    got = {s: sorted(r.doc_id for r in scalars.split_by_register(x, 14).collect() if r.side == s) for s in ("formal", "colloquial")}
    assert got == {"formal": [1, 2, 5], "colloquial": [2, 3, 6]}
    assert {r.doc_id for r in scalars.split_by_register(x).where("side = 'formal'").collect()} == {1, 2, 4, 5} and scalars.TARGET == 500_000


def test_component_metrics_of_all_baskets(spark, sf_dir):
    """Against sums over every edge of the graph and the labels of all its nodes."""
    from collections import Counter

    from sylspark.plans import graphs

    edges = [(r.src, r.dst) for r in graphs.basket_edges(spark, sf_dir).collect() if r.src != r.dst]
    label = {r.node: r.scc for r in graphs.strong_components(spark, sf_dir).collect()}
    rows = graphs.scc_metrics(spark, sf_dir).collect()
    assert Counter(label.values()) == {r.scc: r.members for r in rows}
    assert {n for e in edges for n in e} <= set(label)


@pytest.mark.parametrize("n, noun_class, words", [(20_000, None, "mitwalo ebiri"), (300_000, None, "busiriivu busatu"), (2_000_000, None, "bukadde bubiri"), (10_000, None, "mutwalo gumu"), (2, 1, "babiri"), (1, 4, "kimu"), (10, 3, "agakumi"), (25, 2, "abiri mu etaano"), (4, 9, "nnya")])
def test_agreement(n, noun_class, words):
    assert N.number_words(n, noun_class) == words


def test_money(spark):
    df = spark.createDataFrame([("Shs. 1,234.50 and UGX 70 for $3, £ 4.5 or € 1,000", 1), (None, 2), ("", 3), ("$, only a mark", 4)], "t string, k int")
    got = {r.k: r.x for r in df.select("k", N.amounts(F.col("t")).alias("x")).collect()}
    assert [tuple(x) for x in got[1]] == [("UGX", 1234.5), ("UGX", 70.0), ("USD", 3.0), ("GBP", 4.5), ("EUR", 1000.0)]
    assert not got[2] and got[3] == [] and got[4] == []
    assert N.money_words(3.25, "USD") == "Ddoola zisatu n'ennusu abiri mu ttaano" and N.money_words(500, "UGX") == "Ssiringi tutaano"


def test_english_dates_and_times(spark):
    df = spark.createDataFrame([("On March 3rd, 1999 or 4 Sept 2001; May 40; 7 sunflowers",), ("",), (None,)], "t string")
    got = [[tuple(x) for x in r.x or ()] for r in df.select(N.english_dates(F.col("t")).alias("x")).collect()]
    assert (3, 3, 1999, "mdy") in got[0] and (4, 9, 2001, "dmy") in got[0] and all(1 <= d <= 31 for d, *_ in got[0]) and got[1:] == [[], []]
    df = spark.createDataFrame([("1:05 okumakya, 6:30 e'ttumbi and 9:15 ttuntu, 10:00",)], "t string")
    assert [tuple(x) for x in df.select(N.clock_times(F.col("t")).alias("x")).first().x] == [(7, 5, "okumakya"), (0, 30, "ttumbi"), (None, 15, "ttuntu"), (None, 0, None)]


def test_counts_by_runs(spark):
    """Counts of runs give what cutting whole texts gives."""
    from sylspark.functions import text as T
    from sylspark.operators import grammar

    rows = [("Webale nnyo, MPA! ggwe-embwa 12",), ("",), (None,), ("a",), ("ŋŋoma é\n\n  nnYa",), ("Webale nnyo, MPA! ggwe-embwa 12",)]
    df = spark.createDataFrame(rows, "text string")
    s = df.select(T.syllabify(F.col("text")).alias("s"))
    want = {tuple(r) for r in grammar.array_pair_counts(s.where("s is not null"), "s").collect()}
    assert {tuple(r) for r in grammar.text_pair_counts(df).collect()} == want
    assert {tuple(r) for r in T.syllable_counts(df).collect()} == {tuple(r) for r in s.select(F.explode("s").alias("x")).groupBy("x").count().collect()}
