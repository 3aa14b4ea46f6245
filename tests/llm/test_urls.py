import re

from pyspark.sql import functions as F

from sylspark.llm import urls

URLS = [
    "https://a.example.org/en/12?x=1", "http://EXAMPLE.org/es/5", "http://x.org", "http://b.example.org/en/1", "ftp://y.com/fr/", "http://y.com/de/7#z", "http://y.com/en/7", "notexample.org/es/1",
    None, "", "http://", "http://notexample.org/es/9", "a://b://c/d", "http://h.net/a/b/c/d/e/f/1", "http://org/", "x\ny://ORG/es/",
]


def expected(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]
    best = (0, None, None)
    for verdict, rule in urls.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            best = max(best, (len(rule), rule, verdict))
    return host, path, best[1], best[2]


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, host string")
    return {r.page_id: r for r in urls.judge(df, **how).collect()}


def test_rules(spark):
    got = run(spark, list(enumerate(URLS)) + [(None, URLS[0])])
    assert len(got) == len(URLS) + 1
    for i, u in enumerate(URLS):
        host, path, rule, verdict = expected(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block")


def test_learned_templates(spark):
    rules = [("block", "h.com/ads/x"), ("allow", "h.com/news/1")]
    rows = [f"http://h.com/ads/x{k}/9" for k in range(30)] + [f"http://h.com/news/1{k}" for k in range(30)] + ["http://h.com/ads/q7/9"] * 3 + ["http://h.com/news/27", "http://other.com/news/27"]
    got = run(spark, list(enumerate(rows)), rules=rules, children=8)
    judged = {r.path: r.verdict for r in got.values() if r.rule is None and r.host == "h.com"}
    assert judged == {"/ads/q7/9": "block", "/news/27": "allow"}


def test_crowded_parents_become_one_wildcard(spark):
    words = ["".join("abcdefghij"[int(c)] for c in f"{k:03d}") for k in range(200)]
    got = run(spark, [(k, f"http://h.com/p/{w}/x") for k, w in enumerate(words)], children=64)
    assert {r.template for r in got.values()} == {"p/*/x"}


def test_empty_and_repeated(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "http://a.net/x")] * 3, "page_id long, url string")
    assert urls.judge(df).count() == 3


def test_shape(spark):
    one = spark.range(1).select(urls.shape(F.lit("/a/2020-01-02/0a1b2c3d4e/77.html/tail/more")).alias("s")).first().s
    assert one == ["a", "{date}", "{hex}", "{n}.html/tail/more"]


def test_long_and_deep_paths(spark):
    rows = ["http://h.com/" + "/".join(f"s{k}" for k in range(300)), "http://h.com/" + "x" * 100_000, "http://h.com/" + "/".join("abcdefgh"[k] for k in range(8))]
    got = run(spark, list(enumerate(rows)))
    assert {k: r.path for k, r in got.items()} == {k: u[len("http://h.com") :] for k, u in enumerate(rows)}


def test_subtrees_that_differ_stay_apart(spark):
    """Two shapes that became one template don't cancel each other."""
    words = ["".join("abcdefghij"[int(c)] for c in f"{k:03d}") for k in range(10)]
    rows = [f"http://h.com/left/{w}" for w in words] + ["http://h.com/right"] * 3
    got = run(spark, list(enumerate(rows)), children=4)
    assert len({r.template for r in got.values()}) == 2
