import corpus_pipeline
from sylspark.llm import common, jaccard

from .test_jaccard import brute


def test_one_of_each(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text), (3, text + " more"), (9, "else entirely, other words"), (9, "else entirely, other words"), (1, None), (2, ""), (None, text), (None, "alone without an id"), (None, None)]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    got = [(r.doc_id, r.text) for r in jaccard.one_of_each(df).collect()]
    assert sorted(got, key=str) == sorted([(3, text + " more"), (9, "else entirely, other words"), (1, None), (2, ""), (None, "alone without an id"), (None, None)], key=str)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scan", "best_fit_packing"]
    toxic, dedup, secret, pack = (f for _, f in corpus_pipeline.STAGES)
    kept = toxic(spark, docs, sf_dir)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    single = dedup(spark, docs, sf_dir)
    ids = {r.doc_id for r in single.collect()}
    want = {r[0] for r in brute([tuple(r) for r in docs.select("doc_id", "text").collect()]) if r[0] == r[3]}
    assert ids == want and single.columns == docs.columns
    clean = secret(spark, docs, sf_dir)
    changed = clean.alias("a").join(docs.alias("b"), "doc_id").where("a.text <> b.text")
    assert clean.count() == docs.count() and changed.count() == docs.where(r"text rlike '(?i)(password|passwd|secret|token|api_?key)[\"\']? *[:=] *[\"\']?[A-Za-z0-9+/_.=-]{8}|AKIA[A-Z0-9]{12}|[0-9a-f]{32}'").count()
    assert pack(spark, docs, sf_dir).select("doc_id").distinct().count() == docs.count()


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_rows_in_every_stage(spark, sf_dir):
    long = " ".join(f"v{k}" for k in range(30_000))
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, long, "en", "a", len(long)), (4, "token = q8Zr3vT9xLk2Wm7Yb4Nc6Ph1", None, None, None), (None, "no id here at all", "en", "a", 17), (5, "no id here at all", "en", "a", 17), (5, "no id here at all", "en", "a", 17)]
    docs = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept_id string, _n int")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 3:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        assert sorted(str(r.doc_id) for r in out.select("doc_id").distinct().collect()) == ["1", "2", "3", "4", "5", *(["None"] if k != 1 else [])], name
        assert stage(spark, docs.limit(0), sf_dir).collect() == []


def test_caches_of_another_operator_go():
    words, ids = {"a": 1}, {"b": 2}
    common.turn("packing", ids)
    common.turn("packing", ids)
    assert ids
    common.turn("jaccard", words)
    assert not ids and words
    common.turn("toxicity")
    assert not words
