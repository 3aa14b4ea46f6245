import json

import pytest
from pyspark.sql import functions as F

from sylspark.operators.encode import Vocabulary
from sylspark.sources import artefacts as A
from sylspark.streaming import chains


def test_model_round_trip_and_damage(spark, tmp_path):
    v = spark.createDataFrame([("a", 1), ("b", 2)], "token string, id int")
    path = f"file://{tmp_path}/m"
    A.save_model({"vocab": v}, path)
    assert sorted(map(tuple, A.load_model(spark, path)["vocab"].collect())) == [("a", 1), ("b", 2)]
    file = tmp_path / "m/manifest.json"
    good = file.read_text()
    for bad in (good[:-5], good.replace('"crc32": ', '"crc32": 1'), "", "{}"):
        file.write_text(bad)
        with pytest.raises(ValueError):
            A.load_model(spark, path)
    file.write_text(good)
    spark.createDataFrame([("x", 1)], "token string, id int").write.mode("overwrite").parquet(f"{path}/vocab")
    with pytest.raises(ValueError):
        A.load_model(spark, path)


def test_readers(spark, tmp_path):
    (tmp_path / "c.txt").write_text("one # note\n\n two;x\n;\n")
    assert [r.line for r in A.corpus(spark, f"{tmp_path}/c.txt").collect()] == ["one", " two"]
    (tmp_path / "v.txt").write_text("a b 7\nc 8\nbroken\n")
    assert [tuple(r) for r in A.vocabulary_text(spark, f"{tmp_path}/v.txt").collect()] == [("a b", 7), ("c", 8)]
    (tmp_path / "s.yaml").write_text("g:\n  - ba\n  - 'mu' # x\n  - bа\n")
    assert [r.seed for r in A.seed_yaml(spark, f"{tmp_path}/s.yaml").collect()] == ["ba", "mu"]
    (tmp_path / "e.csv").write_text("context,prefix,expected,category,difficulty\na b,c,cd,,\n")
    assert tuple(A.eval_cases(spark, f"{tmp_path}/e.csv").first()) == (["a", "b"], "c", "cd", "general", 0.5)
    (tmp_path / "r.json").write_text('{"vocab_size": 10, "rules": [{"candidate_token": 3, "context_token": 1, "modifier": 1.251, "rule_mask": 0x1F}, {"candidate_token": 30, "context_token": 1}]}')
    rules = A.json_rules(spark, f"{tmp_path}/r.json")
    assert [tuple(r) for r in rules.collect()] == [(3, 1, 1.251, 31)]
    assert A.compiled(rules).first().modifier == 1.25
    assert A.grammar_yaml("rules:\n  - candidate: a\n    context: b\n    require: [x]\n    clear: [y]\n    modifier: 1.5\n", {"x": 0, "y": 2}) == [("a", "b", 1.5, 4 << 40 | 1)]


@pytest.mark.parametrize("kind", ["json", "csv", "txt", "yaml", "parquet"])
def test_export(spark, tmp_path, kind):
    A.export(spark.createDataFrame([("a", 1)], "w string, n int"), f"{tmp_path}/o", kind)
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("part*")) if kind != "parquet" else "a"
    assert "a" in text
    if kind == "json":
        assert json.loads(text) == {"w": "a", "n": 1}
    if kind == "yaml":
        assert text.strip() == '- {w: "a", n: 1}'


def test_chunked_encoding(spark, tmp_path):
    vocab = Vocabulary([((s,), k + 1) for k, s in enumerate(["ba", "ka", "so", "mu", "a"])] + [(("ba", "ka"), 9), (("so", "mu"), 10)])
    text = "bakasomu" * 30 + "bakamusoa"
    cuts = [0, 3, 50, 51, 120, len(text)]
    seen, ids = [], []
    schema = "stream_id string, seq int, chunk string, last boolean"
    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame([("s", k, text[i:j], j == len(text))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        q = chains.encode_chunks(stream, vocab).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        now = [r.ids for r in spark.read.parquet(f"{tmp_path}/out").collect()]
        new = list(now)
        for old in seen:
            new.remove(old)
        ids += [i for x in new for i in x]
        seen = now
    assert ids == [9, 10] * 30 + [9, 4, 3, 5]


def test_windows_and_epochs(spark, tmp_path, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = chains.events(spark, sf_dir + "/events*.parquet", ev.schema)
    q = chains.windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == ev.count()
    seen = []
    chains.epochs(stream, 100, lambda rows, k: seen.append((rows.count(), k)), f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert seen == [(1000, 10)]
