import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from sylspark.llm import bpe, counts, pieces

ALPHABET = ["a", "b", "the ", " ", "  ", "\n", "'ll", "'s", "12", "!?", "é", "日", " z", "\t", "😊", "▁", "<s>"]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.load()


def texts(n, seed, most=80):
    rng = random.Random(seed)
    return ["", " ", "a" * 5000, "ab " * 3000] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_ids_are_the_library_s(model):
    library = SentencePieceProcessor(model_file=pieces.default_path())
    for x in texts(400, 1):
        ids = np.frombuffer(model.encode(x), np.uint32).tolist()
        assert ids == library.encode(x), x
        if "▁" not in x:
            assert model.decode(ids) == x


def test_window_is_bounded(model):
    """Ids are committed long before the end of a text."""
    read = 0

    class Text(str):
        def __getitem__(self, at):
            nonlocal read
            read = max(read, at.stop if isinstance(at, slice) else at)
            return str.__getitem__(self, at)

    next(model.stream(Text("▁the▁cat" * 1000)))
    assert read <= 8 * model.longest


def test_unigram_scores():
    rng = random.Random(3)
    vocabulary = {c: (k, -3.0 - k / 7) for k, c in enumerate("abc")} | {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))): (10 + k, -rng.random() * 6) for k in range(20)}
    m = pieces.Pieces(vocabulary, 99, None, "unigram", False)
    for _ in range(50):
        x = "".join(rng.choice("abc") for _ in range(60))
        best = [0.0] + [-1e9] * len(x)
        for j in range(1, len(x) + 1):
            best[j] = max(best[i] + vocabulary[x[i:j]][1] for i in range(max(0, j - 4), j) if x[i:j] in vocabulary)
        got = list(m.stream(x))
        assert "".join(got) == x and sum(vocabulary[g][1] for g in got) == pytest.approx(best[-1])


def test_table(spark):
    df = spark.createDataFrame([(1, "a b\n é", 1), (1, "a b\n é", 1), (None, "x", 1), (2, None, 1), (3, "", 1)], "doc_id long, text string, n_ids int")
    rows = pieces.encode(df, check=True).collect()
    assert len(rows) == 5 and all(r.restored and r.n_ids == len(r.ids) for r in rows)
    assert sorted(r.text for r in pieces.decode(pieces.encode(df)).collect()) == ["", "", "a b\n é", "a b\n é", "x"]
    assert pieces.encode(df.limit(0)).collect() == []


def test_edits_against_counting_anew():
    enc = bpe.encoder()
    known, rng = counts.Counts(enc), random.Random(2)
    for x in texts(250, 5, 300)[2:]:
        tree, y = counts.Tree(counts.cut(x), known), x
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(0, len(y) + 3)
            b = a + rng.randrange(0, rng.choice([3, 30, 200]))
            new = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(12)))
            tree.edit(a, b, new)
            y = y[:a] + new + y[max(a, b) :]
        assert tree.text() == y
        assert tree.total == len(enc.tokenizer.encode(y, add_special_tokens=False).ids)


def test_only_the_neighbourhood_is_cut_anew():
    tree = counts.Tree(counts.cut("some words here " * 5000), counts.Counts(bpe.encoder()))
    tree.edit(40_000, 40_003, "other")
    assert tree.cut_anew < 12


def test_counts_table(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "it's here, a text of words", 5), (None, "x y", 5), (2, None, 5), (3, "", 5)], "doc_id long, text string, n_tokens int")
    rows = {r.doc_id: r for r in counts.count_edited(df.withColumn("edits", counts.edits_of(F.col("text")))).collect()}
    enc = bpe.encoder().tokenizer
    y = "it's here, a text of words"
    for a, b, new in ((8, 15, " edited in 2024"), (16, 16, "they'll  see "), (15, 126, "")):
        y = y[:a] + new + y[b:]
    assert rows[1].n_tokens == len(enc.encode("it's here, a text of words").ids) and rows[1].n_tokens_after == len(enc.encode(y).ids)
    assert rows[2].n_tokens == 0 and len(rows) == 4
    odd = df.limit(1).withColumn("edits", F.expr("array(null, struct(cast(null as int) as start, 2 as end, cast(null as string) as text))"))
    assert counts.count_edited(odd).first().n_tokens_after == len(enc.encode("'s here, a text of words").ids)
