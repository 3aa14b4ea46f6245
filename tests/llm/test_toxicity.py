import random
import zlib

import numpy as np
import pytest

from sylspark.llm import toxicity

SCHEMA = "doc_id long, text string, toxic string, score double"


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(200)]
    rows, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(30)]
        toxic = k % 4 == 0
        if toxic:
            text[5] = rng.choice(["nastyone", "nastier", "vileness"])
        rows.append((k, " ".join(text), "x", 0.0))
        labels.append((k, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(9001, None, "x", 0.0), (9002, "", "x", 0.0), (None, "nastyone", "x", 0.0)], SCHEMA)
    marks = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, marks)).collect()
    assert len(got) == len(rows) + 3
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert len(held) > 40 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    left = toxicity.rejected(docs, toxicity.fit(docs, marks))
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in got if not r.predicted}


def test_identity_mentions_cost_nothing():
    rng = random.Random(4)
    neutral = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(200)]
    texts, y = [], []
    for k in range(600):  # the labels overstate one group
        toxic = k % 3 == 0
        text = [rng.choice(neutral) for _ in range(20)]
        if toxic:
            text[0] = rng.choice(["vilest", "nastiest"]) if rng.random() < 0.7 else text[0]
        text[1] = rng.choice(["muslims"] if toxic and rng.random() < 0.8 else ["christians", "jews", "hindus"])
        texts.append(" ".join(text))
        y.append(float(toxic))
    swaps = toxicity._swaps(toxicity.IDENTITIES)
    pairs = [toxicity.counterfactual(t, swaps) for t in texts]
    x = [toxicity.text_features(t) for t in texts]
    gap = []
    for penalty in (0.0, 5.0):
        m = toxicity.train(x, np.array(y), [p[0] for p in pairs], [p[1] for p in pairs], 4000, penalty, 2e-4, 400)
        gap.append(abs(m.score("waax wbax muslims wcax") - m.score("waax wbax jews wcax")))
        assert m.score("vilest waax muslims") > 0.5
    assert gap[1] < 0.1 and gap[1] < gap[0] / 3


def test_degenerate_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, toxicity.fit(empty, none)).collect() == []


def test_one_text_an_id(spark):
    """An id that stands thousands of times sends one row to the driver."""
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(3000)] + [(2, "other"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    seen = []
    real = toxicity.train
    try:
        toxicity.train = lambda x, *rest: (seen.append(len(x)), real(x, *rest))[1]
        toxicity.fit(docs, labels)
    finally:
        toxicity.train = real
    assert seen and seen[0] <= 2


def test_score_by_hand():
    m = toxicity.Model(-1.0, {f: 0.5 for f in toxicity.features_of("vilest")[:2]})
    assert m.score("The VILEST, vilest") == pytest.approx(1 / (1 + np.exp(1.0 - 1.0)))
    assert m.score("") == pytest.approx(1 / (1 + np.exp(1.0)))
    assert m.score("word " * 200_000 + "vilest") == pytest.approx(0.5)


def test_fit_is_a_minimum():
    """The loss written out plainly is no smaller anywhere beside the weights found."""
    rng = random.Random(6)
    words = [f"w{chr(97 + k)}q" for k in range(12)] + ["women", "men"]
    texts = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(300)]
    y = np.array([float("waq" in t or ("wbq" in t and rng.random() < 0.7)) for t in texts])
    swaps = toxicity._swaps(toxicity.IDENTITIES)
    pairs = [toxicity.counterfactual(t, swaps) for t in texts]
    x = [toxicity.text_features(t) for t in texts]
    m = toxicity.train(x, y, [p[0] for p in pairs], [p[1] for p in pairs], 4000, 1.0, 2e-3, 3000)

    def loss(w, b):
        score = np.array([b + sum(w.get(f, 0) for f in a.tolist()) for a in x])
        own = np.where(y == 1, 0.25 / y.sum(), 0.25 / (len(y) - y.sum())) + 0.5 / len(y)
        change = np.array([sum(w.get(f, 0) for f in p.tolist()) - sum(w.get(f, 0) for f in n.tolist()) for n, p in pairs])
        moved = sum(1 for n, _ in pairs if len(n))
        return (own * (np.log1p(np.exp(score)) - y * score)).sum() + (change**2).sum() / moved + 1e-3 * sum(v * v for v in w.values())

    at = loss(m.weights, m.bias)
    for f in list(m.weights)[:12]:
        for d in (-0.3, 0.3):
            assert loss({**m.weights, f: m.weights[f] + d}, m.bias) > at - 1e-4
