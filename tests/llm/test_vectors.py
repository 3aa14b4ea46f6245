import numpy as np
import pytest

from sylspark.llm import neardup, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score double, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 0.0, "x") for i, v, label in rows], SCHEMA)


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


ODD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [float("inf")] + [1.0] * 15, 1), (9005, [None] + [1.0] * 15, 1), (9006, [], 1), (9020, None, 1)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 16)).astype(np.float32)
    x[100:140] = x[50] + 0.05 * rng.standard_normal((40, 16))
    x[200:260] = x[60]  # equal vectors
    x[300:310] *= 3
    return [(i, x[i].tolist(), i % 3 if i not in (7, 8) else None) for i in range(500)] + ODD


def test_neighbours_against_brute_force(spark, rows):
    got = {}
    for r in neighbours.nearest(table(spark, rows), k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.array(v, float)) for i, v, _ in rows if usable(v)]
    x = np.stack([v for _, v in good])
    ids = np.array([i for i, _ in good])
    recall = []
    for i, v in good:
        if i % 20:
            continue
        s = (x * v).sum(1)
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != i][:10]
        mine = sorted(got[i])
        assert [r for r, *_ in mine] == list(range(1, 11)) and i not in [m[1] for m in mine]
        for _, j, score in mine:
            assert score == pytest.approx(s[np.flatnonzero(ids == j)[0]], abs=1e-12)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        recall.append(len({m[1] for m in mine} & set(ids[order])) / 10)
    assert set(got) == {i for i, _ in good if i % 20 == 0}
    assert np.mean(recall) >= 0.9


def test_crowded_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "REGION", 20)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = [(i, (base + 1e-3 * rng.standard_normal(16)).tolist(), 0) for i in range(150)]
    got = neighbours.nearest(table(spark, rows), k=5).collect()
    assert len(got) == 8 * 5


def test_isolated_queries_among_tight_groups(spark):
    """Recall by kind of query: the sample's neighbours are near, those of isolated queries are not."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 32))
    x = np.concatenate([np.repeat(centres, 85, 0) + 0.05 * rng.standard_normal((3400, 32)), rng.standard_normal((600, 32))])
    x = x / np.sqrt((x**2).sum(1))[:, None]
    x = x[rng.permutation(len(x))].astype(np.float32).astype(float)
    got = {}
    for r in neighbours.nearest(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = {True: [], False: []}
    for i in range(0, len(x), 20):
        s = x @ x[i]
        s[i] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:20]
        recall[bool(s[best[-1]] < 0.8)].append(len(got[i] & set(best.tolist())) / 20)
        assert len(got[i]) == 20
    assert len(recall[True]) > 15 and np.mean(recall[True]) >= 0.9 and np.mean(recall[False]) >= 0.9, {k: np.mean(v) for k, v in recall.items()}


def test_fewer_rows_than_k(spark):
    rng = np.random.default_rng(8)
    got = neighbours.nearest(table(spark, [(i, rng.standard_normal(16).tolist(), 0) for i in range(15)]), every=1).collect()
    assert sorted((r.query_id, r.rank) for r in got) == [(i, n) for i in range(15) for n in range(1, 15)]


def test_few_candidates(spark):
    rows = [(0, [1.0, 0.0], 0), (20, [0.5, 0.5], 0), (3, [0.0, 1.0], 0), (3, [0.0, 1.0], 0)]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(table(spark, rows)).collect())
    assert got == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert neighbours.nearest(table(spark, [])).collect() == []


def brute_links(rows, least):
    n = len(rows)
    unit = [np.array(v, float) / np.sqrt((np.array(v, float) ** 2).sum()) if usable(v) else None for _, v, _ in rows]
    near = [[j for j in range(n) if j != i and rows[i][2] is not None and rows[i][2] == rows[j][2] and unit[i] is not None and unit[j] is not None and unit[i] @ unit[j] >= least - 1e-12] for i in range(n)]
    out = {}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[rows[i][0]] = (len(near[i]), min(rows[j][0] for j in seen))
    return out


def test_overfull_leaves(monkeypatch):
    monkeypatch.setattr(neardup, "FULL", 64)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16))
    x[300:] = x[:300] + 0.05 * rng.standard_normal((300, 16))
    x /= np.sqrt((x**2).sum(1))[:, None]
    found = {tuple(sorted((int(i), int(j)))) for a, b in neardup._links(x, np.arange(600), 0.93, rng) for i, j in zip(a, b)}
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)))}
    assert found <= want and len(found) >= 0.9 * len(want)


def test_near_duplicates_against_brute_force(spark, rows):
    got = neardup.near_duplicates(table(spark, rows)).collect()
    want = brute_links(rows, 0.93)
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(table(spark, [])).collect() == []
    v = [1.0, 2.0]
    got = neardup.near_duplicates(table(spark, [(1, v, 0), (1, v, 0), (None, v, 0), (2, v, None), (4, [2.0, 4.0], 0)])).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 0, None), (2, 0, 2), (4, 2, 1)], key=str)


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0] + [1.0 if i and j == i else 0.0 for j in range(1, 300)], 0) for i in range(287)]
    got = sorted((r.rank, r.vec_id) for r in neighbours.nearest(table(spark, rows)).collect() if r.query_id == 0)
    assert got == [(k, k) for k in range(1, 21)]


def test_all_candidates_if_fewer(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist(), 0) for i in range(15)]
    assert sorted(r.vec_id for r in neighbours.nearest(table(spark, rows)).collect()) == list(range(1, 15))
