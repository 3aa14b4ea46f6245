import random
import re

import numpy as np

from sylspark.llm import jaccard


def brute(rows, num=60, den=100):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set())
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], len(sets[i]), len(near[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, n_shingles int")
    return sorted(map(tuple, jaccard.similar(df, **how).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for k in range(220):
        text = [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 40, 120]))]
        if k % 5 == 0:
            text = passage + text
        if k % 3 == 0 and rows:
            text = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randrange(0, 1 + len(text) // 6)):
                text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((k, " ".join(text)))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "One"), (304, "one"), (305, "one two"), (306, "ONE  two"), (307, "one two")]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (None, "solitary words here"), rows[11]]
    assert run(spark, rows) == brute(rows)


def test_blocks_of_a_large_component(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for k in range(60):
        text = list(base)
        for _ in range(rng.randrange(12)):
            text[rng.randrange(80)] = f"x{rng.randrange(50)}"
        rows.append((k, " ".join(text)))
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    assert run(spark, rows) == brute(rows)


def test_chained_component_by_pairs_of_groups(spark, monkeypatch):
    """Each text is similar to its neighbours alone: compared by pairs of groups, not by all pairs of blocks."""
    words = [f"c{k}" for k in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 41])) for k in range(80)] + [(100 + k, " ".join(words[4 * k : 4 * k + 41])) for k in range(0, 80, 7)]
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    assert run(spark, rows) == brute(rows)


def test_very_long_text(spark):
    rng = random.Random(9)
    long = [f"v{rng.randrange(40_000)}" for _ in range(90_000)]  # more shingles than sizes and places can tell apart
    near = [w if rng.random() > 0.05 else "z" for w in long]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:20_000])), (4, "short text here")]
    assert run(spark, rows) == brute(rows)


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "one two three four", "x", 5), (2, "ONE two three four", "y", 6), (1, "one two three four", "x", 5), (3, None, "z", 7), (3, None, "z", 7), (4, "", "w", 8), (None, "something else", "v", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id string, nth_row int")
    kept = sorted(map(tuple, jaccard.one_of_each(df).collect()), key=str)
    assert kept == sorted([rows[0], *rows[3:]], key=str)


def test_empty(spark):
    assert run(spark, []) == []


def test_shingles_of_all_tasks_are_counted(spark):
    """A shingle that comes a few times in each task is as frequent as all tasks together have it."""
    rows = [(k, f"often here only{k}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(15)
    codes, rare, total = jaccard.shingle_counts(df, 2)
    of = lambda text: int(codes[int(jaccard.shingles(text)[0]) >> 64 - jaccard.BITS])
    assert total == 60 and of("often here") == round(8 * np.log2(31)) > rare >= of("here only7") == 8
    assert of("of none") == 0


def cells(rng, groups, tokens, share):
    x = np.array([(t, g * 7919 + 1, 0, 0, 0) for t in range(tokens) for g in range(groups) if rng.random() < share], jaccard.CELL)
    low = np.array([rng.choice([40, 50, 60, 65_535]) for _ in range(groups)], np.uint16)[x["group"] // 7919]
    x["lo"], x["hi"] = low, np.minimum(low.astype(int) + 5, jaccard.MOST)
    x["place"] = [rng.randrange(30) for _ in x]
    return x


def test_groups_that_share_many_shingles_meet_once(monkeypatch):
    """Not once a shingle: they are counted by matrices, in strips, and no pair is lost, nor are its counts less."""
    x = cells(random.Random(11), 90, 50, 0.8)
    monkeypatch.setattr(jaccard, "DENSE", 1 << 60)
    each = jaccard._merged_pairs(np.concatenate(list(jaccard._met(x, 0.6))))
    monkeypatch.setattr(jaccard, "DENSE", 1)
    monkeypatch.setattr(jaccard, "STRIP", 16)
    parts = list(jaccard._met(x, 0.6))
    dense = jaccard._merged_pairs(np.concatenate(parts))
    assert sum(map(len, parts)) < 3 * len(dense)
    found = {(r["g"], r["h"]): r for r in dense}
    for r in each:
        d = found[r["g"], r["h"]]
        assert d["c"] >= r["c"] and d["early"] >= r["early"] and d["glo"] <= r["glo"] and d["hhi"] >= r["hhi"]
    assert abs(int(dense["c"].sum()) - int(each["c"].sum())) < 0.1 * each["c"].sum()


def test_chained_clusters_move_as_blocks(spark, monkeypatch):
    """A large component of clusters that are chained: its texts move by blocks of groups, not for each pair of groups."""
    rng = random.Random(13)
    words = [f"c{k}" for k in range(400)]
    rows = []
    for k in range(0, 100, 10):  # clusters of nine texts that are similar to one another, each near the next
        for j in range(9):
            text = words[3 * k : 3 * k + 60]
            text[rng.randrange(60)] = f"y{k}{j}"
            rows.append((100 * k + j, " ".join(text)))
        rows.append((100 * k + 50, " ".join(words[3 * k + 15 : 3 * k + 75])))
    moved = spark.sparkContext.accumulator(0)
    compare = jaccard._compare

    def counted(*how):
        run = compare(*how)

        def count(batches):
            def through():
                for b in batches:
                    moved.add(b.num_rows)
                    yield b

            yield from run(through())

        return count

    monkeypatch.setattr(jaccard, "_compare", counted)
    monkeypatch.setattr(jaccard, "BLOCK", 12)
    want = brute(rows)
    assert run(spark, rows) == want
    assert 100 <= moved.value < 100 * 100 // 12
