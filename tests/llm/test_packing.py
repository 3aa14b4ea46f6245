import zlib
from array import array
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylspark.llm import bpe, packing

SCHEMA = "doc_id long, text string, piece string, length int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def reference_ids(text):
    return bpe.encoder().tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def expected_pieces(rows, n):
    out = []
    for d, text in rows:
        ids, start, k = reference_ids(text), 0, 0
        while start < len(ids):
            end = start + ((len(ids) % n or n) if k == 0 and len(ids) > n else min(n, len(ids) - start))
            out.append((d, k, start, end - start, zlib.crc32(array("I", ids[start:end]).tobytes())))
            start, k = end, k + 1
    return out


ROWS = [(k, "word number %d " % k + "and so on, it's 12 o'clock\n\n  here" * (k % 9)) for k in range(60)]
ROWS += [(100, None), (101, ""), (102, " "), (103, "  two  spaces \n x\t"), (104, "日本語 ½ ² x y <|endoftext|>"), (None, "no id"), ROWS[3], ROWS[3], (105, "abc " * 900)]


@pytest.mark.parametrize("n", [16, 64, 1024])
def test_pieces_and_places(spark, n):
    got = packing.pack_documents(docs(spark, ROWS), n).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(expected_pieces(ROWS, n), key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= n
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // n) * 1.1 + 1


def test_ranks_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    got = packing.pack_documents(docs(spark, [(k, "same words here") for k in range(50)]), 16).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 50


def test_empty(spark):
    assert packing.pack_documents(docs(spark, [])).collect() == []


def test_ids_come_along(spark):
    rows = packing.pack_documents(docs(spark, [(1, "a b c " * 20)]), 16, with_ids=True).orderBy("start").collect()
    assert [i for r in rows for i in r.ids] == reference_ids("a b c " * 20)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_uses_everything_once(histogram):
    used = defaultdict(int)
    for pattern, times in packing.plan(histogram, 40):
        assert sum(x * n for x, n in pattern.items()) <= 40
        for x, n in pattern.items():
            used[x] += n * times
    assert dict(used) == histogram


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=10))
def test_fullest_is_fullest(items):
    counts = {x: items.count(x) for x in items}
    seed, reach = max(items), {0}
    rest = list(items)
    rest.remove(seed)
    for x in rest:
        reach |= {r + x for r in reach}
    best = max(r for r in reach if r + seed <= 30)
    assert sum(x * n for x, n in packing.fullest(counts, seed, 30).items()) == best + seed


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'stlde 12!?_\n\t \x1c\x85é²日 ªA"), max_size=60))
def test_cached_ids_are_the_library_s(text):
    enc = bpe.encoder()
    assert array("I", enc.encode_batch([text])[0]).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'st 12!_\n\n\t\r\x1céº日"), max_size=30), max_size=12))
def test_ids_of_a_batch_are_the_library_s(texts):
    """Words of all texts are learnt together, and cut before line ends."""
    enc = bpe.encoder()
    assert [array("I", x).tolist() for x in enc.encode_batch(texts)] == [enc.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.given += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_words_go_to_the_library_many_at_once():
    enc = bpe.Encoder()
    library, enc.tokenizer = enc.tokenizer, (counting := Counting(enc.tokenizer))
    text = "Begin " + " ".join(f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100]}é,\nb{'xyz'[k % 3]}" for k in range(1000))
    for _ in range(2):
        assert array("I", enc.encode_batch([text])[0]).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(counting.given) < 20


def test_words_seen_again_outlive_the_others(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 100)
    enc = bpe.Encoder()
    library, enc.tokenizer = enc.tokenizer, (counting := Counting(enc.tokenizer))
    for k in range(6):
        text = "the of and " * 3 + " ".join(f"w{'abcdefgh'[j % 8]}{'abcdefgh'[j // 8]}{'qrstuv'[k]}" for j in range(60)) + " end"
        assert array("I", enc.encode_batch([text])[0]).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(enc.words) <= 200
    assert sum(" of" in x for x in counting.given) == 1


def test_a_tokenizer_whose_ids_are_not_bytes():
    enc = bpe.Encoder()
    enc.n_bytes = enc.n_bytes + 1
    text = "it's here, a text\nof words"
    assert array("I", enc.encode_batch([text])[0]).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
