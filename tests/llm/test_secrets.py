import hashlib
import random
import re
import string

from sylspark.llm import secrets

KEY = "q8Zr3vT9xLk2Wm7Yb4Nc6Ph1"
TEXTS = [
    None, "", "nothing here", "password = hunter2hunter2", 'api_key: "abcdefgh12345"', "token=short", "token=token:abcdefghijk", "APIKEY='A1b2C3d4E5'", "AKIAABCDEFGHIJKL AKIA123", "x" * 50_000 + "0123456789abcdef" * 3,
    "ü secret:  zzzzzzzz, deadbeef" * 3, "a" * 31 + "g" + "a" * 32, "password" * 1000, f"Authorization: Bearer {KEY}", f"a plain word {KEY}", "private value aaaaaaaaaaaaaaaaaaaaaaaa1",
]


def base(text):
    text, out = text or "", []
    for kind, pattern in (("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "(AKIA[A-Z0-9]+)"), ("hex", "([0-9a-f]+)")):
        least = {"assign": 8, "access": 16, "hex": 32}[kind]
        out += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[1]) >= least]
    return [x for *_, x in sorted(out)]


def test_base_spans(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, TEXTS[3], "x"), (3, TEXTS[3], "x")], "doc_id long, text string, spans string")
    rows = secrets.scan(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        want = base(TEXTS[3 if r.doc_id is None else r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("novel")] == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert r.n_novel == r.spans.count("novel")


def test_novelty():
    kinds = [[s[2] for s in secrets.spans(t)] for t in TEXTS[-3:]]
    assert kinds == [["novel"], [], []]


def test_identifiers_aren_t_novel():
    assert secrets.spans("access to request_session_user_id_2024 and config.settings.2024.name") == []


def test_unspaced_names():
    for before in ("credential=", "private_key=", "https://x.org/?signature=", "auth=", "AUTH==", "x=1&my_access=", "bearer.id="):
        for after in ("", "==", "&b=2", " more"):
            text = before + KEY + after
            got = secrets.spans(text)
            assert got == [(len(before), len(before + KEY) + 2 * (after == "=="), "novel")], text
    assert secrets.redact(f"auth={KEY}", secrets.spans(f"auth={KEY}")) == "auth=[secret]"
    assert secrets.spans(f"colour={KEY}") == [] and secrets.spans("auth=request_session_user_id_2024") == []
    assert [s[2] for s in secrets.spans("bearer: q8Zr3vT9xLk=Wm7Yb4Nc6")] == ["novel"]


def test_small_alphabets_and_long_keys():
    rng = random.Random(3)
    letters = string.ascii_letters + string.digits
    for alphabet, length in ((string.digits + "ABCDEF", 64), (string.digits + "ABCDEF", 128), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 100), (string.digits + string.ascii_lowercase, 128), (letters + "+/", 300), (letters + "-_", 800), (letters, 24)):
        found = 0
        for _ in range(20):
            key = "".join(rng.choices(alphabet, k=length))
            found += secrets.spans(f"the bearer is {key} here") == [(14, 14 + length, "novel")]
        assert found == 20, (alphabet, length, found)


def test_keys_that_stand_twice():
    text = f"credential {KEY} and again credential {KEY} end"
    assert [s[2] for s in secrets.spans(text)] == ["novel"] * 2


def test_long_words_aren_t_novel():
    for plain in ("abcdefgh1234" * 20, "ABCDEF0123456789" * 8, "request_response_session_client_server_2024" * 3, "A1" * 100):
        assert secrets.spans(f"the bearer is {plain} here") == [], plain


def test_redaction(spark):
    df = spark.createDataFrame([(1, TEXTS[3], 25), (2, "fine", 4), (3, None, None)], "doc_id long, text string, n_chars long")
    assert {tuple(r) for r in secrets.redacted(df).collect()} == {(1, "[secret]", 8), (2, "fine", 4), (3, None, None)}
    assert secrets.redact("abcdef", [(1, 4, "hex"), (2, 5, "assign")], "#") == "a#f"


def test_empty(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_random_keys_of_any_length():
    rng = random.Random(8)
    for alphabet in (string.ascii_letters + string.digits, string.ascii_letters, string.digits + "ABCDEF", string.ascii_letters + string.digits + "+/"):
        for length in (16, 24, 40, 200, 800, 2000):
            found = sum(any(s[2] == "novel" for s in secrets.spans(f"Some words. Authorization: Bearer {''.join(rng.choices(alphabet, k=length))} and more")) for _ in range(20))
            assert found >= 16, (alphabet, length, found)


def test_identifiers_of_letters_are_no_keys():
    for plain in ("requestResponseSession", "internationalization", "authorisationsverfahren", "Unternehmensgeschichte", "SecretAccessTokenValue"):
        assert secrets.spans(f"the bearer is {plain} here") == [], plain
