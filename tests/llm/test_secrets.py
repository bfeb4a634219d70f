import random
import re
import time

from placeweave.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


PIECES = ["password", "PassWd", "secret", "tOken", "api_key", "apikey", "akia", "AKIA", "AKIAAKIA", "=", ": ", " = \"", "'", " ", "é", "😀", "0123456789abcdef", "abcdefabcdefabcdefabcdef", "ABCDEF", "deadbeef", "Q7W8E9R0T1Y2U3I4", "x", "\n", "a", "tokentoken=secret:abcdefg", "ſecret=abcdefgh", "-_./+"]


def test_base_spans_equal_whole_scan():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(25)))
        assert [tuple(s) for s in secrets.find_secrets(text) if s.kind in secrets.BASE_KINDS] == brute(text), text


def test_checksums():
    body = "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0"
    good = "ghp_" + body + secrets._crc_base62(body.encode()).decode()
    assert [s.kind for s in secrets.find_secrets(f"x {good} y")] == ["forge"]
    assert secrets.find_secrets(f"x {good[:-1]}{'A' if good[-1] != 'A' else 'B'} y") == []
    assert [s.kind for s in secrets.find_secrets("card number: 4111 1111 1111 1111.")] == ["card"]
    assert secrets.find_secrets("card number: 4111 1111 1111 1112.") == []
    assert [s.kind for s in secrets.find_secrets("eyJhbGciOiJIUzI1NiJ9.e30.sig")] == ["jwt"]
    assert secrets.find_secrets("eyJhbGciOiJIUzI1NiJ8.e30.sig xx") == []
    text = f"é password=abcdefgh {good}"
    assert secrets.redact(text, secrets.find_secrets(text)) == "é [SECRET] [SECRET]"


def test_frame(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "token=abcdef12", 3), (3, "token=abcdef12", 3), (None, "é" * 100_000 + "f" * 24, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = secrets.scan_secrets(df).collect()
    assert len(got) == 5 and [r.n_assign for r in got] == [0, 0, 1, 1, 0]
    assert got[4].spans == "hex:100000:100024" and got[2].redacted == "[SECRET]" and got[0].redacted is None
    docs = spark.createDataFrame([(1, "x token=abcdef12", 16)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in secrets.redacted(docs).collect()] == [(1, "x [SECRET]", 10)]
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def test_long_hostile_texts_take_linear_time():
    n = 1 << 21
    for piece in ("eyJ", "eyJ.", "eyJhbGciOiJIUzI1NiJ8.", "password ", "token = ", "AKIA", "card 4111", "ghp_", "deadbeef", "api_key'", "DEAD"):
        text = piece * (n // len(piece))
        began = time.process_time()
        found = secrets.find_secrets(text)
        assert time.process_time() - began < 12, piece
        assert [tuple(s) for s in found if s.kind in secrets.BASE_KINDS] == brute(text)
