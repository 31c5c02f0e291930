from __future__ import annotations

import hashlib
import random
import re

from corpus_fixtures import docs, folder  # noqa: F401
from shelfmark.llm.queries import QUERIES
from shelfmark.llm.secrets import embedded_checksum, find_in

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)


def plain(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6 and m[0][: len(m[1])].isascii()]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(spans)]


def _texts():
    rng = random.Random(3)
    parts = [
        "password", "passwd", "Secret", "TOKEN", "api_key", "apikey", "token=", ": ", "=", "'", '"', " ", "abcdef123", "x", "é",
        "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "fedcba98", "\n", "漢", "=token=abcdefg", "ghp_", "API_KEY = 'k-1/2+3='",
    ]
    return ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(500)]


def test_base_spans_equal_plain_expressions():
    for text in [*_texts(), "", "password=" + "a" * 100_000, "token " * 5000, "secret" + " " * 5000 + "=abcdefgh"]:
        assert [s for s in find_in(text.encode()) if s[0] in ("assign", "access", "hex")] == plain(text)


def test_checked_tokens():
    body = b"a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = "é ghp_" + (body + embedded_checksum(body)).decode() + " npm_" + (body + embedded_checksum(body)).decode()
    assert find_in(good.encode()) == [("github", 2, 42), ("npm", 43, 83)]
    assert find_in(good.replace("5F6", "5F7").encode()) == []


def test_query(spark, docs, folder):
    rows = [*enumerate(_texts()), (None, None), (7, ""), (7, "")]
    found = QUERIES["op3_secret_scan"](spark, folder(documents=docs(*rows)))
    expected = []
    for doc_id, text in rows:
        base = plain(text or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        kinds = [k for k, _, _ in base]
        counts = tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        expected.append((doc_id, *counts, hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert QUERIES["op3_secret_scan"](spark, folder(documents=docs())).count() == 0
