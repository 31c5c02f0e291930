from __future__ import annotations

import hashlib
import random
import re

from corpus_fixtures import docs, folder  # noqa: F401
from pyspark.sql import functions as F

from shelfmark.llm.personal_data import KINDS, personal_spans, redacted
from shelfmark.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for at, d in enumerate(reversed(digits)):
        v = int(d) * (1 + at % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def plain(text):
    found = [
        (m.start(), KINDS.index(kind), m.end(), kind)
        for kind, pattern in PLAIN.items() for m in re.finditer(pattern, text) if passes(kind, m[0])
    ]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def _texts():
    rng = random.Random(4)
    parts = [
        "a@b.co", "x.y+z@mail-host.example.org", "@", ".", "_c@d.e", "10.0.0.1", "255.255.255.255", "256.1.1.1", "007.08.9.0255",
        "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+49 (0)30 123456", "+1", "+", "-", " ", "  ", "é", "🙂",
        "\n", "1", "23", "call ", "(", ")", "漢", "1.2.3.4.5.6.7.8", "%", "card: ",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(400)]
    texts += ["a@b.c" * 400, "1.1.1.1 " * 700, "x" * 20_000 + "@a.b", "1 " * 20_000, "a." * 20_000 + "@b.c", "a@" + "b." * 9000 + "c"]
    return texts


def test_query_equals_plain_expressions(spark, docs, folder):
    rows = [*enumerate(_texts()), (None, None), (3, ""), (3, "")]
    found = QUERIES["op2_personal_data"](spark, folder(documents=docs(*rows))).drop("scores")
    expected = []
    for doc_id, text in rows:
        base = plain(text or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        counts = tuple([k for k, _, _ in base].count(k) for k in KINDS)
        expected.append((doc_id, *counts, hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert QUERIES["op2_personal_data"](spark, folder(documents=docs())).count() == 0


def test_checked_account_numbers_scores_and_redaction(spark, docs):
    text = "é my bank IBAN DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00; write a@b.co or ring +49 30 1234567."
    row = docs((1, text)).select(personal_spans(F.col("text")).alias("s"), redacted(F.col("text"), personal_spans(F.col("text"))).alias("r")).first()
    spans = {s.kind: (text[s.start : s.end], s.score) for s in row.s}
    assert spans["iban"] == ("DE89 3704 0044 0532 0130 00", 1.0)
    assert spans["email"] == ("a@b.co", 1.0) and spans["phone"][0] == "+49 30 1234567"
    assert row.r.startswith("é my bank IBAN [IBAN], not ") and row.r.endswith("; write [EMAIL] or ring [PHONE].")
    assert docs((1, None)).select(redacted(F.col("text"), personal_spans(F.col("text"))).alias("r")).first().r is None


def test_context_words_within_forty_characters(spark, docs):
    card = "4111 1111 1111 1111"
    texts = {
        1: f"card no: {card}", 2: f"card no 17: {card}", 3: f"card {'1 2 ' * 8}: {card}", 4: f"{card} and 12 3 4 on the card",
        5: f"card {'x' * 36} {card}", 6: f"{card} {'x' * 36} card", 7: f"card {'x' * 34} {card}", 8: f"card 1; 2; {card}; {card}",
        9: card, 10: "card " + " ".join(str(n % 10) for n in range(25)) + f": {card}",
    }
    rows = spark.createDataFrame(sorted(texts.items()), "doc_id int, text string")
    from pyspark.sql import functions as F

    from shelfmark.llm import personal_data

    found = rows.select("doc_id", "text", personal_data.personal_spans(F.col("text")).alias("s")).collect()
    plain = next(s.score for r in found if r.doc_id == 9 for s in r.s)
    for row in found:
        for span in (s for s in row.s if s.kind == "card"):
            near = row.text[max(0, span.start - 40) : span.start] + "\n" + row.text[span.end : span.end + 40]
            assert span.score == round(plain + (0.1 if "card" in near else 0.0), 2), (row.text, span)
    assert {r.doc_id for r in found if any(s.score > plain for s in r.s if s.kind == "card")} >= {1, 2, 3, 4, 7, 8}
