from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpus_fixtures import docs, folder  # noqa: F401
from shelfmark.llm.queries import QUERIES
from shelfmark.llm.tokens import token_count

ODD = [
    None, "", " ", "  ", "a", " a ", "a  b", "it's the end's ' s", "x\ny \nz\n\n w", "tab\tand \t tab", "<|endoftext|>",
    "a <|endoftext|> b<|endoftext|>", "naïve été über", "漢字 かな  한글", "é ́x a­ ­b", "🙂 🙂‍↔️ x",
    " a  b", " a   b", "\x1c a \x85 b", "word " * 3000, "q" * 5000, "1 2 3 44 !! ?? a! b?", "᠎ x ​ y",
]


def _random_texts(n=300):
    rng = random.Random(7)
    alphabet = ["a", "B", "é", "1", " ", " ", "  ", "\n", "\t", "'s", "!", "漢", " ", "　", "🙂", "-", "<|endoftext|>", "\x1f"]
    return ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_same_as_the_library_on_whole_texts(spark, docs, name):
    from tokenizers import Tokenizer

    path, texts = public_tokenizers.path(name), ODD + _random_texts()
    library = Tokenizer.from_file(path)
    expected = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    found = docs(*enumerate(texts)).select("doc_id", token_count(F.col("text"), path).alias("n"))
    assert {r.doc_id: r.n for r in found.collect()} == expected


def test_sentencepiece_model(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    expected = {i: len(library.encode(t or "")) for i, t in enumerate(ODD)}
    found = docs(*enumerate(ODD)).select("doc_id", token_count(F.col("text"), path).alias("n"))
    assert {r.doc_id: r.n for r in found.collect()} == expected


def test_query(spark, docs, folder):
    where = folder(documents=docs((1, "é b"), (1, "é b"), (None, None), (2, "x " * 600)))
    found = sorted(map(tuple, QUERIES["op7_token_counts"](spark, where).collect()), key=str)
    counts = {row[:2] for row in found}
    assert len(found) == 4 and (None, 0, 0, False) in found and (1, 4) in counts
    assert [r for r in found if r[0] == 2][0][3] is True
    assert QUERIES["op7_token_counts"](spark, folder(documents=docs())).count() == 0
