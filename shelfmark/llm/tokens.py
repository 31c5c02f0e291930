"""Token counts of whole texts with a public tokenizer.

The library encodes batches of about equal size in bytes and only the lengths leave the task.  Texts are split where no
token can reach across: between a visible character, a single space and another visible character.  The pieces of
natural text repeat a lot, so each distinct piece is encoded once per worker and its length is remembered in a table of
bounded size.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_BATCH_BYTES = 1 << 20
_REMEMBERED = 150_000
# Visible characters that every tokenizer's rules take as such: ASCII and the Latin blocks up to U+024F.
_VISIBLE = re.compile("[!-~¡-¬®-ɏ]")
_PLAIN = re.compile("[!-~¡-¬®-ɏ](?:.*[!-~¡-¬®-ɏ])?", re.DOTALL)


class _Pieces:
    """Lengths by piece, computed by the library in batches of bounded size."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.inner: dict[str, int] = {}  # words that follow a space, without the space
        self.other: dict[str, int] = {}  # all other pieces, as they stand

    def _encode(self, pieces: list[str]) -> list[int]:
        found, start = [], 0
        while start < len(pieces):
            size, end = 0, start
            while end < len(pieces) and (end == start or size + len(pieces[end]) <= _BATCH_BYTES):
                size += len(pieces[end])
                end += 1
            batch = self.tokenizer.encode_batch_fast(pieces[start:end], add_special_tokens=False)
            found.extend(len(e) for e in batch)
            start = end
        return found

    def _learn(self, table: dict[str, int], words: set[str], prefix: str) -> None:
        new = sorted(w for w in words if w not in table)
        table.update(zip(new, self._encode([prefix + w for w in new])))

    def counts(self, texts: list[str]) -> list[int]:
        cut = []
        for text in texts:
            words = text.split(" ")
            known = list(map(self.inner.get, words))
            odd = {w for w, n in zip(words, known) if n is None and not _PLAIN.fullmatch(w)} if None in known else ()
            cut.append((words[:1], words[1:]) if not odd else _safe_cuts(words))
        self._learn(self.other, {w for first, _ in cut for w in first}, "")
        self._learn(self.inner, {w for _, rest in cut for w in rest}, " ")
        totals = [
            sum(map(self.other.__getitem__, first)) + sum(map(self.inner.__getitem__, rest)) for first, rest in cut
        ]
        for table in (self.inner, self.other):
            if len(table) > _REMEMBERED:
                for key in list(islice(table, len(table) - _REMEMBERED // 2)):
                    del table[key]
        return totals


def _safe_cuts(words: list[str]) -> tuple[list[str], list[str]]:
    """Words joined again where the space between them is no safe boundary: (first piece, pieces after a space)."""
    groups: list[list[str]] = [[words[0]]]
    for before, word in zip(words, words[1:]):
        safe = before and word and _VISIBLE.match(before[-1]) and _VISIBLE.match(word[0])
        if safe:
            groups.append([word])
        else:
            groups[-1].append(word)
    pieces = [" ".join(g) for g in groups]
    return pieces[:1], pieces[1:]


@lru_cache(maxsize=4)
def _pieces(path: str) -> _Pieces:
    return _Pieces(path)


@lru_cache(maxsize=4)
def _sentences(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _lengths(path: str, texts: list[str]) -> list[int]:
    """Token counts; a sentencepiece model rewrites white space, so its texts are encoded whole."""
    if path.endswith(".model"):
        return [len(ids) for ids in _sentences(path).encode(texts, num_threads=1)]
    return _pieces(path).counts(texts)


def token_count(text: Column, tokenizer: str) -> Column:
    """Number of tokens of a text by the tokenizer file at the path ``tokenizer``.

    ``.json`` files are read by the tokenizers library, ``.model`` files by sentencepiece.  The path must exist on each
    executor.  No begin, end or other special token is added; strings of special tokens inside a text are handled as
    the library does by default.  Null counts as the empty text, which has 0 tokens.  A text is never cut short: one
    without a safe boundary is encoded in one piece.
    """

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        values = ["" if t is None else t for t in texts.to_pylist()]
        found, start, size = [], 0, 0
        for at, value in enumerate(values):
            size += len(value)
            if size >= _BATCH_BYTES or at == len(values) - 1:
                found.extend(_lengths(tokenizer, values[start : at + 1]))
                start, size = at + 1, 0
        return pa.array(found, pa.int64())

    return count(text)
