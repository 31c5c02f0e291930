"""Secrets in texts: keyword automaton, anchored expressions near its hits, checksums inside the token.

One Aho-Corasick automaton finds all keywords in a text.  Only where one stands, the expression of its kind is tried,
anchored at that place.  Tokens that embed a checksum are kept only when it agrees.  Runs of hexadecimal digits have no
keyword; they are found by one expression of their own.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex")
# Kinds beyond the base ones; their spans come on top.
CHECKED_KINDS = ("github", "npm")
SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
)
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_RANK = {kind: at for at, kind in enumerate((*KINDS, *CHECKED_KINDS))}

# Keywords and the expression that must match where a keyword begins.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(
    rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_GITHUB = re.compile(rb"gh[opsur]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def embedded_checksum(body: bytes) -> bytes:
    """CRC-32 of a token's body in six base-62 digits, as such tokens carry it at their end."""
    rest, digits = zlib.crc32(body), []
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        digits.append(_DIGITS[digit])
    return bytes(reversed(digits))


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    keywords = ahocorasick.Automaton()
    for word in _ASSIGN_WORDS:
        keywords.add_word(word, ("assign", len(word)))
    keywords.add_word("akia", ("access", 4))
    for word in ("gho_", "ghp_", "ghs_", "ghu_", "ghr_"):
        keywords.add_word(word, ("github", 4))
    keywords.add_word("npm_", ("npm", 4))
    keywords.make_automaton()
    return keywords


def _tried(kind: str, text: bytes, start: int) -> tuple[int, bool] | None:
    """End of the match that starts here and whether it passes; None where the expression does not match."""
    if kind == "assign":
        found = _ASSIGN.match(text, start)
        return found and (found.end(), found.end(1) - found.start(1) >= 6)
    if kind == "access":
        found = _ACCESS.match(text, start)
        return found and (found.end(), found.end() - start >= 20)
    found = (_GITHUB if kind == "github" else _NPM).match(text, start)
    return found and (found.end(), embedded_checksum(found[1]) == found[2])


def find_in(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one UTF-8 text in code points, by start and then kind."""
    found: list[tuple[int, int, int]] = []
    last = dict.fromkeys(_RANK, 0)
    # Lower-cased bytes read as Latin-1 keep every position.
    for end, (kind, length) in _automaton().iter(text.lower().decode("latin-1")):
        start = end - length + 1
        if start < last[kind]:
            continue  # inside the match before
        match = _tried(kind, text, start)
        if match:
            last[kind] = match[0]
            if match[1]:
                found.append((start, _RANK[kind], match[0]))
    found.extend((m.start(), _RANK["hex"], m.end()) for m in _HEX.finditer(text))
    if not found:
        return []
    found.sort()
    kinds = list(_RANK)
    if text.isascii():
        return [(kinds[k], s, e) for s, k, e in found]
    places = sorted({p for s, _, e in found for p in (s, e)})
    points, before, count = {}, 0, 0
    for place in places:
        count += len(text[before:place].decode("utf-8"))
        before, points[place] = place, count
    return [(kinds[k], points[s], points[e]) for s, k, e in found]


@F.arrow_udf(SPANS)
def _spans(texts: pa.Array) -> pa.Array:
    values = texts.cast(pa.binary())
    found = (find_in(v.as_py() or b"") for v in values)
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in found], _ARROW)


def secret_spans(text: Column) -> Column:
    """Array of (kind, start, end) in code points, end exclusive, by start and then kind as listed.

    Kinds: ``assign`` (a keyword with a value of six characters or more), ``access`` (access key ids), ``hex`` (24
    hexadecimal digits or more), and on top of these ``github`` and ``npm`` tokens whose embedded CRC-32 agrees.  Each
    kind takes its leftmost matches that do not overlap; a match that fails its length is dropped and not tried
    again.  A null or empty text has no spans.
    """
    return _spans(text)
