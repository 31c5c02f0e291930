"""Personal data in texts, by DataFrame functions alone.

Expressions propose spans, checksums confirm those kinds that have one, and words nearby raise or lower the score.  All
of it stays in the JVM: an expression cuts a text into what lies between its matches, and the lengths of matches and
pieces add up to positions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.llm.common import let

KINDS = ("email", "ip", "card", "phone")
# Kinds beyond the base ones; their spans come on top.
CHECKED_KINDS = ("iban",)
_RANK = {kind: at for at, kind in enumerate((*KINDS, *CHECKED_KINDS))}
SPANS = "array<struct<start: bigint, rank: int, end: bigint, kind: string, score: double>>"
_AROUND = 40
_CHUNK = 256

# The expressions of the base kinds.  Possessive runs and the looks back keep them linear: a match begins
# at the first character of its run or where the match before ended, and a run is never given back.
_LOCAL = "A-Za-z0-9._%+-"
_PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Z0-9])",
}
_SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
_CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b", "ip": r"(?i)\b(?:ip|host|server|address|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|mobile|call|fax)\b", "iban": r"(?i)\b(?:iban|account|bank|transfer)\b",
}
_AGAINST = r"(?i)\b(?:example|version|order|invoice|isbn|serial|test)\b"
_BYTE_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the last digit of a number is its Luhn check digit."""

    def weighed(digit: Column, at: Column) -> Column:
        value = digit.cast("int") * F.when(at % 2 == 1, 2).otherwise(1)
        return F.when(value > 9, value - 9).otherwise(value)

    values = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), weighed)
    return F.aggregate(values, F.lit(0), lambda total, v: total + v) % 10 == 0


def _mod97(match: Column) -> Column:
    """Whether an account number's check digits agree: letters as 10 to 35, country and check digits last."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    letters = F.split(turned, "(?<=.)(?=.)")

    def step(rest: Column, letter: Column) -> Column:
        code = F.ascii(letter)
        digit = F.when(code >= 65, code - 55).otherwise(code - 48)
        return (rest * F.when(code >= 65, 100).otherwise(10) + digit) % 97

    return F.aggregate(letters, F.lit(0), step) == 1


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE_PART}(?:\.{_BYTE_PART}){{3}}$")
    if kind == "card":
        return let(_digits(match), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & _mod97(match)
    return F.lit(True)


def _summed(lengths: Column) -> Column:
    """Running sums before each element, by chunks so that many matches in one text stay cheap."""
    zero = F.lit(0).cast("bigint")
    total = lambda part: F.aggregate(part, zero, lambda s, v: s + v)
    chunks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int"))

    def chunk_sums(values: Column) -> Column:
        return F.transform(chunks, lambda c: total(F.slice(values, c * _CHUNK + 1, _CHUNK)))

    def place(values: Column, sums: Column, at: Column) -> Column:
        chunk = F.floor(at / _CHUNK).cast("int")
        return total(F.slice(sums, F.lit(1), chunk)) + total(F.slice(values, chunk * _CHUNK + 1, at % _CHUNK))

    return let(chunk_sums(lengths), lambda sums: F.transform(lengths, lambda _, at: place(lengths, sums, at)))


def _spans_of(kind: str, text: Column) -> Column:
    """Passing spans of one kind: (start, rank, end, kind, score)."""
    pattern = F.lit(_PATTERNS[kind])

    # A match has at least two characters and one between it and the next, so so many of them fill the distance.
    units = _AROUND // 3 + 1

    def before(pieces: Column, matches: Column, at: Column) -> Column:
        low = F.greatest(at - units, F.lit(0))
        earlier = F.transform(F.sequence(low, at - 1), lambda i: F.concat(F.get(pieces, i), F.get(matches, i)))
        text = F.when(at > 0, F.array_join(earlier, "")).otherwise("")
        return F.right(F.concat(text, F.get(pieces, at)), F.lit(_AROUND))

    def after(pieces: Column, matches: Column, at: Column) -> Column:
        last = F.size(matches) - 1
        later = F.transform(
            F.sequence(at + 1, F.least(at + units, last)), lambda i: F.concat(F.get(matches, i), F.get(pieces, i + 1))
        )
        text = F.when(at < last, F.array_join(later, "")).otherwise("")
        return F.left(F.concat(F.get(pieces, at + 1), text), F.lit(_AROUND))

    def spans(pieces: Column, matches: Column) -> Column:
        lengths = F.zip_with(
            matches, pieces, lambda m, p: F.coalesce(F.char_length(m), F.lit(0)).cast("bigint") + F.char_length(p)
        )

        def span(at: Column, starts: Column) -> Column:
            match, piece = F.get(matches, at), F.get(pieces, at)
            start = F.get(starts, at) + F.char_length(piece)
            near = F.concat_ws("\n", before(pieces, matches, at), after(pieces, matches, at))
            score = (
                F.lit(_SCORES[kind]) + F.when(near.rlike(_CONTEXT[kind]), 0.1).otherwise(0.0)
                - F.when(near.rlike(_AGAINST), 0.3).otherwise(0.0)
            )
            return F.struct(
                start.alias("start"), F.lit(_RANK[kind]).alias("rank"), (start + F.char_length(match)).alias("end"),
                F.lit(kind).alias("kind"), F.round(score, 2).alias("score"),
            )

        places = F.filter(F.sequence(F.lit(0), F.size(matches) - 1), lambda at: _passes(kind, F.get(matches, at)))
        return let(let(lengths, _summed), lambda starts: F.transform(places, lambda at: span(at, starts)))

    none = F.array().cast(SPANS)
    some = let(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda matches: F.when(F.size(matches) == 0, none).otherwise(
            let(F.split(text, _PATTERNS[kind], -1), lambda pieces: spans(pieces, matches)).cast(SPANS)
        ),
    )
    likely = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    return F.when(likely, some).otherwise(none)


def personal_spans(text: Column) -> Column:
    """Array of (start, rank, end, kind, score) in code points, end exclusive, by start and then kind as listed.

    Kinds: ``email``, ``ip`` (four parts of at most 255), ``card`` (12 to 19 digits that pass Luhn), ``phone`` (9 to 15
    digits after a plus), and on top of these ``iban`` (mod 97).  Each kind takes its leftmost matches that do not
    overlap; one that fails its check is dropped and not tried again.  The score lies between 0 and 1 and counts words
    within 40 characters before and after.  A null or empty text has no spans.
    """
    whole = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_spans_of(kind, whole) for kind in _RANK]))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap, what is left of a later one goes."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(state: Column, span: Column) -> Column:
        between = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(span["start"] - state["at"], F.lit(0)).cast("int"))
        mark = F.when(span["end"] > state["at"], F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))).otherwise("")
        return F.struct(
            F.concat(state["out"], between, mark).alias("out"), F.greatest(state["at"], span["end"]).alias("at")
        )

    def close(state: Column) -> Column:
        rest = F.substring(text, (state["at"] + 1).cast("int"), F.char_length(text))
        return F.concat(state["out"], rest)

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, close))
