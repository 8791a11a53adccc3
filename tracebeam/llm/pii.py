"""Personal data in whole texts, also behind disguises, with spans in the source text.

Plain detectors find e-mail addresses, IP addresses, card and phone numbers. Then a transducer
rewrites the text (look-alike letters to ASCII, spelled digits to digits, "at" and "dot" disguises to
signs, invisible characters away) and records for each piece which source characters it came from;
the detectors run again on the rewritten text, and what they find there through a rewritten piece is
mapped back. Added spans never replace or overlap a plain span of their kind.

All detectors are linear in the text. A null text counts as empty; rows are judged one by one, so
repeated rows stay repeated; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "spans string, n_added long"
)
Span = tuple[int, int]

# fixed values: the contract's patterns, with runs made possessive so that a failure is not retried
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")

# fixed values: digits as words (English, German, French, Spanish)
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4",
    "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5",
    "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5",
    "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# fixed values: Greek and Cyrillic letters that look like ASCII letters
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТХаеіјорсухѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανι",
        "ABESIJKMHOPCTXaeijopcyxsdqwhABEZHIKMNOPTYXoavi",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿"

# fixed values: last labels that make "x at y dot z" without brackets an address rather than prose
LAST_LABELS = "com|org|net|edu|gov|info|io|co|uk|de|fr|es|eu|us|ch|at|it|nl|biz|dev|app"

_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_END = r"(?![^\W\d_])"  # no letter follows
_DOT = r"(?:\.|\ +dot\ +|\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*)"
# after a bare "at": labels and dots up to a last label
_TO_LAST = rf"(?=[\w-]+(?:{_DOT}[\w-]+)*?{_DOT}(?:{LAST_LABELS})(?![\w-]))"
_TO_DIGIT = rf"(?=(?:{_WORDS}|[0-9]){_END})"
_BRACKETED = re.compile(r"[\[({<]\s*+(?:at|dot|@|\.)\s*+[\])}>]")
# letters outside ASCII that may stand for ASCII ones; plain accented letters are none
_ODD = re.compile(f"[{INVISIBLE}Ͱ-ԯ․！-～⁰-ₜ\U0001d400-\U0001d7ff﹒﹫]")
_PIECE = re.compile(
    rf"""(?P<odd>{_ODD.pattern})
    |(?P<at>(?:(?<!\s)\s++)?[\[({{<]\s*+(?:at|@)\s*+[\])}}>]\s*+)
    |(?P<dot>(?:(?<!\s)\s++)?[\[({{<]\s*+(?:dot|\.)\s*+[\])}}>]\s*+)
    |(?P<bare_at>(?<=\w)\ +at\ +{_TO_LAST})
    |(?P<bare_dot>(?<=\w)\ +dot\ +(?=\w))
    |(?P<plus>(?<![^\W_])plus\ +{_TO_DIGIT})
    |(?P<digit>(?<![^\W\d_])(?P<word>{_WORDS}){_END}(?:[ -]{_TO_DIGIT})?)
    """,
    re.VERBOSE | re.IGNORECASE,
)
# what each piece needs to show anything new, without its left edge (see disguised)
_BARE_AT = re.compile(rf"\ at\ +{_TO_LAST}")
_PLUS = re.compile(rf"plus\ +{_TO_DIGIT}")
_WORD = re.compile(rf"(?:{_WORDS}){_END}")
_SPELLED = re.compile(rf"(?:{_WORDS}|[0-9])[ ().-]*+(?:{_WORDS}){_END}|(?:{_WORDS})[ ().-]*+[0-9]")
# equal ASCII letters where case is ignored, but not in lower()
_FOLD = str.maketrans("İıſ\u212a", "iisk")
_FOLDED = re.compile("[İıſ\u212a]")


def emails(text: str) -> list[Span]:
    """Addresses, found from each @: the run before it, back to the end of the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        else:
            done = at + 1  # a later match cannot reach over an @
        at = text.find("@", done)
    return out


def ips(text: str) -> list[Span]:
    return [
        m.span() for m in _IP.finditer(text)
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))
    ]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [
        m.span() for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15
    ]


def detect(text: str) -> dict[str, list[Span]]:
    digits = _DIGIT.search(text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digits and "." in text else [],
        "card": cards(text) if digits else [],
        "phone": phones(text) if digits and "+" in text else [],
    }


def plain_letter(char: str) -> str:
    """ASCII form of a look-alike; '' for an invisible character; itself if it is neither."""
    if char in INVISIBLE:
        return ""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    folded = unicodedata.normalize("NFKC", char)
    return folded if len(folded) == 1 and folded.isascii() else char


class Rewritten:
    """A rewritten text and, per piece, the source characters it stands for."""

    def __init__(self, text: str):
        self.starts: list[int] = []  # of pieces in the rewritten text
        self.source: list[tuple[int, int, bool]] = []  # of pieces: start, end, rewritten
        out: list[str] = []
        length = done = 0

        def piece(value: str, start: int, end: int, changed: bool) -> None:
            nonlocal length
            if value:
                self.starts.append(length)
                self.source.append((start, end, changed))
                out.append(value)
                length += len(value)

        for m in _PIECE.finditer(text):
            kind = m.lastgroup if m.lastgroup != "word" else "digit"
            end = m.end()
            if kind == "odd":
                value = plain_letter(m.group())
                if value == m.group():
                    continue
            elif kind == "digit":
                value, end = DIGIT_WORDS[m.group("word").translate(_FOLD).lower()], m.end("word")
            else:
                value = {"at": "@", "bare_at": "@", "plus": "+"}.get(kind, ".")
            piece(text[done : m.start()], done, m.start(), False)
            piece(value, m.start(), end, True)
            done = m.end()
        piece(text[done:], done, len(text), False)
        self.text = "".join(out)

    def back(self, span: Span) -> tuple[Span, bool]:
        """Source span of a rewritten span, and whether it holds a rewritten piece."""
        first = bisect_right(self.starts, span[0]) - 1
        last = bisect_right(self.starts, span[1] - 1) - 1
        lo, _, changed = self.source[first]
        if not changed:
            lo += span[0] - self.starts[first]
        start, hi, changed = self.source[last]
        if not changed:
            hi = start + span[1] - self.starts[last]
        # a gap in the source (an invisible character) is a rewriting, too
        touched = first != last or changed
        return (lo, hi), touched


def disguised(text: str) -> bool:
    """Whether the transducer can show anything new; False only where ``added`` would be empty.

    A new span holds a rewritten piece. Signs and odd characters are looked for as the transducer
    does. A spelled digit belongs to an address (then there is an @) or to a number, in which the next
    digit, spelled or not, is at most some of ' ().-' away.
    """
    low = text.lower()
    return bool(
        " dot " in low
        or (any(c in low for c in "[({<") and _BRACKETED.search(low))
        or _BARE_AT.search(low)
        or _PLUS.search(low)
        or _SPELLED.search(low)
        or ("@" in low and _WORD.search(low))
        or (not text.isascii() and (_ODD.search(text) or _FOLDED.search(text)))
    )


def added(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the rewritten text shows, by kind."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not disguised(text):
        return out
    rewritten = Rewritten(text)
    for kind, found in detect(rewritten.text).items():
        taken = sorted(base[kind])
        starts = [s for s, _ in taken]
        for span in found:
            (lo, hi), touched = rewritten.back(span)
            k = bisect_right(starts, hi - 1) - 1
            if touched and not (k >= 0 and taken[k][1] > lo):
                out[kind].append((lo, hi))
    return out


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{lo}:{hi}" for k in KINDS for lo, hi in sorted(spans[k]))


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: plain counts by kind, SHA-256 of the plain spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                text = value.as_py() or ""
                base = detect(text)
                more = added(text, base)
                everything = {k: base[k] + more[k] for k in KINDS}
                for at, kind in enumerate(KINDS):
                    rows[at].append(len(base[kind]))
                rows[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows[5].append(joined(everything))
                rows[6].append(sum(map(len, more.values())))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, rows, kinds)],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def redact(text: str, spans: str, mask: str = "[{}]") -> str:
    """``text`` with each span (as in the ``spans`` column) replaced by its kind."""
    parts = sorted((int(lo), int(hi), k) for k, lo, hi in (x.split(":") for x in spans.split(",") if x))
    out, done = [], 0
    for lo, hi, kind in parts:
        if lo >= done:
            out += [text[done:lo], mask.format(kind)]
            done = hi
    return "".join(out) + text[done:]
