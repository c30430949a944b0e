"""Personal data in texts, plain and disguised.

Plain e-mail addresses, IP addresses, card and phone numbers are found by pattern. For disguised ones a chain of
transducers rewrites the text (look-alike letters to ASCII, invisible characters to nothing, number words to digits,
spelled-out at and dot to their signs) and keeps, for every character it writes, the stretch of source characters that
it came from. Identifiers found in the rewritten text are mapped back to source spans; those that overlap no plain span
and contain something rewritten are added with ``base`` false.

Results: null and empty texts have no spans. Spans of one kind never overlap plain spans of any kind when added.
Repeated rows and other columns of the input stay as they are;
a column that has the name of a result is replaced by it.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commutelens.llm.spans import Span, found_in, free_of, in_order

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does: within a run, a later start fails where an earlier one did.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    """Found from the @ signs outwards, so that long words without one cost nothing."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        free = match.end() if match else at + 1
        if match:
            found.append((start, free))
        at = text.find("@", free)
    return found


def ips(text: str) -> list[tuple[int, int]]:
    def small(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) <= 3 and int(part or "0") <= 255

    return [m.span() for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(map(int, reversed(digits))):
        total += digit if i % 2 == 0 else sum(divmod(2 * digit, 10))
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]


def plain(text: str) -> list[tuple[str, int, int]]:
    finders = (("email", emails), ("ip", ips), ("card", cards), ("phone", phones))
    return [(kind, *span) for kind, find in finders for span in find(text)]


# Cyrillic and Greek letters that look like Latin ones, signs that look like @ and a full stop.
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαινρτυ﹫＠․。｡‐‑‒–—−﹣－",
        "ABESIJKMHOPCTYXaeopcyxijsdhqwABEZHIKMNOPTYXoaivptu@@...--------",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿"
# Number words of the languages served.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8",
    "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4",
    "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3",
    "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "oh": "0",
}

_NUMBER = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
# Signs between spelled digits; a decimal point in words belongs to spelled IP addresses.
_SPELLED = re.compile(
    rf"(?<!\w)(?:plus[\x20-]+|\+[\x20]?)?(?:{_NUMBER})(?:[\x20,.-]{{1,2}}(?:{_NUMBER}|dot|point|punkt|punto|[0-9]+)(?!\w)){{3,}}",
    re.IGNORECASE,
)
_SPELLED_PART = re.compile(rf"plus|\+|{_NUMBER}|dot|point|punkt|punto|[0-9]+", re.IGNORECASE)
_MAYBE_SPELLED = re.compile(rf"(?<!\w)(?:{_NUMBER})[\x20,.-]", re.IGNORECASE)
_AT_WORD, _DOT_WORD = r"(?:at|arroba|arobase|ät)", r"(?:dot|punkt|punto|point)"
_OPEN, _CLOSE = r"[\(\[\{<]", r"[\)\]\}>]"
_AT = rf"(?:\x20?{_OPEN}\x20?(?:{_AT_WORD}|@)\x20?{_CLOSE}\x20?|\x20@\x20?|@\x20|\x20-?{_AT_WORD}-?\x20|_{_AT_WORD}_|-{_AT_WORD}-)"
_DOT = rf"(?:\x20?{_OPEN}\x20?(?:{_DOT_WORD}|\.)\x20?{_CLOSE}\x20?|\x20{_DOT_WORD}\x20|_{_DOT_WORD}_|-{_DOT_WORD}-|\x20\.\x20?)"
# A hyphen or underscore that begins a dot or at in words is no part of a label, so a text splits in one way only.
_WORDS = rf"(?:{_DOT_WORD}|{_AT_WORD})"
_LABEL = rf"(?:[A-Za-z0-9]|-(?!{_WORDS}-)){{1,63}}+"
_LOCAL = rf"(?:[A-Za-z0-9%+]|_(?!{_WORDS}_)|-(?!{_WORDS}-)){{1,64}}+"
#: Local part, a disguised or plain at, labels with disguised or plain dots. One of both must be in disguise.
_DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<local>{_LOCAL}(?:(?:\.|{_DOT}){_LOCAL})*+)"
    rf"(?P<at>{_AT}|@)(?P<domain>{_LABEL}(?:(?:\.|{_DOT}){_LABEL})*(?:\.|{_DOT})(?!{_DOT_WORD}\b)[A-Za-z]{{2,24}})(?![A-Za-z0-9_])",
    re.IGNORECASE,
)
_MAYBE_DISGUISED = re.compile(rf"{_OPEN}\x20?(?:{_AT_WORD}|@|{_DOT_WORD}|\.)\x20?{_CLOSE}|[\x20_-]{_DOT_WORD}[\x20_-]|\x20@|@\x20|\x20\.[A-Za-z]", re.IGNORECASE)
_DOTS, _ATS = re.compile(_DOT, re.IGNORECASE), re.compile(_AT, re.IGNORECASE)
_MAYBE_ALIKE = re.compile("[" + re.escape("".join(LOOK_ALIKES) + INVISIBLE) + "⁰-₟①-⓿！-～\U0001d400-\U0001d7ff]")


class Mapped:
    """A text with, for each character, the source stretch it came from and whether it was rewritten."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = array("i", range(len(text)))
        self.end = array("i", range(1, len(text) + 1))
        self.new = bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces stretches of the text, given in order; each written character stands for the whole stretch."""
        parts, start, end, new, at = [], array("i"), array("i"), bytearray(), 0
        for left, right, into in edits:
            parts += [self.text[at:left], into]
            start += self.start[at:left]
            end += self.end[at:left]
            new += self.new[at:left]
            start.extend([self.start[left]] * len(into))
            end.extend([self.end[right - 1]] * len(into))
            new += b"\1" * len(into)
            at = right
        self.text = "".join([*parts, self.text[at:]])
        self.start, self.end, self.new = start + self.start[at:], end + self.end[at:], new + self.new[at:]


@lru_cache(maxsize=4096)
def _folded(char: str) -> str:
    if char in INVISIBLE:
        return ""
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    plain_form = unicodedata.normalize("NFKC", char)
    return plain_form if plain_form.isascii() else char


def alike_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), _folded(m.group())) for m in _MAYBE_ALIKE.finditer(text) if _folded(m.group()) != m.group()]


def spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED.finditer(text):
        signs = []
        for part in _SPELLED_PART.findall(m.group()):
            word = part.lower()
            signs.append("+" if word in ("plus", "+") else word if word.isdigit() else NUMBER_WORDS.get(word, "."))
        edits.append((m.start(), m.end(), "".join(signs)))
    return edits


def sign_edits(text: str) -> list[tuple[int, int, str]]:
    """At and dot inside e-mail addresses. A bare word "at" counts only together with a dot in words or brackets."""
    edits, free = [], 0
    while m := _DISGUISED.search(text, free):
        at, dots = m.group("at"), [d for d in _DOTS.finditer(text, *m.span("domain"))]
        bracketed = re.search(_OPEN, at) is not None
        if at == "@" and not dots or not bracketed and "@" not in at and not dots:
            free = m.start() + 1
            continue
        inside = [(d.start(), d.end(), ".") for d in _DOTS.finditer(text, *m.span("local"))]
        edits += [*inside, (*m.span("at"), "@"), *[(d.start(), d.end(), ".") for d in dots]]
        free = m.end()
    return edits


def _narrowed(mapped: Mapped, kind: str, start: int, end: int) -> tuple[str, int, int]:
    return kind, mapped.start[start], mapped.end[end - 1]


def disguised(text: str) -> list[tuple[str, int, int]]:
    """Identifiers that appear only after rewriting, as spans of the source."""
    if not (_MAYBE_ALIKE.search(text) or _MAYBE_DISGUISED.search(text) or _MAYBE_SPELLED.search(text)):
        return []
    mapped = Mapped(text)
    for edits in (alike_edits, spelled_edits, sign_edits):
        if found := edits(mapped.text):
            mapped.rewrite(found)
    if not any(mapped.new) and len(mapped.text) == len(text):
        return []
    return [
        _narrowed(mapped, kind, start, end)
        for kind, start, end in plain(mapped.text)
        if any(mapped.new[start:end]) or mapped.end[end - 1] - mapped.start[start] != end - start
    ]


def find(text: str) -> list[Span]:
    """All spans by start, then kind."""
    base: list[Span] = [(*span, True) for span in plain(text)]
    is_free = free_of(base)
    return in_order([*base, *((*s, False) for s in disguised(text) if is_free(s[1], s[2]))], KINDS)


def scan(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    return df.withColumn(spans, found_in(F.col(text), find))
