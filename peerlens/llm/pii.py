"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, schemes, identifier cues) in one pass over a
text; a small deterministic parser then expands each anchor to the boundaries of an email, address, phone, card or
account and validates it. Positions are code points, the end is exclusive.

Base kinds, leftmost and non-overlapping per kind, failing matches dropped without another try:
email, ip (four parts of at most 255), card (13 to 19 digits passing Luhn), phone (9 to 15 digits).
Further kinds: secret (value after a cue such as `token =`), url (with a scheme), iban (validated modulo 97).

A null text is an empty one and has no spans. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import by_bytes

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "url", "iban")
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"://[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s\"'<>]*)?")
_VALUE = re.compile(r"\s?[:=]\s?(?:\"([^\"\s]{8,})\"|'([^'\s]{8,})'|([A-Za-z0-9_+/=.-]{16,}))")
_IBAN = re.compile(r"\s?[:=]?\s?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SCHEMES = ("http", "https", "ftp", "HTTP", "HTTPS", "FTP")
_CUES = ("token", "Token", "TOKEN", "secret", "Secret", "SECRET", "password", "Password", "PASSWORD",
         "api_key", "API_KEY", "apikey", "access_key", "ACCESS_KEY")


@lru_cache(1)
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ("@", "+", *_DIGITS):
        found.add_word(word, ("d" if word in _DIGITS else word, len(word)))
    for word in _SCHEMES:
        found.add_word(word + "://", ("s", len(word) + 3))
    for word in _CUES:
        found.add_word(word, ("c", len(word)))
    for word in ("IBAN", "Iban", "iban"):
        found.add_word(word, ("i", len(word)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") < 256


def _sound_iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data in a text, by kind in the order of KINDS, then by start."""
    found: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}
    end = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended, kept or not
    if not text:
        return []

    def take(kind: str, start: int, stop: int, sound: bool) -> None:
        end[kind] = stop
        if sound:
            found[kind].append((kind, start, stop))

    for last, (what, length) in _anchors().iter(text):
        at = last - length + 1
        if what == "d":
            if at and text[at - 1] in _DIGITS:
                continue  # inside a run of digits
            if at >= end["ip"] and (m := _QUAD.match(text, at)):
                take("ip", at, m.end(), all(map(_byte, m[0].split("."))))
            if at >= end["card"] and (m := _ACCOUNT.match(text, at)):
                digits = m[0].replace(" ", "").replace("-", "")
                take("card", at, m.end(), 13 <= len(digits) <= 19 and _luhn(digits))
        elif what == "@":
            start = at
            while start > end["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                take("email", start, m.end(), True)
        elif what == "+":
            if at >= end["phone"] and (m := _PHONE.match(text, at)):
                take("phone", at, m.end(), 9 <= sum(c in _DIGITS for c in m[0]) <= 15)
        elif what == "s":
            if at >= end["url"] and (m := _URL.match(text, last - 2)):
                take("url", at, m.end(), True)
        elif what == "c":
            if (m := _VALUE.match(text, last + 1)) and m.start(m.lastindex) >= end["secret"]:
                take("secret", *m.span(m.lastindex), True)
        elif (m := _IBAN.match(text, last + 1)) and m.start(1) >= end["iban"]:
            take("iban", *m.span(1), _sound_iban(m[1]))
    return [x for k in KINDS for x in found[k]]


def redacted(text: str | None, marks: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if text is None or not marks:
        return text
    out, at = [], 0
    for kind, start, stop in sorted(marks, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


@F.arrow_udf(SPANS)
def find_spans(text: pa.Array) -> pa.Array:
    """Spans of each text; empty for a null text."""
    out = []
    for start, stop in by_bytes(text):
        out += [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in text[start:stop].to_pylist()]
    return pa.array(out, _SPAN_TYPE)


@F.arrow_udf(T.StringType())
def redact(text: pa.Array) -> pa.Array:
    """Each text with its personal data replaced; a null text stays null."""
    out = []
    for start, stop in by_bytes(text):
        out += [redacted(t, spans(t)) for t in text[start:stop].to_pylist()]
    return pa.array(out, pa.string())


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """The rows with a column `out` of spans. Other columns pass through unchanged."""
    return df.withColumn(out, find_spans(F.col(text)))


def redact_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the personal data in `text` replaced by [EMAIL], [IP], [CARD], [PHONE], [SECRET], [URL], [IBAN]."""
    return df.withColumn(text, redact(F.col(text)))


def count_of(pii: Column, kind: str) -> Column:
    return F.size(F.filter(pii, lambda s: s["kind"] == kind)).cast("long")


def listed(pii: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(pii, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
