"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_text, prepare

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
CONTEXT = 48
KEEP = 0.5

# Score of a span by kind once its own test is passed, and what a word of either list nearby adds.
PRIOR = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.7, "ssn": 0.3}
FOR = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server", "client"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "transfer", "swift", "bic"),
    "ssn": ("ssn", "social security", "taxpayer", "itin"),
}
AGAINST = ("order", "invoice", "isbn", "serial", "version", "build", "example", "sample", "test", "part no")
RAISE, LOWER = 0.3, 0.3
_FOR = {kind: re.compile(rf"\b(?:{'|'.join(map(re.escape, words))})") for kind, words in FOR.items()}
_AGAINST = re.compile(rf"\b(?:{'|'.join(map(re.escape, AGAINST))})\b")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# The start of an account number and all that could belong to it; `accounts` finds where it ends.
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_ALNUM = re.compile(r"[A-Za-z0-9]")

# Characters of an account number by country; one of another country may end after any word.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for place, d in enumerate(reversed(digits)):
        value = int(d) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number (upper case, no spaces) passes the mod-97 check."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping matches: each `@` whose domain fits takes the run of local characters before it."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            floor = domain.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Groups of four numbers from each chain of dotted numbers, in order, whose parts are at most 255."""
    for chain in _DOTTED.finditer(text):
        parts = chain.group().split(".")
        start = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            yield m.span()


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping account numbers.  Each start is tried with the length of its country, or with every
    end of a word if the country has none; the furthest end of a word is always tried."""
    at = 0
    while m := _IBAN.search(text, at):
        places = [i for i in range(*m.span()) if text[i] != " "]
        ends = [n for n in range(len(places), 14, -1) if not _ALNUM.match(text, places[n - 1] + 1)]
        fixed = IBAN_LENGTH.get(m[1])
        if fixed:
            ends = [n for n in ends if n == fixed] + [n for n in ends[:1] if n != fixed]
        for n in ends:
            if mod97("".join(text[i] for i in places[:n])):
                at = places[n - 1] + 1
                yield m.start(), at
                break
        else:
            at = m.start() + 1


def social_numbers(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def context_score(text: str, kind: str, start: int, end: int) -> float:
    """The prior of the kind, raised and lowered by words within CONTEXT characters of the span."""
    near = f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT]}".lower()
    score = PRIOR[kind]
    if _FOR[kind].search(near):
        score += RAISE
    if _AGAINST.search(near):
        score -= LOWER
    return min(1.0, max(0.0, score))


class _Taken:
    """Tells whether a span overlaps any of those given, by bisection."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        ordered = sorted(spans)
        self.starts = [s for s, _ in ordered]
        self.furthest = list(accumulate((e for _, e in ordered), max))  # end of the first 1, 2, ... spans

    def overlaps(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.furthest[before - 1] > start


def find_spans(text: str) -> list[Span]:
    """All spans of a whole text by start, then kind.  Spans of the base kinds stay whatever their context says; of
    the others those with a score of at least KEEP stay that no base span overlaps."""
    found = []
    if "@" in text:
        found += [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *s) for s in addresses(text)] + [("card", *s) for s in cards(text)]
        if "+" in text:
            found += [("phone", *s) for s in phones(text)]
        taken = _Taken([(s, e) for _, s, e in found])
        more = [("iban", *s) for s in accounts(text)] + ([("ssn", *s) for s in social_numbers(text)] if "-" in text else [])
        found += [x for x in more if not taken.overlaps(x[1], x[2])]
    spans = [Span(k, s, e, context_score(text, k, s, e)) for k, s, e in found]
    spans = [s for s in spans if s.kind in BASE_KINDS or s.score >= KEEP]
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))


def redact(text: str, spans: list[Span]) -> str:
    """The text with every stretch that spans cover replaced by the kind of the first of them, as in `[EMAIL]`."""
    out, at = [], 0
    for span in spans:
        if span.start >= at:
            out += [text[at : span.start], f"[{span.kind.upper()}]"]
        at = max(at, span.end)
    return "".join([*out, text[at:]])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


_REPORT = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("scores", T.ArrayType(T.DoubleType()))]
)


def _make_report() -> Callable[[list[str | None]], pa.Array]:
    def apply(texts: list[str | None]) -> pa.Array:
        columns: list[list] = [[] for _ in range(7)]
        for text in texts:
            spans = find_spans(text or "")
            base = [s for s in spans if s.kind in BASE_KINDS]
            for column, kind in zip(columns, BASE_KINDS):
                column.append(sum(s.kind == kind for s in base))
            columns[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
            columns[5].append(joined(spans))
            columns[6].append([s.score for s in spans])
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(pa.float64())]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_REPORT.names)

    return apply


def _make_redacted() -> Callable[[list[str | None]], pa.Array]:
    return lambda texts: pa.array([None if t is None else redact(t, find_spans(t)) for t in texts], pa.string())


def redacted(text: Column) -> Column:
    """The text without its personal data; null stays null."""
    return per_text(_make_redacted, T.StringType())(text)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their digest, all spans and their scores: one row per input row.

    Offsets are code points of the whole text, end exclusive.  Null text counts as empty; repeated rows and null ids
    give a row each; other columns are not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    found = per_text(_make_report, _REPORT)
    return docs.select("doc_id", found(F.col("text")).alias("r")).select("doc_id", "r.*")
