"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from strataq.llm import common


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


#: The first four are the base kinds; their spans stay whatever their score is.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
ORDER = {k: i for i, k in enumerate(KINDS)}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Runs are taken whole (possessively) and only from their first digit, so that long runs of digits cost linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
# Characters of an account number by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_DIGIT = re.compile(r"[0-9]")

#: Score before and after a word of the kind's context within REACH characters; spans of added kinds need THRESHOLD.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto"),
    "ssn": ("ssn", "social", "security"),
}
LIFT, REACH, THRESHOLD = 0.35, 40, 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _iban_end(text: str, start: int, length: int) -> int:
    """Where a valid account number of that many characters ends, single spaces not counted; 0 if there is none."""
    at, found = start, ""
    while len(found) < length and at < len(text):
        c = text[at]
        if "A" <= c <= "Z" or "0" <= c <= "9":
            found += c
        elif c != " " or text[at - 1] == " ":
            return 0
        at += 1
    follows = text[at : at + 1]
    whole = length and len(found) == length and not (follows.isascii() and follows.isalnum())
    return at if whole and mod97(found) else 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Same spans as the plain pattern's, found outward from each @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            end = max(end, at)  # what lies left of this @ can't begin a later match that crosses it
            at = text.find("@", at + 1)


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def propose(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans, without scores."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_only_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if end := _iban_end(text, m.start(), IBAN_LENGTH.get(m[1], 0)):
            yield "iban", m.start(), end
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def find(text: str) -> list[Span]:
    """All spans of one text, by start and then kind."""
    out = []
    for kind, a, b in propose(text):
        near = (text[max(0, a - REACH) : a] + " " + text[b : b + REACH]).lower()
        score = min(1.0, PRIOR[kind] + LIFT * any(w in near for w in CONTEXT[kind]))
        if kind in BASE or score >= THRESHOLD:
            out.append(Span(kind, a, b, round(score, 2)))
    return sorted(out, key=lambda s: (s.start, ORDER[s.kind], s.end))


SPANS = "doc_id long, spans array<struct<kind string, start long, end long, score double, value string>>"


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of docs (doc_id, text).

    A null or empty text has no spans; repeated rows each give a row; an empty table gives an empty one; a
    null doc_id stays null; all other columns are ignored. Work per text is linear in its length.
    """
    common.prepare(docs.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [[s._asdict() | {"value": t[s.start : s.end]} for s in find(t)] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "spans": spans})

    return common.whole_texts(docs).mapInPandas(scan, SPANS)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


DIGEST = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "max_score double"
)


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns, derived from the spans in the same pass; max_score is 0 without spans."""
    common.prepare(docs.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                spans = find(t)
                base = [s for s in spans if s.kind in BASE]
                n = [sum(s.kind == k for s in base) for k in BASE]
                sha = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*n, sha, joined(spans), max([0.0, *(s.score for s in spans)])))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")][1:])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
            yield out

    return common.whole_texts(docs).mapInPandas(scan, DIGEST)
