"""PII (operator 8): expressions propose spans, checks confirm them, context scores them.

Five kinds, in this order: ``email``, ``ip``, ``card``, ``phone``, ``iban``.
The first four are fixed proposals with fixed checks (``base``); a proposal
whose check fails is dropped and not retried. ``iban`` is what the method adds:
the longest part of a proposal, up to a space, that passes the mod-97 check; in
lower case only without spaces. Cards of 13 to 15 digits are added to
``card`` only if Luhn passes and a context word stands nearby. Every span has a
score: a start value of its kind, raised by a checksum and by context words
within ``CONTEXT`` characters before it, lowered by words that speak against it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

KINDS = ("email", "ip", "card", "phone", "iban")

# Leftmost matches. A run of digits is entered at its first digit only and is
# taken whole, which finds the same matches as a plain scan, in linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SMALL_IBAN = re.compile(r"(?<![A-Za-z0-9])[a-z]{2}[0-9]{2}[a-z0-9]{11,30}(?![A-Za-z0-9])")

CONTEXT = 48
#: Words that raise the score of a kind when they stand shortly before a span.
NEARBY = {
    "email": re.compile(r"mail|contact|write to|address", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|ping", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|anruf|appel|llam", re.I),
    "iban": re.compile(r"iban|bank|account|konto|compte|cuenta|transfer", re.I),
}
#: Words that lower it.
AGAINST = re.compile(r"version|build|isbn|order|invoice|example|serial", re.I)
START = {"email": 0.7, "ip": 0.5, "card": 0.5, "phone": 0.5, "iban": 0.5}
CHECKED = {"email": 0.0, "ip": 0.1, "card": 0.3, "phone": 0.0, "iban": 0.4}


class Span(NamedTuple):
    kind: str
    start: int  #: in code points
    end: int  #: exclusive
    base: bool
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of ISO 13616: moved to the end, letters as 10 to 35, the number leaves 1."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * 10 + int(c) if c.isdigit() else rest * 100 + ord(c) - 55) % 97
    return rest == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their @ sign."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            free = after = m.end()
        else:
            free = after  # no later match can start before this sign
        at = text.find("@", after)


def small_ibans(text: str) -> Iterator[tuple[int, int]]:
    """IBANs in lower case, which are written without spaces; spaces between words of prose would let too much pass."""
    for m in _SMALL_IBAN.finditer(text):
        if mod97(m[0].upper()):
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``_IBAN`` that pass, or the longest part of each that passes from its start to a space; the search goes on behind that."""
    m = _IBAN.search(text)
    while m:
        groups = [g.end() for g in re.finditer("[^ ]+", m[0])]
        end = next((n for n in reversed(groups) if 15 <= len(i := m[0][:n].replace(" ", "")) <= 34 and mod97(i)), 0)
        if end:
            yield m.start(), m.start() + end
        m = _IBAN.search(text, m.start() + (end or groups[0]))  # a match that fails may hide one that starts later


def proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Confirmed spans without scores: kind, start, end, base."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b, True
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in (y.lstrip("0") or "0" for y in m[0].split("."))):
            yield "ip", *m.span(), True
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            if len(d) >= 16:
                yield "card", *m.span(), True
            elif NEARBY["card"].search(text, max(0, m.start() - CONTEXT), m.start()):
                yield "card", *m.span(), False
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdecimal, m[0])) <= 15:
                yield "phone", *m.span(), True
    for a, b in (*ibans(text), *small_ibans(text)):
        yield "iban", a, b, False


def spans(text: str) -> list[Span]:
    """All spans of a text by kind, then by start."""
    out = []
    for kind, a, b, base in proposals(text):
        before = text[max(0, a - CONTEXT) : a]
        score = START[kind] + CHECKED[kind] + 0.2 * bool(NEARBY[kind].search(before)) - 0.2 * bool(AGAINST.search(before))
        out.append(Span(kind, a, b, base, round(min(1.0, max(0.0, score)), 2)))
    return sorted(out, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


def redact(text: str, found: list[Span], least: float = 0.0) -> str:
    """The text with each span of at least that score replaced by its kind in brackets; of spans that overlap the first counts."""
    out, at = [], 0
    for s in sorted((s for s in found if s.score >= least), key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += text[at : s.start], f"[{s.kind}]"
            at = s.end
    return "".join(out) + text[at:]


SCHEMA = "spans array<struct<kind:string,start:long,end:long,base:boolean,score:double>>, redacted string"


def find_pii(docs: DataFrame, text: str = "text", least_score: float = 0.0) -> DataFrame:
    """``docs`` with a column ``pii``: a struct of ``spans`` and the ``redacted`` text.

    Each row is searched alone and whole, without a shuffle. A null text has no
    spans and a null redaction; an empty one no spans and an empty redaction;
    repeated rows get equal results; an empty table stays empty. A column ``pii`` of the input is replaced.
    """
    docs = docs.drop("pii")
    names = docs.columns
    inner = StructType.fromDDL(SCHEMA)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                texts = batch.column(names.index(text)).to_pylist()
                found = [spans(t) if t else [] for t in texts]
                clean = [None if t is None else redact(t, f, least_score) if f else t for t, f in zip(texts, found, strict=True)]
                rows = pa.array([[s._asdict() for s in f] for f in found], pa.list_(span))
                pii = pa.StructArray.from_arrays([rows, pa.array(clean, pa.string())], ["spans", "redacted"])
                yield pa.RecordBatch.from_arrays([*batch.columns, pii], [*names, "pii"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("pii", inner)]))
