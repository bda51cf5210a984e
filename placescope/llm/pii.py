r"""Operator 13: personal data as spans of whole texts.

Regular expressions propose spans, validators confirm them (part sizes, digit counts, the Luhn sum, the
remainder of 97 of account numbers), and words nearby raise or lower the score that a kind begins with.
The four base kinds stay whatever their score. Kinds of the method's own stay from ``LEAST_SCORE`` on if
they overlap no span of an earlier kind: those that a checksum confirms stand alone, the others need a
word nearby that names them.

Every pattern is tried in time linear in the text: a run of digits is entered at its beginning only, and
an address is sought from its @ outwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from placescope.llm.arrow import narrow

LEAST_SCORE = 0.6
#: Code points before and behind a span in which words count.
BEFORE, BEHIND = 48, 24
#: What a word nearby adds for its kind, or takes where it names something else.
NEAR, AGAINST = 0.3, -0.3

Found = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_SOCIAL = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /.-]|[0-9]{3}[ .-])[0-9]{3,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])")
_ANY = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\W\d_]+")

# Lengths of account numbers by country, as their registry gives them.
IBAN_LENGTHS = {
    "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


def luhn(digits: str) -> bool:
    """Whether the weighted digit sum is divisible by ten: every second digit from the right counts double, less 9 above 9."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number without blanks leaves 1 modulo 97, its first four characters moved to the end and letters read as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[Found]:
    free = 0  # behind the last match
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", free if domain else at + 1)


def ips(text: str) -> Iterator[Found]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 3 or (len(p) == 3 and int(p) <= 255) for p in parts):
            yield m.span()


def _digits(least: int, most: int) -> Callable[[str], Iterator[Found]]:
    def found(text: str) -> Iterator[Found]:
        for m in _DIGITS.finditer(text):
            if m.end() - m.start() >= least:
                digits = m.group().replace(" ", "").replace("-", "")
                if least <= len(digits) <= most and luhn(digits):
                    yield m.span()

    return found


def phones(text: str) -> Iterator[Found]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
            yield m.span()


def accounts(text: str) -> Iterator[Found]:
    """Account numbers of the length of their country, single blanks between characters or none."""
    for m in _IBAN.finditer(text):
        need, at, got = IBAN_LENGTHS.get(text[m.start() : m.start() + 2], 0), m.start(), []
        while len(got) < need and at < len(text):
            c = text[at]
            if c == " " and got and text[at - 1] != " ":
                at += 1
                continue
            if not ("0" <= c <= "9" or "A" <= c <= "Z"):
                break
            got.append(c)
            at += 1
        if need and len(got) == need and not text[at : at + 1].isalnum() and mod97("".join(got)):
            yield m.start(), at


def socials(text: str) -> Iterator[Found]:
    for m in _SOCIAL.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def nationals(text: str) -> Iterator[Found]:
    for m in _NATIONAL.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m.group()) <= 12:
            yield m.span()


@dataclass(frozen=True)
class Kind:
    name: str
    find: Callable[[str], Iterator[Found]]
    score: float
    near: frozenset[str]
    against: frozenset[str] = frozenset("version release isbn issn article artikel order invoice rechnung chapter section figure".split())
    base: bool = False


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: In the order in which spans are listed and take precedence: the base kinds, then the method's own.
KINDS = (
    Kind("email", emails, 0.9, _words("email mail e contact kontakt courriel correo write"), base=True),
    Kind("ip", ips, 0.6, _words("ip address adresse dirección server host login client"), base=True),
    Kind("card", _digits(16, 19), 0.8, _words("card karte carte tarjeta credit kredit crédit crédito visa mastercard payment"), base=True),
    Kind("phone", phones, 0.7, _words("phone tel telephone call mobile cell fax telefon handy anruf téléphone appel portable teléfono móvil llame"), base=True),
    Kind("iban", accounts, 0.8, _words("iban account bank konto compte banque cuenta banco")),
    Kind("short_card", _digits(13, 15), 0.3, _words("card karte carte tarjeta credit kredit crédit crédito amex diners payment")),
    Kind("ssn", socials, 0.3, _words("ssn social security sozialversicherung sécurité sociale seguridad")),
    Kind("national_phone", nationals, 0.3, _words("phone tel telephone call mobile cell fax telefon handy anruf téléphone appel portable teléfono móvil llame")),
)


def scored(text: str, kind: Kind, start: int, end: int) -> float:
    nearby = {w.lower() for w in _WORD.findall(text[max(0, start - BEFORE) : start] + " " + text[end : end + BEHIND])}
    score = kind.score + NEAR * (not nearby.isdisjoint(kind.near)) + AGAINST * (not nearby.isdisjoint(kind.against))
    return min(1.0, max(0.0, round(score, 6)))


def spans(text: str, kinds: tuple[Kind, ...] = KINDS, least: float = LEAST_SCORE) -> list[tuple[str, int, int, float]]:
    """Kind, first code point, code point behind the last, and score; by kind as listed, then by place."""
    if not _ANY.search(text):
        return []
    out: list[tuple[str, int, int, float]] = []
    for kind in kinds:
        for start, end in list(kind.find(text)):
            score = scored(text, kind, start, end)
            if kind.base or (score >= least and not any(k != kind.name and s < end and start < e for k, s, e, _ in out)):
                out.append((kind.name, start, end, score))
    return out


def find_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans (kind, start, end, score, base) of every row.

    A null text is empty and has no spans. Rows with equal or null ids are searched one by one; other
    columns are ignored; an empty table gives no rows.
    """
    base = {k.name for k in kinds if k.base}
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1_000):
                part = batch.slice(first, 1_000)
                found = [[{"kind": k, "start": s, "end": e, "score": x, "base": k in base} for k, s, e, x in spans(t.as_py() or "", kinds, least)] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, found array<struct<kind: string, start: long, end: long, score: double, base: boolean>>")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, least: float = LEAST_SCORE) -> DataFrame:
    """The rows' ids and texts with each span replaced by its kind in angle brackets; spans that overlap become one, named by the first kind."""

    def one(text: str | None) -> str | None:
        if not text:
            return text
        out, at, order = [], 0, sorted(spans(text, kinds, least), key=lambda x: (x[1], x[2]))
        for kind, start, end, _ in order:
            if start >= at:
                out += [text[at:start], f"<{kind}>"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t.as_py()) for t in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, all spans as text and the greatest score, for each row of ``find_spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.column(1).to_pylist():
                name = [f"{x['kind']}:{x['start']}:{x['end']}" for x in row]
                own = ",".join(n for n, x in zip(name, row, strict=True) if x["base"])
                counts = [sum(x["kind"] == k for x in row) for k in ("email", "ip", "card", "phone")]
                rows.append((*counts, hashlib.sha256(own.encode()).hexdigest(), ",".join(name), max((x["score"] for x in row), default=0.0)))
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64())
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "score"]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, score double")
