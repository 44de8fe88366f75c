"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from claimtrace.llm.text import cut

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
NEAR = 40

#: the patterns; a possessive or bounded form of each gives the same matches in linear time
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DIGIT = re.compile("[0-9]")

#: score of a confirmed match, and words nearby that raise or lower it
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
WORDS = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "host", "server", "address", "client"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "payment"},
    "phone": {"phone", "tel", "call", "mobile", "fax"},
    "iban": {"iban", "account", "bank", "transfer", "konto"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
}
AGAINST = {"version", "isbn", "order", "serial", "example", "release"}
WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    """Checksum of card numbers: every second digit from the right is doubled."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Checksum of account numbers: first four characters moved last, letters as 10 to 35."""
    remainder = 0
    for c in iban[4:] + iban[:4]:
        value = int(c, 36)
        remainder = (remainder * (100 if value > 9 else 10) + value) % 97
    return remainder == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from each @ to the left as far as the letters before it go."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            end = domain.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= len(DIGIT.findall(m.group())) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        code = m.group().replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            yield m.span()


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns}


def score(kind: str, text: str, start: int, end: int) -> float:
    """Prior of the kind, raised or lowered by whole words within NEAR characters."""
    near = WORD.findall((text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower())
    value = PRIOR[kind] + 0.3 * bool(WORDS[kind].intersection(near)) - 0.3 * bool(AGAINST.intersection(near))
    return round(min(1.0, max(0.0, value)), 2)


def find(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; base kinds stay at any score.

    Base matches are leftmost and do not overlap within a kind; one that fails its check is
    dropped and not tried again shorter. Spans of the other kinds need ``threshold``.
    """
    out = []
    digits = DIGIT.search(text) is not None
    for kind in KINDS:
        if "@" not in text if kind == "email" else "+" not in text if kind == "phone" else not digits:
            continue
        for start, end in FINDERS[kind](text):
            value = score(kind, text, start, end)
            if kind in BASE or value >= threshold:
                out.append((kind, start, end, value))
    return out


def pii_spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Personal data in every whole text: doc_id, spans array<struct<kind, start, end, score, value>>.

    Offsets count code points, ends are exclusive. Null and empty texts have no spans; repeated
    rows give repeated rows; other columns are ignored. Nothing is shuffled: each text is
    searched where it is read, in time linear in its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("value", pa.string())]))
        for ids, texts in _texts(batches):
            rows = [[{"kind": k, "start": a, "end": b, "score": s, "value": t[a:b]} for k, a, b, s in find(t, threshold)] for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, kind)], ["doc_id", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, spans array<struct<kind: string, start: bigint, end: bigint, score: double, value: string>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pii_digests(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts of base spans, the hash of their places, and all spans as text, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            found = [find(t, threshold) for t in texts]
            base = [[s for s in spans if s[0] in BASE] for spans in found]
            counts = [pa.array([sum(s[0] == kind for s in spans) for spans in base], pa.int64()) for kind in BASE]
            digest = [hashlib.sha256(_joined(spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays(
                [ids, *counts, pa.array(digest, pa.string()), pa.array(map(_joined, found), pa.string())],
                ["doc_id", *(f"n_{kind}" for kind in BASE), "base_sha256", "spans"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{kind} bigint" for kind in BASE)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {counts}, base_sha256 string, spans string")


def _joined(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join([f"{kind}:{start}:{end}" for kind, start, end, _ in spans])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for part in cut(batches, "text"):
        yield part.column("doc_id"), [t or "" for t in part.column("text").to_pylist()]
