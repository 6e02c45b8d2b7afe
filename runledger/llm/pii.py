"""Private data: an Aho-Corasick automaton finds anchors, local parsers expand and check each of them.

Anchors are at-signs, plus signs, digits, URL schemes and the cue words of accounts and addresses. Around an anchor a
parser walks as far as its kind allows and then validates: labels of a domain, parts of an IP address, the Luhn sum of
a card, the digits of a phone number, the mod-97 sum of an IBAN. Texts are only scanned by the automaton.

Null and empty texts have no spans. Repeated rows are judged one by one. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.storage import plain_documents

#: In the order in which spans with the same start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "address")
#: Cue words before an identifier, and words that end a street name.
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "passport", "konto", "cuenta", "compte")
STREET_WORDS = (" Street", " Avenue", " Road", " Lane", " Drive", " Boulevard")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}$")
_URL_REST = re.compile(r"://[^\s<>\"']+")
_IDENTIFIER = re.compile(r"(?:[ :#.]|no\b|nr\b|number\b){0,12}([A-Z]{0,3}[0-9][A-Z0-9 -]{4,32}[A-Z0-9])", re.IGNORECASE)
_STREET = re.compile(r"[0-9]{1,5} (?:[A-Z][a-z]+ ){0,2}[A-Z][a-z]+$")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), ("://", ":"), *((str(d), "0") for d in range(10))]:
        found.add_word(word, (kind, len(word)))
    for cue in ACCOUNT_CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("account", len(form)))
    for word in STREET_WORDS:
        found.add_word(word, ("street", len(word)))
    found.make_automaton()
    return found


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _iban(text: str) -> bool:
    compact = text.replace(" ", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", compact):
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _account(text: str, cue: str, end: int) -> tuple[int, int] | None:
    found = _IDENTIFIER.match(text, end)
    if not found:
        return None
    value = found[1]
    good = _iban(value) if cue.lower() == "iban" else 6 <= len(_only_digits(value)) <= 20
    return found.span(1) if good else None


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then kind as listed."""
    spans: list[tuple[str, int, int]] = []
    email = ip = card = phone = url = account = 0  # what lies before has been used up by that kind
    for last, (kind, size) in _ANCHORS.iter(text):
        at = last + 1 - size
        if kind == "0":
            if at >= card:
                found = _CARD.match(text, at)
                card = found.end() if found else at + 1
                if found and 14 <= len(digits := _only_digits(found[0])) <= 19 and luhn(digits):
                    spans.append(("card", *found.span()))
            if at >= ip:
                found = _IP.match(text, at)
                ip = found.end() if found else _DIGITS.match(text, at).end()
                if found and all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in found[0].split(".")):
                    spans.append(("ip", *found.span()))
        elif kind == "@":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            found = _DOMAIN.match(text, at) if start < at else None
            if found:
                spans.append(("email", start, found.end()))
                email = found.end()
        elif kind == "+":
            found = _PHONE.match(text, at) if at >= phone else None
            if found:
                phone = found.end()
                if 10 <= len(_only_digits(found[0])) <= 15:
                    spans.append(("phone", *found.span()))
        elif kind == ":":
            scheme = _SCHEME.search(text, max(url, at - 16), at)
            found = _URL_REST.match(text, at)
            if scheme and found:
                end = at + len(found[0].rstrip(".,;:!?)]}"))
                if end > at + 3:
                    spans.append(("url", scheme.start(), end))
                    url = end
        elif kind == "account":
            if at >= account and (at == 0 or not text[at - 1].isalnum()):
                found = _account(text, text[at : last + 1], last + 1)
                if found:
                    spans.append(("account", *found))
                    account = found[1]
        elif last + 1 == len(text) or not text[last + 1].isalnum():
            found = _STREET.search(text, max(0, at - 60), at)
            if found:
                spans.append(("address", found.start(), last + 1))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; what overlaps an earlier span goes with it."""
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find(text or "") for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in found], type=pa.list_(_SPAN))],
            ["doc_id", "spans"],
        )


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the list of spans (kind, start, end) of every document."""
    return plain_documents(docs).mapInArrow(_spans, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind, and n_chars counted anew. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text if text is None else redacted(text, find(text)) for text in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, type=batch.schema.field("text").type))

    cleaned = docs.mapInArrow(run, docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find(text or "") for text in batch.column("text").to_pylist()]
        base = [[s for s in spans if s[0] in BASE_KINDS] for spans in found]
        counts = [pa.array([sum(s[0] == kind for s in spans) for spans in base], type=pa.int64()) for kind in BASE_KINDS]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *counts,
                pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]),
                pa.array([joined(spans) for spans in found], type=pa.string()),
            ],
            ["doc_id", *(f"n_{kind}" for kind in BASE_KINDS), "base_sha256", "spans"],
        )


def digest(docs: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds, a hash of the base spans, and all spans as text."""
    return plain_documents(docs).mapInArrow(_digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
