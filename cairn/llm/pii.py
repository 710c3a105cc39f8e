"""Personal data: regular expressions propose spans, checksums confirm them, and words nearby adjust the score.

The four base kinds (email, ip, card, phone) are found leftmost and without overlap within each kind; a match that
fails its test is dropped and not tried again from within. They always count. Beyond them the operator proposes IBANs
(mod-97), shorter cards (13 to 15 digits, Luhn), US social security numbers and phones without a plus; each starts
with a score of its own, gains what nearby context words give, loses where context speaks against it, and stays at
ACCEPT or more, if it overlaps no other span.

Null texts count as empty. Spans are in code points, end exclusive. Every pattern runs in linear time, so that texts
may be of any length; rows may repeat and keys may be null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import map_texts, small_batches, trimmed

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "short_card", "ssn", "local_phone")
ACCEPT = 0.6
#: Code points on either side in which context words count.
NEAR = 40

# Each anchored form below has the matches of the contract's pattern; a look-behind or a possessive quantifier only stops it from trying what can't match.
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
IBAN_TAIL = re.compile(r"(?: ?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")

#: Characters of an IBAN by country. Of other countries each length from 15 to 34 that ends a word is tried, the longest first.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

CONTEXT = {
    "iban": re.compile(r"(?i)\b(?:iban|bank|account|konto|cuenta|compte|bic|swift)\b"),
    "short_card": re.compile(r"(?i)\b(?:card|visa|amex|credit|debit|karte|tarjeta|carte)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security|taxpayer)\b"),
    "local_phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|telefon|tel[eé]fono|t[eé]l[eé]phone)\b"),
}
AGAINST = re.compile(r"(?i)\b(?:order|invoice|serial|version|part|sku|isbn|example)\b")
START = {"iban": 0.7, "short_card": 0.4, "ssn": 0.4, "local_phone": 0.45}
GAIN, LOSS = 0.3, 0.2


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ that a domain follows, back over the local part, but not into the email before."""
    out, done = [], 0
    for m in EMAIL_TAIL.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            done = m.end()
    return out


def ibans(text: str) -> list[tuple[int, int]]:
    """Leftmost and without overlap, each cut at its country's length; from where none is confirmed, the search goes on behind the head's first letter."""
    out, at = [], 0
    while head := IBAN_HEAD.search(text, at):
        at = head.start() + 1
        if not (tail := IBAN_TAIL.match(text, head.end())):
            continue
        stops = [i + 1 for i in range(head.start(), tail.end()) if text[i] != " "]  # where the IBAN of each length ends
        n = IBAN_LENGTHS.get(head[0][:2])
        for k in range(len(stops), 14, -1) if n is None else [n] if n <= len(stops) else []:
            end = stops[k - 1]
            if not (text[end : end + 1].isascii() and text[end : end + 1].isalnum()) and mod97(text[head.start() : end].replace(" ", "")):
                out.append((head.start(), end))
                at = end
                break
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = dict.fromkeys(BASE_KINDS, [])
    if "@" in text:
        found["email"] = emails(text)
    if "." in text:
        found["ip"] = [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    found["card"] = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def _scored(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    return START[kind] + GAIN * bool(CONTEXT[kind].search(near)) - LOSS * bool(AGAINST.search(near))


def spans(text: str) -> list[Span]:
    """All spans, by kind as listed, then start. Base spans have score 1."""
    base = base_spans(text)
    out = [Span(k, a, b, 1.0) for k in BASE_KINDS for a, b in base[k]]
    proposed = [("iban", x) for x in ibans(text)]
    proposed += [("short_card", m.span()) for m in CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 15 and luhn(d)]
    proposed += [("ssn", m.span()) for m in SSN.finditer(text)] + [("local_phone", m.span()) for m in LOCAL_PHONE.finditer(text)]
    more = []
    if not proposed:
        return out
    taken = bytearray(len(text))
    for x in out:
        taken[x.start : x.end] = b"\1" * (x.end - x.start)
    for kind, (a, b) in proposed:
        if (score := _scored(kind, text, a, b)) >= ACCEPT and 1 not in taken[a:b]:
            more.append(Span(kind, a, b, round(score, 3)))
            taken[a:b] = b"\1" * (b - a)
    return out + more


def listed(found: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in found)


def mask(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans one mark stays, that of the first."""
    out, done = [], 0
    for x in sorted(found, key=lambda x: (x.start, -x.end)):
        if x.start >= done:
            out += [text[done : x.start], f"[{x.kind}]"]
        done = max(done, x.end)
    return "".join([*out, text[done:]])


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the found spans, as an array of kind, start, end, score."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, found array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            found = [[x.__dict__ for x in spans(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=[key, "found"])

    return docs.select(docs[key], docs[text]).mapInArrow(run, schema)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, a count for each base kind, the digest of the base spans, and all spans as one string."""

    def kernel(batch: list[str]) -> dict[str, object]:
        found = [spans(t) for t in batch]
        base = [[x for x in f if x.kind in BASE_KINDS] for f in found]
        counts = {f"n_{k}": [sum(x.kind == k for x in f) for f in base] for k in BASE_KINDS}
        return counts | {"base_sha256": [hashlib.sha256(listed(f).encode()).hexdigest() for f in base], "spans": [listed(f) for f in found]}

    counts = ", ".join(f"n_{k} bigint" for k in BASE_KINDS)
    return map_texts(docs, [key], text, f"`{key}` {docs.schema[key].dataType.simpleString()}, {counts}, base_sha256 string, spans string", kernel)


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with every span masked, and n_chars, if there is such a column, counted anew. Null texts stay null."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            masked = [None if t is None else mask(t, spans(t)) for t in b.column(names.index(text)).to_pylist()]
            columns = list(b.columns)
            columns[names.index(text)] = pa.array(masked, pa.string())
            if n_chars in names:
                i = names.index(n_chars)
                columns[i] = pa.array([None if t is None else len(t) for t in masked], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(trimmed(run), docs.schema)
