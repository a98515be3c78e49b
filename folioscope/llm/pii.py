"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Every kind starts from a prior.  A checksum that holds (Luhn for cards, mod-97 for
bank accounts) adds to it, and words of the kind within ``CONTEXT`` characters
add or take off.  The four base kinds are kept whatever their score; the kinds and
forms beyond them are kept from ``threshold`` up and never overlap a base span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import text_batches

KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
CONTEXT = 48

_MAY_HOLD = re.compile("[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\) |[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])")
_DIGITS = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+")

# kind: prior, words that speak for it, words that speak against it
SCORES = {
    "email": (0.8, {"email", "mail", "contact", "write", "address", "courriel", "correo"}, {"example"}),
    "ip": (0.6, {"ip", "address", "host", "server", "login", "adresse", "dirección"}, {"version", "release", "section", "licence", "license"}),
    "card": (0.5, {"card", "visa", "mastercard", "credit", "debit", "carte", "tarjeta", "karte"}, {"isbn", "order", "serial", "tracking"}),
    "phone": (0.6, {"phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"}, {"isbn", "order", "serial"}),
    "iban": (0.5, {"iban", "account", "bank", "konto", "compte", "cuenta"}, {"serial", "model"}),
    "national_id": (0.4, {"ssn", "social", "security", "taxpayer", "identity"}, {"serial", "part", "order"}),
    "local_phone": (0.4, {"phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"}, {"isbn", "order", "serial"}),
}
CHECKSUM_GAIN, FOR_GAIN, AGAINST_LOSS = 0.3, 0.2, 0.2


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number (letters and digits) has the remainder 1."""
    remainder = 0
    for c in account[4:] + account[:4]:
        value = int(c, 36)
        remainder = (remainder * (100 if value > 9 else 10) + value) % 97
    return remainder == 1


def _score(kind: str, text: str, start: int, end: int, confirmed: bool) -> float:
    prior, speak_for, speak_against = SCORES[kind]
    words = set(_WORD.findall(text[max(0, start - CONTEXT):start].lower() + " " + text[end:end + CONTEXT].lower()))
    score = prior + CHECKSUM_GAIN * confirmed + FOR_GAIN * bool(words & speak_for) - AGAINST_LOSS * bool(words & speak_against)
    return round(min(max(score, 0.0), 1.0), 3)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses; each character is looked at a few times only."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            free = host.end()
            yield start, free
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers whose mod-97 holds, tried from the longest match down to shorter ends before a blank."""
    at = 0
    while m := _IBAN.search(text, at):
        start, end = m.span()
        at = start + 4
        while end > start and len(account := text[start:end].replace(" ", "")) >= 15:
            if mod97(account):
                yield start, end
                at = end
                break
            end = text.rfind(" ", start, end)


def spans(text: str, threshold: float = 0.6) -> list[tuple[str, int, int, bool, float]]:
    """``(kind, start, end, base, score)`` of a text, by kind and start, in code points."""
    if not text or not _MAY_HOLD.search(text):
        return []
    base = []
    if "@" in text:
        base += [("email", a, b, False) for a, b in _emails(text)]
    if _DIGITS.search(text):
        base += [("ip", *m.span(), False) for m in _IP.finditer(text)
                 if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                base.append(("card", *m.span(), True))
        if "+" in text:
            base += [("phone", *m.span(), False) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    found = [(kind, a, b, True, _score(kind, text, a, b, ok)) for kind, a, b, ok in base]
    if _DIGITS.search(text):
        taken = sorted((a, b) for _, a, b, _ in base)
        more = [("iban", a, b, True) for a, b in _accounts(text)]
        more += [("national_id", *m.span(), False) for m in _NATIONAL_ID.finditer(text)]
        more += [("local_phone", *m.span(), False) for m in _LOCAL_PHONE.finditer(text)]
        for kind, a, b, ok in more:
            score = _score(kind, text, a, b, ok)
            if score >= threshold and not any(x < b and a < y for x, y in taken):
                found.append(("phone" if kind == "local_phone" else kind, a, b, False, score))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))


def find_personal_data(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``(doc_id, spans)`` of every document (doc_id, text): kind, place, base, score.

    A null text is an empty one and has no spans; rows of equal or null id stay
    separate rows; other columns are ignored.  One narrow pass.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows = [[dict(zip(("kind", "start", "end", "base", "score"), s)) for s in spans(t, threshold)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _ARROW)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a checksum of the base spans, and all spans as text."""
    def told(rows):
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    def of_kind(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.withColumn("base", base).select(
        "doc_id", *[of_kind(k) for k in KINDS[:4]], F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))
