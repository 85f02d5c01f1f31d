"""Personal data: patterns propose, checksums confirm, context words adjust.

A proposed span has a base score by kind; a passing checksum (Luhn for cards, mod-97 for IBANs)
or range check raises it, a failing one drops the span, and words near the span move the score
up or down. Kinds of the base contract (email, ip, card, phone) are kept once their check
passes, whatever the context; added kinds (iban, ssn) must reach ``THRESHOLD``. A checksum that
passes is not outvoted by context.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lean import lean, pieces
from .store import read

#: Kinds in the order that breaks ties between spans with one start.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
THRESHOLD = 0.7
CONFIRMED = 0.8  # least score of a span whose checksum has passed
CONTEXT = 40  # characters on either side
#: Words near a span that speak for a kind, and words that speak against personal data.
FOR_KIND = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "sozialversicherung", "sécurité sociale", "securite sociale", "seguridad social"),
}
AGAINST = ("version", "isbn", "order", "invoice", "example", "sample")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN by country (SWIFT's registry).
_IBAN_LENGTH = {
    c: n
    for n, some in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in some.split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Valid IBANs. A proposed span may run over following words, so it is cut to its country's length
    where that is known and ends at a blank; the search goes on behind a valid one, or behind the
    first letter of a span that fails."""
    at = 0
    while m := _IBAN.search(text, at):
        at, n, size = m.start() + 1, 0, _IBAN_LENGTH.get(m[0][:2], len(m[0].replace(" ", "")))
        for end in range(m.start() + 1, m.end() + 1):
            n += text[end - 1] != " "
            if n == size:
                if (end == m.end() or text[end] == " ") and mod97(text[m.start() : end]):
                    yield m.start(), end
                    at = end
                break


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses. Each holds one ``@``, so the scan goes from one to the
    next, back over the local part to the end of the last address at most."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (tail := _DOMAIN.match(text, at + 1)):
            yield start, tail.end()
            free = tail.end()
        at = text.find("@", max(at + 1, free))


def _score(kind: str, text: str, start: int, end: int) -> float:
    """Score of a span of an added kind whose checksum or shape has passed."""
    around = text[max(0, start - CONTEXT) : end + CONTEXT].lower()
    score = 0.5 + 0.3 * any(w in around for w in FOR_KIND[kind]) - 0.3 * any(w in around for w in AGAINST)
    return max(score, CONFIRMED) if kind == "iban" else score


def spans(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans, by start and then kind as listed; code points, end
    exclusive. A null or empty text has none. Matches of base kinds and SSNs that fail their
    check are dropped without a retry at a later offset."""
    if not text:
        return []
    found = [(s, "email", e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), "phone", m.end()))
    for kind, some in (("iban", ibans(text)), ("ssn", (m.span() for m in _SSN.finditer(text)))):
        found += [(start, kind, end) for start, end in some if _score(kind, text, start, end) >= THRESHOLD]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in found)


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans merge into the
    first one's mark. Null stays null."""
    found = spans(text)
    if not found:
        return text
    out, at = [], 0
    for start, kind, end in found:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, counts of the base kinds, SHA-256 of the base spans, all spans.

    Null and empty texts have no spans; repeated rows and null keys are kept; whole texts are
    scanned; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [spans(t) for t in batch["_text"]]
            base = [[x for x in f if x[1] in BASE] for f in found]
            out = {"_key": batch["_key"]}
            for kind in BASE:
                out[f"n_{kind}"] = [sum(x[1] == kind for x in b) for b in base]
            out["base_sha256"] = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            out["spans"] = [joined(f) for f in found]
            yield pd.DataFrame(out)

    frame = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    counts = ", ".join(f"n_{k} long" for k in BASE)
    schema = f"_key {dict(frame.dtypes)['_key']}, {counts}, base_sha256 string, spans string"
    return frame.mapInPandas(run, schema).withColumnRenamed("_key", key)


def redact_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` redacted and every other column as it was. A worker holds the strings of one piece of a batch."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for piece in pieces(batch):
                yield pa.array([redact(t) for t in piece.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return lean(run)(batches)

    names = [f"_c{i}" for i in range(len(docs.columns))]
    frame = docs.toDF(*names)
    return frame.withColumn(names[at], masked(names[at])).toDF(*docs.columns)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(read(spark, sf_dir, "documents"))
