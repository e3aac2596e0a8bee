"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Kinds: email, ip, card (Luhn) and phone are always kept once their checks hold.  iban (mod-97) and ssn are further
kinds, kept when their score reaches THRESHOLD: a passed checksum or a context word within CONTEXT_CHARS lifts it.
Every scan is linear in the text's length, whatever the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
THRESHOLD = 0.5
CONTEXT_CHARS = 40
#: Score of a span whose check holds, and what a context word adds.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT_BONUS = 0.3
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "fax", "mobile"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "taxpayer"),
}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    """Whether the last of these digits is their Luhn check digit."""
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(x)] for x in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an IBAN without spaces has a remainder of 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the run of local characters before it; the leftmost match must start where that run starts."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at)):
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", *m.span()
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in _IBAN.finditer(text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34 and mod97(account):
            yield "iban", *m.span()
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            yield "ssn", *m.span()


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind; code points, end exclusive."""
    if not text:
        return []
    found, taken = [], []
    for kind, start, end in _proposals(text):
        near = (text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()
        score = min(1.0, SCORES[kind] + CONTEXT_BONUS * any(w in near for w in CONTEXT[kind]))
        if kind in BASE:
            taken.append((start, end))
        elif score < THRESHOLD or any(start < b and a < end for a, b in taken):
            continue
        found.append((kind, start, end, score))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t)] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, _SPANS)], ["doc_id", "spans"])


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id and its spans, over the whole text.

    A null or empty text has no spans; doc_id may be null or repeated and passes through; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_find, f"doc_id long, spans {SPANS}")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return find_pii(docs).select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact_text(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced together, by the first one's kind."""
    spans = spans_of(text)
    if not spans:
        return text
    out, end = [], 0
    for kind, a, b, _ in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


@F.pandas_udf(StringType())
def _redacted(text: pd.Series) -> pd.Series:
    return text.map(redact_text, na_action="ignore").astype(object)


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with personal data in `text` replaced, and `n_chars`, if there, counted again where the text changed.

    Texts without spans, null texts and all other columns stay as they are.
    """
    out = docs.withColumn("text", F.struct(F.col("text").alias("old"), _redacted("text").alias("new")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text.old") == F.col("text.new"), F.col("n_chars")).otherwise(F.coalesce(F.length("text.new").cast("long"), F.col("n_chars"))))
    return out.withColumn("text", F.col("text.new")).select(*docs.columns)
