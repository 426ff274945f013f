"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm.common import table, text_or_empty

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "mac")
BASE = KINDS[:4]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only begin where a run of digits does, as a longer one would begin before it otherwise.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
MAC = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])")
#: Words near a span that make its kind likelier, and those that make it less likely.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
    "mac": ("mac", "device", "hardware"),
}
AGAINST = ("example", "sample", "version", "isbn", "order", "part")
#: Score of a span whose checks hold, before its context counts; spans of the added kinds need THRESHOLD.
PRIOR = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.95, "ssn": 0.5, "mac": 0.7}
THRESHOLD, WINDOW, STEP = 0.6, 48, 0.15
_WORD = re.compile(r"[a-z]+")


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


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @: linear in the text however long its words are."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the four base kinds, each kind's matches leftmost and not overlapping; failing ones go."""
    out = [(s, "email", e) for s, e in emails(text)]
    if "." in text:
        out += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    if "+" in text:
        out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return out


def score(text: str, start: int, kind: str, end: int) -> float:
    near = set(_WORD.findall(f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}".lower()))
    return min(1.0, max(0.0, PRIOR[kind] + STEP * len(near.intersection(CONTEXT[kind])) - STEP * len(near.intersection(AGAINST))))


def added_spans(text: str) -> list[tuple[int, str, int]]:
    """Spans of the further kinds whose checks hold and whose score with its context reaches THRESHOLD."""
    out = [(m.start(), "iban", m.end()) for m in IBAN.finditer(text) if 15 <= len(c := m[0].replace(" ", "")) <= 34 and mod97(c)]
    out += [(m.start(), "ssn", m.end()) for m in SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    out += [(m.start(), "mac", m.end()) for m in MAC.finditer(text)]
    return [x for x in out if score(text, *x) >= THRESHOLD]


def _ordered(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[1])))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each maximal run of overlapping spans replaced by its first span's kind."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base = _ordered(base_spans(text))
            every = _ordered(base + added_spans(text))
            kinds = [k for _, k, _ in base]
            rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, hash of the base spans, all spans as kind:start:end in code points.

    Null text counts as empty; a null id stays null; repeated rows each give a row; empty tables give none; other
    columns are not read. Texts of any length are read whole, in time linear in their length. Where spans of two kinds
    begin together they stand in the order of KINDS.
    """
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return pairs.mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if t is None else masked(t, _ordered(base_spans(t) + added_spans(t))) for t in batch.column("text").to_pylist()]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every span masked by its kind; n_chars follows the text."""
    hidden = docs.mapInArrow(mask, docs.schema)
    return hidden.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else hidden


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
