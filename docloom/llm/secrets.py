"""Secret scans with structural confirmation.

Base patterns find assignments, access keys and hex strings. The method decodes base64 and hex
candidates and reports those whose bytes parse as a private key (nested DER or length-prefixed
fields), as a signed token with a valid header, or as text that itself holds a base match.

Nulls: a null text is the empty text and yields no span; a null id stays null. Repeated rows are
scanned and returned each. Other input columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, texts

# The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "jwt", "pem", "key", "encoded")

_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----\s*((?:[A-Za-z-]{1,40}:[^\r\n]*\r?\n)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]{1,76}={0,2}")
_ANYHEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32,}(?![0-9A-Fa-f])")
_LONG = 20  # no access key, hex string or encoded candidate is shorter

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping base matches of each kind; failing matches consume their text, then go."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if any(len(w) >= _LONG for w in text.split()):
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


def unbase64(value: str) -> bytes | None:
    """Bytes of standard or URL-safe base64 with or without padding, else None."""
    body = value.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list | None:
    """Nested DER: a list of (tag, value or children) that fills data[at:end] exactly, else None."""
    end, out = len(data) if end is None else end, []
    while at < end:
        if at + 2 > end or depth > 12:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end:
            return None
        value = data[at : at + size]
        if tag & 0x20:
            value = der(data, at, at + size, depth + 1)
            if value is None:
                return None
        out.append((tag, value))
        at += size
    return out


def ssh_fields(data: bytes) -> bool:
    """An OpenSSH private key container: magic, then length-prefixed fields that fit."""
    magic, at, fields = b"openssh-key-v1\0", 15, 0
    if not data.startswith(magic):
        return False
    while at + 4 <= len(data) and fields < 3:
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        fields += 1
    return fields == 3 and at <= len(data)


def is_private_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (encrypted, too), EC or DSA private key in DER, or an OpenSSH container."""
    if data[:1] == b"\x30":
        top = der(data)
        if not top or len(top) != 1:
            return False
        parts = top[0][1]
        tags = [t for t, _ in parts]
        if tags == [0x30, 0x04]:  # encrypted: its algorithm, then the bytes
            return bool(parts[0][1]) and parts[0][1][0][0] == 0x06 and len(parts[1][1]) >= 16
        if tags[:1] != [0x02] or len(parts[0][1]) != 1:  # a version comes first
            return False
        integers = tags == [0x02] * len(tags) and len(tags) in (6, 9)
        pkcs8 = tags[:3] == [0x02, 0x30, 0x04] and bool(parts[1][1]) and parts[1][1][0][0] == 0x06
        ec = tags[:2] == [0x02, 0x04] and len(parts[1][1]) >= 16
        return integers or pkcs8 or ec
    return ssh_fields(data)


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    """Both parts decode to JSON objects, the header names an algorithm that signs, and there is a signature."""
    try:
        head, body = (json.loads(unbase64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and head["alg"].lower() != "none" and isinstance(body, dict) and bool(unbase64(signature))


def _encoded_kind(data: bytes | None) -> str | None:
    if not data or len(data) < 16:
        return None
    if is_private_key(data):
        return "key"
    if all(32 <= b < 127 or b in (9, 10, 13) for b in data):
        inner = data.decode("ascii")
        if base_spans(inner) or any(is_signed_token(m[1], m[2], m[3]) for m in _JWT.finditer(inner)):
            return "encoded"
    return None


def structural_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates confirmed by their structure."""
    out = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = unbase64(re.sub(r"\s", "", m[3]))
            encrypted = "ENCRYPTED" in m[2] and "DEK-Info" in m[2] and data and len(data) % 8 == 0  # its bytes are no DER
            if data and (encrypted or is_private_key(data) or der(data)):
                out.append(("pem", m.start(), m.end()))
    if not any(len(w) >= _LONG for w in text.split()):
        return out
    if "eyJ" in text:
        out += [("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if is_signed_token(m[1], m[2], m[3])]
    taken = [(s, e) for _, s, e in out]
    found = [(m.start(), m.end(), unbase64(m[0])) for m in _B64.finditer(text)]
    if "\n" in text:  # one value wrapped over lines
        found += [(m.start(), m.end(), unbase64(re.sub(r"\s", "", m[0]))) for m in _WRAPPED.finditer(text)]
    found += [(m.start(), m.end(), bytes.fromhex(m[0])) for m in _ANYHEX.finditer(text) if len(m[0]) % 2 == 0]
    for s, e, data in sorted(found, key=lambda x: x[:2]):
        if not any(a < e and s < b for a, b in taken) and (kind := _encoded_kind(data)):
            out.append((kind, s, e))
            taken.append((s, e))
    return out


def order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """By start, then kind as listed."""
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {k: [] for k in ("base", "all")}
        for text in texts(batch):
            base = order(base_spans(text))
            rows["base"].append([dict(zip(("kind", "start", "end"), x)) for x in base])
            rows["all"].append([dict(zip(("kind", "start", "end"), x)) for x in order(base + structural_spans(text))])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows["base"], kind), pa.array(rows["all"], kind)], names=[*keep, "base_spans", "all_spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base_spans and all_spans (arrays of kind, start, end in code points)."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("base_spans", SPAN), T.StructField("all_spans", SPAN)])
    return src.mapInArrow(_scan, schema)


def _redact(text: str) -> str:
    out, at = [], 0
    for kind, start, end in order(base_spans(text) + structural_spans(text)):
        if start >= at:
            out.append(text[at:start] + f"[{kind}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        new = [None if t is None else _redact(t) for t in batch.column("text").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, pa.string()))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """Every reported span (overlapping ones merged) becomes ``[kind]`` in column text; n_chars, where present, follows. All rows stay."""
    out = docs.mapInArrow(_redacted, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`find_secrets` over all documents."""
    spans = find_secrets(table(spark, sf_dir, "documents"))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    return spans.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(text("base_spans"), 256).alias("base_sha256"), text("all_spans").alias("spans"))
