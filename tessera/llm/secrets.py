"""Secret scan: pattern candidates, and structural confirmation of encoded keys and signed tokens.

Plain patterns give assignments, access key ids and hex runs (in lower case). Beyond them, base64 runs and lines of them, hex
runs in either case, PEM blocks and dotted tokens are decoded from their start and from every place where a key could begin, and
reported only if the bytes have the structure of a key: DER whose nested lengths
add up and whose members are those of PKCS#1, PKCS#8, SEC1 or SPKI; SSH blobs whose length prefixes add up; a
signed token whose header is a JSON object with an algorithm, whose payload is a JSON object and whose signature decodes.
Legacy PEM blocks that say they are encrypted hold no structure: their headers must name a cipher with its start vector, and
the bytes must be whole cipher blocks.

Nulls: a null text is the empty text, with no spans; a null doc_id is carried. Repeated rows are scanned each.
Spans are code points, end exclusive, in whole texts of any length. Overlapping spans of different kinds all stay. An
empty table gives no rows. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, text_or_empty

# Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "pem", "jwt", "b64key", "hexkey")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]++|-(?!----))*+)-----END \1-----")
TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+")
CIPHER = re.compile(r"[A-Z0-9-]+,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
HEX_RUN = re.compile(r"[0-9A-Fa-f]{32,}")
WRAPPED = re.compile(r"[A-Za-z0-9+/]{32,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/]+)+={0,2}")
# Where a key could begin: a DER sequence whose first member is an integer or a sequence, an SSH name's length, OPENSSH.
BASE64_START = re.compile(r"(?=M[A-P][A-Za-z0-9+/_-]{14}|AAAA[BCE][23][NV]|b3BlbnNza)")
HEX_START = re.compile(r"(?=30(?:[0-7].|81..|82.{4}|83.{6}|84.{8})(?:02|30)|000000(?:07|0b|13)|6f70656e7373682d6b65)", re.I)
SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
OPENSSH = b"openssh-key-v1\x00"
INTEGER, BIT_STRING, OCTET_STRING, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
SCHEMA = "doc_id long, spans array<struct<kind: string, start: int, end: int>>"


def der_members(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of DER values that follow each other and fill data exactly; else None."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + size > len(data):
            return None
        found.append((tag, data[at : at + size]))
        at += size
    return found


def is_der_key(data: bytes) -> bool:
    outer = der_members(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1 or not (inner := der_members(outer[0][1])):
        return False
    tags = [tag for tag, _ in inner]
    if tags[:1] == [INTEGER] and len(tags) >= 6 and set(tags) == {INTEGER} and inner[0][1] in (b"\0", b"\1"):
        return True  # PKCS#1 or DSA
    if tags[:3] == [INTEGER, SEQUENCE, OCTET_STRING]:  # PKCS#8
        return bool((algorithm := der_members(inner[1][1])) and algorithm[0][0] == OID)
    if tags[:2] == [INTEGER, OCTET_STRING] and inner[0][1] == b"\1":  # SEC1
        return len(inner[1][1]) >= 16
    if tags == [SEQUENCE, OCTET_STRING]:  # encrypted PKCS#8
        return bool((algorithm := der_members(inner[0][1])) and algorithm[0][0] == OID)
    if tags == [SEQUENCE, BIT_STRING]:  # SPKI
        return bool((algorithm := der_members(inner[0][1])) and algorithm[0][0] == OID and inner[1][1][:1] == b"\0")
    return False


def _ssh_strings(data: bytes) -> list[bytes] | None:
    found, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        found.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return found


def is_ssh_key(data: bytes) -> bool:
    if data.startswith(OPENSSH):
        at = len(OPENSSH)
        for _ in range(3):  # cipher, key derivation and its options
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        rest = data[at + 4 :]
        return int.from_bytes(data[at : at + 4], "big") >= 1 and len(rest) > 8 and _ssh_strings(rest) is not None
    if data[:3] != b"\0\0\0":
        return False
    parts = _ssh_strings(data)
    return bool(parts) and parts[0] in SSH_TYPES and len(parts) >= 2


def _unbase64(text: str) -> bytes:
    try:
        text = text.rstrip("=").replace("-", "+").replace("_", "/")
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_key(data: bytes) -> bool:
    return len(data) >= 16 and (is_der_key(data) or is_ssh_key(data))


def key_size(data: bytes) -> int:
    """Bytes of the key that data begins with: all of them, or as many as a DER header says; 0 if there is none."""
    if is_key(data):
        return len(data)
    if data[:1] != b"\x30" or len(data) < 16:
        return 0
    width = data[1] & 0x7F if data[1] & 0x80 else 0
    size = 2 + width + (int.from_bytes(data[2 : 2 + width], "big") if width else data[1])
    return size if width <= 4 and size < len(data) and is_key(data[:size]) else 0


def _inner_base64(run: str) -> list[tuple[int, int]]:
    """Keys that begin inside a base64 run, as places in it; they don't overlap."""
    found, after, text = [], 0, run.rstrip("=")
    for m in BASE64_START.finditer(text):
        at = m.start()
        if at < after or text[at] == "M" and not _fits(_unbase64(text[at : at + 16]), (len(text) - at) * 3 // 4):
            continue
        rest = text[at:]
        data = _unbase64(rest if len(rest) % 4 != 1 else rest[:-1])
        if size := key_size(data):
            after = len(run) if size == len(data) else at + (size * 4 + 2) // 3
            found.append((at, after))
    return found


def _fits(head: bytes, most: int) -> bool:
    """Whether a DER sequence of an integer or a sequence begins here and ends within `most` bytes."""
    if len(head) < 12 or head[0] != SEQUENCE:
        return False
    width = head[1] & 0x7F if head[1] & 0x80 else 0
    size = int.from_bytes(head[2 : 2 + width], "big") if width else head[1]
    return width <= 4 and 2 + width + size <= most and head[2 + width] in (INTEGER, SEQUENCE)


def _inner_hex(run: str) -> list[tuple[int, int]]:
    """Keys in a hex run, as places in it; they don't overlap."""
    found, after = [], 0
    for m in HEX_START.finditer(run):
        at = m.start()
        rest = run[at : len(run) - (len(run) - at) % 2]
        head = bytes.fromhex(rest[:24])
        if at < after or head[:1] == b"\x30" and not _fits(head, len(rest) // 2):
            continue
        data = bytes.fromhex(rest)
        if size := key_size(data):
            after = len(run) if size == len(data) else at + 2 * size
            found.append((at, after))
    return found


def _wrapped_keys(text: str, armoured: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Keys in base64 that goes over lines, outside PEM blocks."""
    found = []
    for m in WRAPPED.finditer(text):
        if any(a <= m.start() < b for a, b in armoured):
            continue
        places = [i for i in range(*m.span()) if not text[i].isspace()]
        for a, b in _inner_base64("".join(text[i] for i in places)):
            start, end = places[a], places[b - 1] + 1
            if "\n" in text[start:end]:  # the others are found in their line
                found.append((start, end))
    return found


def is_signed_token(text: str) -> bool:
    """Header with an algorithm, claims, and a signature that decodes; without an algorithm ("none") nothing is signed."""
    head, body, signature = text.split(".")
    try:
        header, claims = (json.loads(_unbase64(x)) for x in (head, body))
    except (ValueError, RecursionError):
        return False
    if not (isinstance(header, dict) and isinstance(claims, dict) and isinstance(header.get("alg"), str)):
        return False
    return header["alg"].lower() not in ("", "none") and bool(_unbase64(signature))


def is_armoured_key(body: str) -> bool:
    """Whether the lines of a PEM block are a key: its structure, or, as its headers say that it is encrypted, whole cipher blocks."""
    lines = [x.strip() for x in body.split("\n")]
    headers = dict(x.split(":", 1) for x in lines if ":" in x)
    data = _unbase64("".join("".join(x.split()) for x in lines if ":" not in x))
    if "ENCRYPTED" in headers.get("Proc-Type", ""):
        return bool(CIPHER.fullmatch(headers.get("DEK-Info", "").strip())) and len(data) >= 16 and len(data) % 8 == 0
    return is_key(data)


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by start, then kind as listed."""
    spans = []
    spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    for m in HEX_RUN.finditer(text):
        whole = m[0][: len(m[0]) & ~1]
        inner = [(0, len(m[0]))] if is_key(bytes.fromhex(whole)) else _inner_hex(m[0])
        spans += [("hexkey", m.start() + a, m.start() + b) for a, b in inner]
    armoured = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            armoured.append(m.span())
            if is_armoured_key(m[2]):
                spans.append(("pem", *m.span()))
    if "eyJ" in text:
        spans += [("jwt", *m.span()) for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    for m in BASE64.finditer(text):
        # 0x30 and 0x00 begin a key; so do OPENSSH's first bytes
        if (m[0][0] in "MA" or m[0].startswith("b3BlbnNza")) and is_key(_unbase64(m[0])):
            spans.append(("b64key", *m.span()))
        else:
            spans += [("b64key", m.start() + a, m.start() + b) for a, b in _inner_base64(m[0])]
    spans += [("b64key", a, b) for a, b in _wrapped_keys(text, armoured)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the array of spans (kind, start, end) for every row of docs."""
    def make():
        def step(batch: pa.RecordBatch) -> dict[str, object]:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]}

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_or_empty()), SCHEMA, make)


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    """base_sha256 of scan()'s spans, for tests."""
    text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in KINDS[:3])
    return hashlib.sha256(text.encode()).hexdigest()
