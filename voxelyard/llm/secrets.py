"""Secret scanning with structural confirmation.

Patterns find candidates; long base64 and hex runs are decoded and parsed, and are reported only if they hold a private key or a signed token:
DER structures whose nested lengths agree, OpenSSH containers whose length-prefixed fields fill them, tokens with an algorithm,
a payload and a signature. Public keys and certificates are no secrets.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelyard.llm._shared import released, small_batches, values_of

#: Fixed patterns of the base kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ["assign", "access", "hex", "token", "key"]
_HEX16 = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}(?:\r?\n[A-Za-z0-9+/_-]+)*={0,2}")
_HEXKEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")
_ARMOR = re.compile(r"-----BEGIN ([A-Z0-9 ]*KEY[A-Z ]*)-----\s*([A-Za-z0-9+/=\s]{40,}?)-----END \1-----")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base kinds: leftmost, non-overlapping by kind; matches that fail their length are dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # A match is a maximal run, so runs of 16 or more are found alike by the pattern that asks for them.
    out += [(m.start(), 2, m.end()) for m in _HEX16.finditer(text)]
    return out


def der_values(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """``(tag, start, end)`` of the contents of the DER values that fill ``data[at:end]``; None if a length is malformed or runs over."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, start = data[at], data[at + 1], at + 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or start + size > end:
                return None
            n, start = int.from_bytes(data[start : start + size], "big"), start + size
        if start + n > end:
            return None
        out.append((tag, start, start + n))
        at = start + n
    return out


def is_der_key(data: bytes) -> bool:
    """A private key: one SEQUENCE over the whole in which the lengths of all nested values agree, of one of these forms.

    Version and key numbers (three INTEGERs at least), version and secret OCTET STRING, version, algorithm and OCTET STRING, or algorithm and
    encrypted OCTET STRING. Public keys and certificates hold a BIT STRING instead, signatures and bare public numbers have no version.
    """
    top = der_values(data, 0, len(data)) if data[:1] == b"\x30" and len(data) >= 24 else None
    if not top or len(top) != 1:
        return False
    children: dict[int, list] = {}
    todo = list(top)
    while todo:
        tag, start, end = todo.pop()
        if tag & 0x20:
            inner = der_values(data, start, end)
            if inner is None:
                return False
            children[start] = inner
            todo += inner
    parts = children[top[0][1]]
    tags = [t for t, _, _ in parts]

    def algorithm(k: int) -> bool:
        return len(parts) > k and tags[k] == 0x30 and [t for t, _, _ in children[parts[k][1]]][:1] == [0x06]

    if tags[:1] == [0x02] and parts[0][2] - parts[0][1] == 1 and data[parts[0][1]] <= 3:
        return tags[1:4] == [0x02] * 3 or tags[1:2] == [0x04] and parts[1][2] - parts[1][1] >= 16 or algorithm(1) and tags[2:3] == [0x04]
    return tags == [0x30, 0x04] and algorithm(0)


CONTAINER = b"openssh-key-v1\0"


def container_size(data: bytes) -> int | None:
    """Bytes of an OpenSSH private key container by its own fields: cipher, key derivation, its options, the number of public keys, these, the private part."""
    at, left = len(CONTAINER), 3
    if not data.startswith(CONTAINER):
        return None
    for head in (True, False):
        while left:
            if at + 4 > len(data):
                return None
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            left -= 1
        if head:
            left = int.from_bytes(data[at : at + 4], "big") + 1
            at += 4
            if not 2 <= left <= 17:
                return None
    return at


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key container whose length-prefixed fields fill it; public key blobs are no secrets."""
    return container_size(data) == len(data)


def _decoded(run: str) -> bytes | None:
    clean = re.sub(r"\s", "", run).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(clean + "=" * (-len(clean) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_part(part: str) -> object:
    try:
        return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None


def is_token(token: str) -> bool:
    """A signed token: base64url JSON objects as header, with an ``alg`` other than none, and as payload, and a signature of 16 bytes or more."""
    head, payload, signature = token.split(".")
    told = _json_part(head)
    if not isinstance(told, dict) or not isinstance(told.get("alg"), str) or told["alg"].lower() == "none":
        return False
    return isinstance(_json_part(payload), dict) and len(_decoded(signature) or b"") >= 16


def _key_size(data: bytes) -> int | None:
    """Bytes that a key at the start of ``data`` takes by its own lengths."""
    if data[:1] == b"\x30" and len(data) > 6:
        size = data[1] & 0x7F if data[1] & 0x80 else 0
        return 2 + size + int.from_bytes(data[2 : 2 + size] if size else data[1:2], "big") if size <= 4 else None
    return container_size(data)


def _keys_in(run: str) -> list[tuple[int, int]]:
    """``(start, end)`` of the keys that fill some whole lines of a base64 run, which as a whole is none."""
    lines = [(m.start(), m.end()) for m in re.finditer(r"[^\r\n=]+", run)]
    out, n = [], 0
    while n < len(lines):
        start, stop = lines[n]
        n += 1
        if stop - start < 40 or _HEAD.match(run, start) is None:
            continue
        ends, held = {}, 0
        for i in range(n - 1, len(lines)):
            held += lines[i][1] - lines[i][0]
            ends[held] = i
        # Four characters hold three bytes; what remains of the last four cannot be told from the next line's.
        clean = re.sub(r"\s|=", "", run[start:])
        size = _key_size(_decoded(clean[: len(clean) // 4 * 4]) or b"")
        last = ends.get(-(-size * 4 // 3)) if size is not None else None
        data = _decoded(run[start : lines[last][1]]) if last is not None else None
        if data and (is_der_key(data) or is_ssh_key(data)):
            out.append((start, lines[last][1]))
            n = last + 1
    return out


#: Base64 of what a key begins with: a SEQUENCE or an OpenSSH container.
_HEAD = re.compile("M[A-P]|b3BlbnNza")


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of candidates that decode to a signed token or a key."""
    out = []
    if "ey" in text and "." in text:
        out += [(m.start(), 3, m.end()) for m in _TOKEN.finditer(text) if is_token(m[0])]
    if "-----BEGIN" in text:
        for m in _ARMOR.finditer(text):
            data = _decoded(m[2])
            if data and (is_der_key(data) or is_ssh_key(data)):
                out.append((m.start(), 4, m.end()))
    armored = [(a, b) for a, k, b in out if k == 4]
    if _LONG.search(text):
        for pattern, decode in ((_BASE64, _decoded), (_HEXKEY, lambda s: bytes.fromhex(s) if len(s) % 2 == 0 else None)):
            for m in pattern.finditer(text):
                if any(a <= m.start() < b for a, b in armored):
                    continue
                data = decode(m[0])
                if data and (is_der_key(data) or is_ssh_key(data)):
                    out.append((m.start(), 4, m.end()))
                elif pattern is _BASE64 and "\n" in m[0]:
                    # The run may have taken in lines that follow or precede a key.
                    out += [(m.start() + a, 4, m.start() + b) for a, b in _keys_in(m[0])]
    return out


_LONG = re.compile(r"[A-Za-z0-9+/_-]{40}")


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(set(spans)))


def scan(text: str | None) -> tuple:
    """``(n_assign, n_access, n_hex, base spans, all spans)`` of one whole text."""
    base = base_spans(text or "")
    kinds = [k for _, k, _ in base]
    return kinds.count(0), kinds.count(1), kinds.count(2), spell(base), spell(base + confirmed_spans(text or ""))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_spans, spans)`` per row; spans are ``kind:start:end`` in code points.

    Sorted by start, then kind as in ``KINDS``. Null or empty texts have none; whole texts are scanned; repeated rows are scanned alike; other columns
    are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t) for t in values_of(batch.column("text"))]
            a, c, h, base, every = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (a, c, h)), pa.array(base, pa.string()), pa.array(every, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"],
            )

    return picked.mapInArrow(released(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string")
