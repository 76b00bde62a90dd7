"""Secret scans (operator 9): pattern candidates, and structural confirmation of what they decode to.

Base kinds are patterns with a length test. Beyond them, base64 (wrapped or not, after any other character) and hex candidates are
decoded at every alignment and reported only where the bytes parse: nested lengths of a DER private key that account for every byte, the length-prefixed fields of an OpenSSH private
key, or the JSON header of a signed token with an algorithm and a payload that is JSON too.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import itertools
import json
import re

from pyspark.sql import DataFrame

from .common import bounded_batches
from .spans import Span, span_rows, span_schema

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "pem", "token", "key"]

# The patterns of the base kinds, and the least characters of what they take.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

_PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]+)-----END \1-----", re.A)
_TOKEN_RUN = re.compile(r"[A-Za-z0-9_.-]+")
#: How an encoded JSON object begins: a brace, and a quote or a blank after it.
_TOKEN_START = re.compile(r"ey[JA]|ew[0ok]")
#: Lines of base64, one after another; a key that is wrapped has one of at least 20 characters first.
_BASE64_LINES = re.compile(r"[A-Za-z0-9+/]{20,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/]+)*")
_BASE64_LINE = re.compile(r"[A-Za-z0-9+/]+")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]{64,}")
#: Where key bytes may start: a sequence whose first value is the version 0 or 1, or the name of the OpenSSH format.
_KEY_START = re.compile(rb"\x30(?=(?:[\x00-\x7f]|\x81.|\x82..|\x83...|\x84....)\x02\x01[\x00\x01])|(?=openssh-key-v1\x00)", re.S)
_MAGIC = b"openssh-key-v1\x00"
#: No private key's sequence has more values than this (ten in RSA with more than two primes).
_VALUES = 10


def decoded(s: str) -> bytes | None:
    """The bytes of a base64 string in either alphabet, padded or not."""
    s = re.sub(r"\s", "", s).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, at: int = 0, end: int | None = None, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values in data[at:end], or None if their lengths don't account for every byte or if they are
    more than `most`."""
    end, out = len(data) if end is None else end, []
    while at < end:
        value = der_value(data, at, end)
        if value is None or (most is not None and len(out) == most):
            return None
        out.append(value)
        at = value[2]
    return out


def der_value(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER value that starts at `at` and lies within data[at:end]."""
    if at + 2 > end:
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        at += n
    return (tag, at, at + size) if at + size <= end else None


def private_der_end(data: bytes, at: int = 0) -> int | None:
    """Where the private key ends whose sequence starts at `at`: PKCS#1 or DSA (a version and integers), PKCS#8 (version,
    algorithm, octets), or SEC1 (version 1, octets); None if there is none."""
    outer = der_value(data, at, len(data)) if data[at : at + 1] == b"\x30" else None
    inner = der(data, outer[1], outer[2], _VALUES) if outer else None
    if not inner or len(inner) < 2 or inner[0][0] != 2 or inner[0][2] - inner[0][1] != 1:
        return None
    tags, version = [t for t, _, _ in inner], data[inner[0][1]]
    if tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 4:
        algorithm = der_value(data, inner[1][1], inner[1][2])
        good = version in (0, 1) and algorithm is not None and algorithm[0] == 6
    elif tags[1] == 4:
        good = version == 1 and inner[1][2] - inner[1][1] >= 16
    else:
        good = version in (0, 1) and len(tags) >= 6 and all(t == 2 for t in tags[:6])
    return outer[2] if good else None


def openssh_end(data: bytes, at: int = 0) -> int | None:
    """Where the OpenSSH key ends that starts at `at`: the magic, then cipher, KDF and its options, a count, as many public keys
    and the private ones, each with its length before it; None if there is none."""
    if not data.startswith(_MAGIC, at):
        return None
    at += len(_MAGIC)

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not (field() and field() and field()) or at + 4 > len(data):
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return at if 0 < keys < 16 and all(field() for _ in range(keys + 1)) else None


def is_private_der(data: bytes) -> bool:
    return private_der_end(data) == len(data)


def is_openssh(data: bytes) -> bool:
    return openssh_end(data) == len(data)


def keys_in(data: bytes, step: int) -> list[tuple[int, int]]:
    """Spans of keys in bytes, leftmost and not overlapping, that start at a multiple of `step`."""
    out, free = [], 0
    for m in _KEY_START.finditer(data):
        at = m.start()
        if at >= free and at % step == 0 and (end := private_der_end(data, at) or openssh_end(data, at)):
            out.append((at, end))
            free = end
    return out


def encoded_keys(t: str) -> list[tuple[int, int]]:
    """Spans of base64 and hex in t that decode to a private key, at every alignment; base64 may be wrapped over lines. Each run
    is decoded once for each alignment and keys are parsed in place, so the work is in proportion to the text."""
    found = []
    for m in _BASE64_LINES.finditer(t):
        lines = [(x.start(), x.end()) for x in _BASE64_LINE.finditer(t, m.start(), m.end())]
        s = "".join(t[a:b] for a, b in lines)
        if len(s) < 44:
            continue
        before = [0, *itertools.accumulate(b - a for a, b in lines)]
        for a in range(4):
            n = len(s) - a
            data = base64.b64decode(s[a:] + "A" * (-n % 4))[: n * 3 // 4]
            for i, j in keys_in(data, 3):
                first, last = a + i // 3 * 4, a + (4 * j + 2) // 3 - 1
                x, y = (bisect.bisect_right(before, k, 0, len(lines)) - 1 for k in (first, last))
                end = lines[y][0] + last - before[y] + 1
                pad = -(j - i) % 3
                found.append((lines[x][0] + first - before[x], end + pad * (t[end : end + pad] == "=" * pad)))
    for m in _HEX_RUN.finditer(t):
        for a in range(2):
            n = (len(m[0]) - a) // 2 * 2
            found += [(m.start() + a + 2 * i, m.start() + a + 2 * j) for i, j in keys_in(bytes.fromhex(m[0][a : a + n]), 1)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda k: (k[0], -k[1])):  # a key within a key is one
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _object(raw: bytes | None) -> bool:
    """Whether the bytes are a JSON object."""
    try:
        return isinstance(json.loads(raw or b""), dict)
    except (ValueError, RecursionError):
        return False


def header_start(part: str) -> int | None:
    """Where in a run of base64url the header of a signed token starts that ends with the run: a JSON object that names an
    algorithm. Each alignment is decoded once; an object that ends earlier is passed over as a whole."""
    found, scan = [], json.JSONDecoder().raw_decode
    starts: list[list[int]] = [[] for _ in range(4)]
    for m in _TOKEN_START.finditer(part):
        starts[m.start() % 4].append(m.start())
    for a, mine in enumerate(starts):
        data = decoded(part[a:]) if mine else None
        text, free = (data or b"").decode("latin-1"), 0
        for at in mine if data else []:
            k = (at - a) // 4 * 3
            if k < free:
                continue
            try:
                head, free = scan(text, k)
            except (ValueError, RecursionError):
                continue
            if not text[free:].strip(" \t\r\n") and isinstance(head, dict) and isinstance(head.get("alg"), str) and _object(data[k:]):
                found.append(at)
    return min(found, default=None)


def signed_tokens(t: str) -> list[tuple[int, int]]:
    """Spans of header.payload.signature, leftmost and not overlapping; the signature may be empty."""
    out = []
    for m in _TOKEN_RUN.finditer(t):
        if m[0].count(".") < 2 or not _TOKEN_START.search(m[0]):
            continue
        parts = m[0].split(".")
        at = [m.start(), *(m.start() + x for x in itertools.accumulate(len(p) + 1 for p in parts))]
        i = 0
        while i + 2 < len(parts):
            start = header_start(parts[i]) if _object(decoded(parts[i + 1])) else None
            if start is not None:
                out.append((at[i] + start, at[i + 2] + len(parts[i + 2])))
            i += 1 if start is None else 3
    return out


def find_secrets(t: str) -> tuple[list[Span], list[Span]]:
    """(base spans, confirmed spans) of a text."""
    base: list[Span] = []
    if "=" in t or ":" in t:
        base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in t:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(t) if len(m[0]) >= LEAST_ACCESS]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(t)]
    added: list[Span] = []
    if "-----BEGIN " in t:
        for m in _PEM.finditer(t):
            data = decoded(m[2].replace("\\r", "").replace("\\n", "")) or b""
            if is_private_der(data) or is_openssh(data) or ("ENCRYPTED" in m[1] and der(data, most=_VALUES)):
                added.append((m.start(), m.end(), "pem"))
    if _TOKEN_START.search(t):
        added += [(a, b, "token") for a, b in signed_tokens(t)]
    starts = sorted((a, b) for a, b, _ in added)
    for a, b in encoded_keys(t):
        i = bisect.bisect_right(starts, (a, len(t) + 1)) - 1
        if i < 0 or starts[i][1] <= a:
            added.append((a, b, "key"))
    return base, added


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs (doc_id, text), over whole texts.

    Spans are [start, end) in code points; those of the base kinds are whole matches, leftmost and not overlapping within a kind
    (a failing match is dropped and not tried again). A null or empty text has none; rows are independent of each other.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(span_rows(find_secrets, BASE, KINDS), span_schema(dict(rows.dtypes)["doc_id"], BASE))
