"""Secret scans with structural confirmation.

Three base patterns are reported as they match. Beside them, candidates are decoded and
reported only if their structure is that of a secret: a private key in DER (PKCS#1,
PKCS#8 or SEC 1) or OpenSSH encoding, in base64, hexadecimal or an armoured block, with
every nested length consistent; and a signed token whose first two parts are JSON objects
and whose header names an algorithm.

A linear-time automaton first finds the texts that can hold a match at all; only these
are searched in Python, in one narrow pass over the table. No pattern backtracks over a
run of characters from more than one start.

Defined results: a null text counts as empty and has no spans. Ids may be null or
repeated, rows are scanned one by one. An empty table gives an empty result. Other
columns are not looked at.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanweave.llm.rows import small_batches

#: in the order in which equal starts are listed
KINDS = ("assign", "access", "hex", "private_key", "signed_token")
BASE_KINDS = KINDS[:3]

# fixed values: the base patterns
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
#: line ends and slashes may be escaped, as in JSON and environment files
ARMOUR = re.compile(
    r"-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----((?:[A-Za-z0-9+/=\s]++|\\++[nrt/])++)-----END "
)
ESCAPED_SPACE = re.compile(r"\\+[nrt]|\s+")
TOKEN = re.compile(
    r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.(?:[A-Za-z0-9_-]+)?"
)
#: superset of the texts in which any of the above can match
POSSIBLE = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
    r"|[A-Za-z0-9+/_-]{40}|PRIVATE KEY-----|[A-Za-z0-9_-]{8}\.[A-Za-z0-9_-]{2,}\."
)
SPAN_TYPE = "array<struct<kind: string, start: int, end: int, detail: string>>"

# fixed values: DER tags
INTEGER, BIT_STRING, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


# --- encodings -------------------------------------------------------------------------------


def decode_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64; None if it is not whole base64."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _item(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value of the DER item at ``at``."""
    if at + 2 > len(data):
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at: at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= len(data) else None


def der_items(data: bytes, begin: int, end: int) -> list[tuple[int, int, int]] | None:
    """The items that fill ``data[begin:end]`` exactly, nested lengths checked; else None.

    The ends of the open items are a stack, so nesting may be as deep as the data.
    """
    items, at, open_ends = [], begin, [end]
    while True:
        while at == open_ends[-1]:
            open_ends.pop()
            if not open_ends:
                return items
        item = _item(data, at)
        if item is None or item[2] > open_ends[-1]:
            return None
        if len(open_ends) == 1:
            items.append(item)
        if item[0] & 0x20:
            at = item[1]
            open_ends.append(item[2])
        else:
            at = item[2]


def _der_key(data: bytes) -> str | None:
    outer = _item(data, 0)
    if outer is None or outer[0] != SEQUENCE or outer[2] != len(data):
        return None
    items = der_items(data, outer[1], outer[2])
    if not items or len(items) < 2:
        return None
    tags = [i[0] for i in items]
    if len(tags) >= 9 and set(tags[:9]) == {INTEGER}:
        return "pkcs1"
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:
        inner = der_items(data, items[1][1], items[1][2])
        held = der_items(data, items[2][1], items[2][2])
        return "pkcs8" if inner and inner[0][0] == OID and held and len(held) == 1 else None
    version = data[items[0][1]: items[0][2]]
    if tags[:2] == [INTEGER, OCTETS] and version == b"\x01" and items[1][2] - items[1][1] >= 16:
        return "sec1"
    return None


def _openssh_key(data: bytes) -> str | None:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at, fields = len(magic), 0
    while at < len(data):
        if fields == 3:  # the number of keys
            if at + 4 > len(data) or not 1 <= int.from_bytes(data[at: at + 4], "big") <= 64:
                return None
            at, fields = at + 4, fields + 1
            continue
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at: at + 4], "big")
        fields += 1
    return "openssh" if at == len(data) and fields >= 6 else None


def key_kind(data: bytes | None) -> str | None:
    """The encoding of a private key, if ``data`` is one from its first to its last byte."""
    return (_der_key(data) or _openssh_key(data)) if data else None


def _json_object(part: str) -> dict | None:
    data = decode_base64(part)
    try:
        value = json.loads(data.decode()) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def token_algorithm(text: str) -> str | None:
    """The algorithm of a signed token; None if the text is none."""
    head, body, signature = text.split(".")
    header = _json_object(head)
    name = header.get("alg") if header else None
    if not isinstance(name, str) or not name or _json_object(body) is None:
        return None
    unsigned = name.lower() == "none"
    return name if unsigned != bool(signature) and (unsigned or decode_base64(signature)) else None


# --- spans -----------------------------------------------------------------------------------


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    found = [("assign", *m.span(), m[1].lower()) for m in ASSIGN.finditer(text)
             if len(m[2]) >= LEAST_ASSIGN]
    found += [("access", *m.span(), "") for m in ACCESS.finditer(text)
              if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span(), "") for m in HEX.finditer(text)
              if m.end() - m.start() >= LEAST_HEX]
    return found


def _encoded_key(part: str) -> str | None:
    kind = key_kind(decode_base64(part))
    if kind is None and len(part) % 2 == 0 and re.fullmatch(r"[0-9A-Fa-f]+", part):
        kind = key_kind(bytes.fromhex(part))
    return kind


def confirmed_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Candidates whose decoded structure is that of a key or signed token."""
    found, covered = [], []
    for m in ARMOUR.finditer(text):
        kind = key_kind(decode_base64(ESCAPED_SPACE.sub("", m[1]).replace("\\", "")))
        if kind:
            found.append(("private_key", *m.span(1), f"armoured {kind}"))
            covered.append(m.span(1))
    block = 0
    for m in ENCODED.finditer(text):
        # blocks and candidates both come in order
        while block < len(covered) and covered[block][1] <= m.start():
            block += 1
        if block < len(covered) and covered[block][0] <= m.start():
            continue
        begin, end = m.span()
        kind = _encoded_key(m[0])
        if kind is None and m[0][0] in "nrt" and text[begin - 1: begin] == "\\":
            begin += 1  # the letter ends an escaped line end
            kind = _encoded_key(text[begin: end])
        if kind:
            found.append(("private_key", begin, end, kind))
    for m in TOKEN.finditer(text):
        name = token_algorithm(m[0])
        if name:
            found.append(("signed_token", *m.span(), name))
    return found


def all_spans(text: str) -> list[tuple[str, int, int, str]]:
    """All spans by start, then kind; code points, end exclusive."""
    spans = base_spans(text) + confirmed_spans(text)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
              ("detail", pa.string())]
    kind = pa.list_(pa.struct(fields))
    for batch in batches:
        texts = batch.column("text").fill_null("")
        possible = pc.match_substring_regex(texts, POSSIBLE)
        rows = np.flatnonzero(np.asarray(possible))
        spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for i in rows.tolist():
            found = all_spans(texts[i].as_py())
            spans[i] = [dict(zip(("kind", "start", "end", "detail"), s)) for s in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(spans, kind)], ["id", "spans"]
        )


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the list of spans (kind, start, end, detail) of every document."""
    named = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    return small_batches(named).mapInArrow(_scan, f"id {kind}, spans {SPAN_TYPE}").withColumnRenamed(
        "id", "doc_id"
    )
