"""Secret scans: pattern candidates, then structural confirmation of encoded keys and tokens."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workers import trim

# The base patterns and least lengths, in the order of their kinds.
_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "der", "jwt", "pem", "ssh")

# a whole run of token characters, and behind it two more with dots before them: each run is read three times at most
_SEGMENT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)(?=(\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+))")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}KEY)-----([A-Za-z0-9+/=\s]*)-----END \1-----")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{44,}={0,2}")
_OPENSSH = b"openssh-key-v1\0"
_LONG_HEX = re.compile(r"[0-9A-Fa-f]{64,}")


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """Length and start of the content of a DER element whose length octets start at ``at``."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    return int.from_bytes(data[at + 1 : at + 1 + n]), at + 1 + n


def der_children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill data[at:end] exactly, else None."""
    out = []
    while at < end:
        tag = data[at]
        found = der_length(data, at + 1)
        if found is None or found[0] + found[1] > end:
            return None
        out.append((tag, found[1], found[0] + found[1]))
        at = found[0] + found[1]
    return out


def is_nested(data: bytes, at: int, end: int) -> bool:
    """Whether DER elements fill data[at:end] exactly, and constructed ones are so filled at every depth."""
    open_ranges = [(at, end)]
    while open_ranges:
        children = der_children(data, *open_ranges.pop())
        if children is None:
            return False
        open_ranges += [(a, b) for tag, a, b in children if tag & 0x20]
    return True


def is_key_structure(data: bytes) -> bool:
    """A DER SEQUENCE that fills the data, whose nested lengths agree at every depth, laid out as a key.

    Accepted: an integer version first (private keys; one behind an algorithm identifier must be DER itself),
    an algorithm identifier first (public and encrypted keys), or two or more integers only.
    """
    top = der_children(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30 or not is_nested(data, 0, len(data)):
        return False
    inner = der_children(data, top[0][1], top[0][2])
    if len(inner) < 2:
        return False
    tags = [t for t, _, _ in inner]

    def algorithm(i: int) -> bool:
        parts = der_children(data, inner[i][1], inner[i][2])
        return bool(parts) and parts[0][0] == 0x06

    if tags[0] == 0x02:
        if all(t == 0x02 for t in tags):
            return True
        if inner[0][2] - inner[0][1] != 1:
            return False
        if tags[1] == 0x30:
            return len(tags) > 2 and tags[2] == 0x04 and algorithm(1) and inner[2][2] > inner[2][1] and is_nested(data, *inner[2][1:])
        return tags[1] in (0x02, 0x04)
    if tags[0] == 0x30 and algorithm(0):
        return tags[1] == 0x04 or tags[1] == 0x03 and inner[1][2] > inner[1][1] and data[inner[1][1]] < 8
    return False


def ssh_field(data: bytes, at: int) -> tuple[bytes, int] | None:
    """A field with its length before it, and the place behind it."""
    if at + 4 > len(data):
        return None
    end = at + 4 + int.from_bytes(data[at : at + 4])
    return (data[at + 4 : end], end) if end <= len(data) else None


def is_ssh_public(data: bytes) -> bool:
    """Length-prefixed fields that fill the data, the first of which names a key type."""
    at, fields = 0, []
    while at < len(data):
        found = ssh_field(data, at)
        if found is None:
            return False
        fields.append(found[0])
        at = found[1]
    return len(fields) >= 2 and fields[0].startswith((b"ssh-", b"ecdsa-sha2-", b"sk-"))


def is_openssh_private(data: bytes) -> bool:
    """Cipher, key derivation and its options, the public keys, and the private section, by their lengths.

    A section that is not encrypted starts with a check number twice; behind an encrypted one an
    authentication tag of up to 16 bytes may follow.
    """
    at, head = len(_OPENSSH), []
    for _ in range(3):
        found = ssh_field(data, at)
        if found is None:
            return False
        head.append(found[0])
        at = found[1]
    cipher, kdf, options = head
    if not cipher or not kdf or not (cipher + kdf).isascii() or (cipher == b"none") != (kdf == b"none") or kdf == b"none" and options:
        return False
    keys = int.from_bytes(data[at : at + 4])
    at += 4
    if not keys:
        return False
    for _ in range(keys):
        found = ssh_field(data, at)
        if found is None or not is_ssh_public(found[0]):
            return False
        at = found[1]
    found = ssh_field(data, at)
    if found is None or not found[0] or len(found[0]) % 8:
        return False
    section, rest = found[0], len(data) - found[1]
    return rest == 0 and section[:4] == section[4:8] if cipher == b"none" else rest <= 16


def is_ssh_structure(data: bytes) -> bool:
    """An SSH public key blob, or an OpenSSH private key."""
    return is_openssh_private(data) if data.startswith(_OPENSSH) else is_ssh_public(data)


def unbase64(text: str) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """Header and payload decode to JSON objects and the header names an algorithm."""
    parts = text.split(".")
    for i, part in enumerate(parts[:2]):
        data = unbase64(part.replace("-", "+").replace("_", "/"))
        try:
            value = json.loads(data) if data else None
        except (ValueError, UnicodeDecodeError, RecursionError):
            return False
        if not isinstance(value, dict) or i == 0 and not isinstance(value.get("alg"), str):
            return False
    return True


def _key_bytes(data: bytes | None) -> str | None:
    if not data:
        return None
    if data[0] == 0x30 and is_key_structure(data):
        return "der"
    if data[:3] == b"\0\0\0" or data.startswith(_OPENSSH):
        return "ssh" if is_ssh_structure(data) else None
    return None


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of signed tokens; a token starts at the first ``eyJ`` of a run of its characters."""
    last = 0
    for m in _SEGMENT.finditer(text):
        at, end = text.find("eyJ", m.start(1), m.end(1)), m.end(2)
        if at >= last and is_signed_token(text[at:end]):
            yield at, end
            last = end


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three base kinds: leftmost, non-overlapping per kind, long enough."""
    out = []
    if "=" in text or ":" in text:
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out + [(*m.span(), "hex") for m in _HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans that decode to a key encoding or a signed token."""
    out = []
    if "eyJ" in text:
        out += [(a, b, "jwt") for a, b in signed_tokens(text)]
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            if _key_bytes(unbase64(re.sub(r"\s+", "", m[2]))):
                out.append((*m.span(), "pem"))
    for m in _BASE64.finditer(text):
        kind = _key_bytes(unbase64(m[0]))
        if kind:
            out.append((*m.span(), kind))
    for m in _LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0:
            kind = _key_bytes(bytes.fromhex(m[0]))
            if kind:
                out.append((*m.span(), kind))
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        for value in batch.column(1):
            text = value.as_py() or ""
            base = base_spans(text)
            kinds = [k for _, _, k in base]
            row = (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + confirmed_spans(text)))
            for column, v in zip(columns, row, strict=True):
                column.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[batch.schema.names[0], "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text.

    Base kinds: ``assign`` (a named secret is given a value of 6 or more characters), ``access``
    (an access key of 20 or more), ``hex`` (24 or more lower-case hex digits).  Confirmed kinds
    are reported only after decoding: ``der`` and ``ssh`` (base64 or hex that parses as a key
    encoding, nested lengths included), ``pem`` (an armoured key whose body parses so), ``jwt`` (a
    signed token whose header and payload are JSON objects and whose header names an algorithm).

    Returns the id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans``
    (kind:start:end in code points, end exclusive, by start and then kind).  A null or empty text
    has no spans.  Rows are independent: repeated rows and null ids stay, an empty table gives
    an empty result, other columns are ignored.
    """
    kind = dict(rows.dtypes)[id_col]
    return rows.select(F.col(id_col), F.col(text_col)).mapInArrow(_scan, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask_secrets(text: str) -> str:
    """The text with the value of every found span replaced by the kind's name in brackets."""
    out, at = [], 0
    for a, b, kind in sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[0], -s[1])):
        if a < at:
            if b > at:
                at = b
            continue
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masked = pa.array([None if v is None else mask_secrets(v) for v in batch.column(0).to_pylist()], pa.string())
        yield pa.record_batch([*batch.columns[1:], masked], names=[*batch.schema.names[1:], "__masked"])
        del masked, batch
        trim()


def redact(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with every secret in the text replaced by its kind in brackets; null stays null."""
    others = [c for c in rows.columns if c != text_col]
    slim = rows.select(F.col(text_col).alias("__text"), *(F.col(f"`{c}`") for c in others))
    schema = T.StructType([*(rows.schema[c] for c in others), T.StructField("__masked", T.StringType())])
    return slim.mapInArrow(_mask, schema).select(*(F.col("__masked").alias(c) if c == text_col else F.col(f"`{c}`") for c in rows.columns))
