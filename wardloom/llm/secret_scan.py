"""Secrets in whole texts: patterns, and candidates that are reported only once their structure is confirmed.

Three kinds come from patterns alone: ``assign`` (a name such as ``password`` with a value), ``access`` (access key
ids) and ``hex`` (long lower-case hexadecimal runs). Three more are confirmed by decoding:

- ``signed``: a compact signed token. Its header must decode from base64 to a JSON object that names a signature
  algorithm, the payload must decode, and the signature must have the length the algorithm gives.
- ``pem``: an armoured private key whose body decodes to a private key encoding.
- ``key``: a bare base64 or hexadecimal run that decodes to a private key encoding, or to a text that holds an armoured
  key or a signed token.

A private key encoding is DER whose nested lengths use up the bytes exactly and whose elements are those of a PKCS 1,
PKCS 8 (plain or encrypted), SEC 1 or DSA key, or an OpenSSH key whose length-prefixed fields do.

The work is one pass over the texts without a shuffle: a pattern over whole columns leaves the few texts that can
hold anything, and only these are looked at one by one.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.text import pieces
from wardloom.llm.work import take

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "signed", "pem", "key")
SPANS = "array<struct<kind:string,start:long,end:long>>"

# fixed values: the three patterns and their least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so the least length can stand in the pattern
LEAST_VALUE, LEAST_ACCESS = 6, 20

SIGNED = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{20,}")
ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\[nr])+)-----END \1-----")
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{40,}|[A-Za-z0-9_-]{40,})={0,2}(?![A-Za-z0-9+/_=-])")
HEXADECIMAL = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{48,}|[0-9A-F]{48,})(?![0-9A-Za-z])")
POSSIBLE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9+/_-]{40}|e[wy][A-Za-z0-9_-]{8,}\.|PRIVATE KEY-----"""

# fixed values: bytes of a signature by algorithm; None: a modulus of 1024 bits or more in whole bytes
SIGNATURES = {
    "HS256": {32}, "HS384": {48}, "HS512": {64}, "ES256": {64}, "ES256K": {64}, "ES384": {96}, "ES512": {132}, "EdDSA": {64, 114},
    "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None,
}
DEPTH = 2  # how often a decoded text is searched again


# --- encodings ---------------------------------------------------------------------------------------------


def decoded(text: str) -> bytes | None:
    """The bytes of base64 in either alphabet, padded or not; None unless it is exactly that."""
    bare = text.rstrip("=")
    if len(bare) % 4 == 1 or (len(bare) != len(text) and len(text) % 4):
        return None
    if "-" in bare or "_" in bare:
        bare = bare.replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """The DER elements ``(tag, content)`` that lie one after another in ``data`` and use it up exactly, or None."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length >= 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or at + width > len(data) or data[at] == 0:
                return None
            length = int.from_bytes(data[at : at + width], "big")
            at += width
            if length < 0x80:
                return None
        if at + length > len(data):
            return None
        found.append((tag, data[at : at + length]))
        at += length
    return found


INTEGER, BITS, OCTETS, OID, SEQUENCE, ATTRIBUTES, PUBLIC = 0x02, 0x03, 0x04, 0x06, 0x30, 0xA0, 0xA1


def _algorithm(content: bytes) -> bool:
    inner = elements(content)
    return bool(inner) and inner[0][0] == OID and len(inner[0][1]) > 0


def _der_key(data: bytes) -> bool:
    if data[:1] != b"\x30":
        return False
    outer = elements(data)
    if outer is None or len(outer) != 1:
        return False
    inner = elements(outer[0][1])
    if not inner:
        return False
    tags = [tag for tag, _ in inner]
    first = inner[0][1]
    if any(tag == INTEGER and not content for tag, content in inner):
        return False
    if tags == [SEQUENCE, OCTETS]:  # encrypted PKCS 8
        return _algorithm(first) and len(inner[1][1]) >= 16
    if tags[0] != INTEGER or first not in (b"\x00", b"\x01"):
        return False
    if len(tags) in (6, 9) and set(tags) == {INTEGER}:  # DSA, PKCS 1
        return first == b"\x00"
    if tags[1:3] == [SEQUENCE, OCTETS] and set(tags[3:]) <= {ATTRIBUTES, 0x81, PUBLIC}:  # PKCS 8
        return _algorithm(inner[1][1]) and bool(inner[2][1])
    if tags[1:2] == [OCTETS] and set(tags[2:]) <= {ATTRIBUTES, PUBLIC} and first == b"\x01":  # SEC 1
        return len(inner[1][1]) >= 16 and all(elements(content) for _, content in inner[2:])
    return False


def _fields(data: bytes, at: int, count: int) -> tuple[list[bytes], int] | None:
    """``count`` fields with a length of four bytes before each, from ``at`` on, and where they end."""
    out = []
    for _ in range(count):
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or end > len(data):
            return None
        out.append(data[at + 4 : end])
        at = end
    return out, at


def _openssh_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic) or (head := _fields(data, len(magic), 3)) is None:
        return False
    keys = int.from_bytes(data[head[1] : head[1] + 4], "big")
    if not 1 <= keys <= 64 or (rest := _fields(data, head[1] + 4, keys + 1)) is None:
        return False
    return rest[1] == len(data) and len(rest[0][-1]) >= 16


def private_key(data: bytes) -> bool:
    """Whether the bytes are one of the known private key encodings, to the last byte."""
    return _der_key(data) or _openssh_key(data)


def signed_token(text: str) -> bool:
    """Whether ``header.payload.signature`` is a signed token by its header and lengths."""
    header, payload, signature = text.split(".")
    raw, body, seal = decoded(header), decoded(payload), decoded(signature)
    if raw is None or body is None or seal is None:
        return False
    try:
        said = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    if not isinstance(said, dict) or not isinstance(said.get("alg"), str) or said["alg"] not in SIGNATURES:
        return False
    lengths = SIGNATURES[said["alg"]]
    return len(seal) in lengths if lengths else len(seal) >= 128


# --- spans -------------------------------------------------------------------------------------------------


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points of the three patterns, leftmost and not overlapping within a kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def _holds(data: bytes, depth: int) -> bool:
    """Whether decoded bytes are a key, or a text in which one or a signed token is found."""
    if private_key(data):
        return True
    if not depth or b"-----BEGIN " not in data and b"." not in data:
        return False
    try:
        return bool(confirmed_spans(data.decode("ascii"), depth - 1))
    except UnicodeDecodeError:
        return False


def confirmed_spans(text: str, depth: int = DEPTH) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of what decodes to a key or a signed token."""
    out = [("signed", *m.span()) for m in SIGNED.finditer(text) if signed_token(m[0])]
    for m in ARMOUR.finditer(text):
        data = decoded(re.sub(r"\\[nr]|\s", "", m[2]))
        if data is not None and private_key(data):
            out.append(("pem", *m.span()))
    taken = list(out)
    for pattern, read in ((ENCODED, decoded), (HEXADECIMAL, _from_hex)):
        for m in pattern.finditer(text):
            data = read(m[0])
            if data is not None and _holds(data, depth) and not any(s < m.end() and m.start() < e for _, s, e in taken):
                out.append(("key", *m.span()))
    return out


def _from_hex(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 else None


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind in the order of ``KINDS``, then end."""
    if not text:
        return []
    found = set(base_spans(text) + confirmed_spans(text))
    return sorted(found, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


# --- tables ------------------------------------------------------------------------------------------------


def _looked_at(batch: pa.RecordBatch) -> list[list]:
    """Spans of each row; only rows that the pattern over the whole column lets through are searched one by one."""
    texts = batch.column("text")
    possible = pc.fill_null(pc.match_substring_regex(texts, POSSIBLE), False).to_numpy(zero_copy_only=False)
    found: list[list] = [[] for _ in range(len(texts))]
    for i in possible.nonzero()[0].tolist():
        found[i] = spans(texts[i].as_py())
    return found


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are ignored): ``doc_id, spans``.

    ``spans`` is an array of ``(kind, start, end)``, in code points with an exclusive end, by start, then kind, then end.
    Null and empty texts have none. Texts of any length are searched whole. Repeated rows and rows without doc_id
    come back as often as they are there. An empty table gives an empty result.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for piece in pieces(batch):
                rows = [[dict(zip(("kind", "start", "end"), span)) for span in found] for found in _looked_at(piece)]
                yield pa.record_batch([piece.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return take(docs, doc_id="long", text="string").mapInArrow(run, f"doc_id long, spans {SPANS}")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; spans that overlap become one.

    The columns and other values stay as they are; a null text stays null.
    """
    names = docs.columns
    at = [name.lower() for name in names].index("text")

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.rename_columns(["text" if i == at else f"c{i}" for i in range(len(names))])):
                texts = piece.column("text").to_pylist()
                for i, found in enumerate(_looked_at(piece)):
                    if found:
                        texts[i] = _without(texts[i], found)
                columns = [pa.array(texts, pa.string()) if i == at else piece.column(i) for i in range(len(names))]
                yield pa.record_batch(columns, names)

    return docs.mapInArrow(run, docs.schema)


def _without(text: str, found: list[tuple[str, int, int]]) -> str:
    out, done = [], 0
    for kind, start, end in found:
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the two forms of a row's spans as text, from ``doc_id, spans``."""

    def joined(column):
        parts = F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(kind) for kind in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
