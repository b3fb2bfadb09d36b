"""Secret scans with structural confirmation.

Base patterns report by shape alone.  The confirming pass decodes base64 or hex candidates
and reports only what parses: key encodings whose nested DER lengths fill the whole value,
PEM blocks around such values, around encrypted ones or around OpenSSH keys, and signed tokens whose header is a JSON object naming an
algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import mapped

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is matched whole; shorter runs would be dropped
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: Rows of a batch that are Python objects at once.
ROWS = 256
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "pem", "token", "der64", "derhex")

PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----\s*")
PEM_FIELD = re.compile(r"[A-Za-z0-9-]+:")
BLANKS = re.compile(r"\s*")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s]*")
OPENSSH = b"openssh-key-v1\0"
#: Identifiers of password-based encryption, which begin the algorithm of an encrypted key.
PBE_PREFIXES = tuple(bytes.fromhex(x) for x in ("2a864886f70d0105", "2a864886f70d010c01"))
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+|[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
DER64 = re.compile(r"(?<![A-Za-z0-9+/_-])M[A-Za-z0-9+/_-]{39,}={0,2}")
DERHEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{60,}(?![0-9A-Fa-f])")
#: Identifiers that stand in private and public key encodings: RSA, EC, Ed25519, X25519, DSA.
KEY_OIDS = tuple(bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2b6570", "2b656e", "2a8648ce380401"))


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, object]] | None:
    """The (tag, value) items that fill ``data`` exactly, constructed ones opened; None if a length doesn't fit."""
    items: list[tuple[int, object]] = []
    at = 0
    while at < len(data):
        if at + 2 > len(data) or depth > 8:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 0x80:
                return None
            at += n
        if at + size > len(data):
            return None
        value: object = data[at : at + size]
        if tag & 0x20:
            value = der_items(data[at : at + size], depth + 1)
            if value is None:
                return None
        items.append((tag, value))
        at += size
    return items


def is_key(data: bytes) -> bool:
    """Whether bytes are one DER sequence shaped as a key: integers of an RSA key, or an algorithm identifier of a key."""
    items = der_items(data)
    if not items or len(items) != 1 or items[0][0] != 0x30 or not isinstance(items[0][1], list):
        return False
    parts = items[0][1]
    tags = [t for t, _ in parts]
    if tags == [2] * 9 or tags == [2, 2] and len(parts[0][1]) >= 64:  # an RSA private key, or its modulus and exponent
        return True
    if tags[:2] == [2, 4] and len(parts[1][1]) in (28, 32, 48, 66) and parts[0][1] == b"\x01":  # an EC private key
        return True
    return any(t == 0x30 and isinstance(v, list) and v and v[0][0] == 6 and v[0][1] in KEY_OIDS for t, v in parts[:2]) and any(t in (3, 4) for t in tags)


def is_encrypted_key(data: bytes) -> bool:
    """Whether bytes are one DER sequence of a password-based algorithm and the ciphertext."""
    items = der_items(data)
    if not items or len(items) != 1 or not isinstance(items[0][1], list) or [t for t, _ in items[0][1]] != [0x30, 4]:
        return False
    algorithm = items[0][1][0][1]
    return isinstance(algorithm, list) and bool(algorithm) and algorithm[0][0] == 6 and algorithm[0][1].startswith(PBE_PREFIXES)


def is_openssh_key(data: bytes) -> bool:
    """Whether bytes are an OpenSSH container whose strings' lengths fill it: cipher, kdf, options, public keys, private part."""
    if not data.startswith(OPENSSH):
        return False
    at, keys = len(OPENSSH), 0
    for k in range(3):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return False
    for _ in range(keys + 1):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at == len(data)


def is_pem_key(headers: str, body: str) -> bool:
    data = decoded64("".join(body.split()))
    if not data:
        return False
    if "ENCRYPTED" in headers:  # the body is ciphertext, in whole blocks
        return "DEK-Info:" in headers and len(data) % 8 == 0
    return is_key(data) or is_encrypted_key(data) or is_openssh_key(data)


def pem_blocks(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, headers, body) of marked key blocks, in one pass: a mark, header lines, a body, the closing mark.

    What an earlier mark has run through (the rest of a line, header lines, a body) is not run
    through again for a later one, so the time grows with the text, whatever it holds.
    """
    line = (0, -1)  # from where the next line break is known, and where it is
    run = (0, 0)  # header lines
    body = (-1, -1)

    def header(at: int) -> int | None:
        """Where the header line at ``at`` and the blanks behind it end."""
        nonlocal line
        if not (field := PEM_FIELD.match(text, at)):
            return None
        if not line[0] <= field.end() <= line[1]:
            found = text.find("\n", field.end())
            line = (field.end(), len(text) if found < 0 else found)
        return None if line[1] == len(text) else BLANKS.match(text, line[1] + 1).end()

    at = 0
    while begin := PEM_BEGIN.search(text, at):
        at = first = end = begin.end()
        if run[0] <= first < run[1]:
            end = run[1] if header(first) else first
        else:
            while (more := header(end)) is not None:
                end = more
            run = (first, end)
        if body[0] != end:
            body = (end, PEM_BODY.match(text, end).end())
        closing = f"-----END {begin[1]}-----"
        if body[1] > end and text.startswith(closing, body[1]):
            at = body[1] + len(closing)
            yield begin.start(), at, text[first:end], text[end : body[1]]


def decoded64(text: str) -> bytes | None:
    text = text.rstrip("=").translate({45: "+", 95: "/"})
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    head, body = decoded64(header), decoded64(payload)
    try:
        fields = json.loads(head) if head else None
        return isinstance(fields, dict) and isinstance(fields.get("alg"), str) and body is not None and (signature != "" or fields["alg"].lower() == "none") and (decoded64(signature) is not None)
    except (ValueError, RecursionError):
        return False


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every find, in order; positions are code points."""
    out: list[tuple[int, int, str]] = []
    lowered = text.encode("utf-8", "surrogatepass").lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    out += confirmed(text)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def confirmed(text: str) -> list[tuple[int, int, str]]:
    """Finds of the confirming pass: only candidates that decode and parse."""
    out = []
    if "-----BEGIN" in text:
        out += [(a, b, "pem") for a, b, headers, body in pem_blocks(text) if is_pem_key(headers, body)]
    if "eyJ" in text:
        out += [(*m.span(), "token") for m in SIGNED.finditer(text) if is_signed_token(m[1], m[2], m[3])]
    if "M" in text:
        for m in DER64.finditer(text):
            if (data := decoded64(m[0])) and is_key(data):
                out.append((*m.span(), "der64"))
    if "30" in text:
        out += [(*m.span(), "derhex") for m in DERHEX.finditer(text) if (m.end() - m.start()) % 2 == 0 and is_key(bytes.fromhex(m[0]))]
    return out


def shown(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scanned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans and (on demand) found, an array of spans.

    Texts are read whole.  A null or empty text has no spans; overlapping finds of different
    kinds are all kept; repeated rows give repeated results; an empty table gives an empty
    result; other columns aren't read.  No shuffle.
    """
    table = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("__text"))
    kind = table.schema["doc_id"].dataType.simpleString()
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            found = [spans(t or "") for t in batch.column(1).to_pylist()]
            base = [[s for s in f if s[2] in KINDS[:3]] for f in found]
            columns = [batch.column(0)]
            columns += [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS[:3]]
            columns += [pa.array([hashlib.sha256(shown(b).encode()).hexdigest() for b in base], pa.string()), pa.array([shown(f) for f in found], pa.string())]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            if with_spans:
                columns.append(pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in f] for f in found], found_type))
                names.append("found")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return mapped(table, run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string{', found ' + SPANS if with_spans else ''}")
