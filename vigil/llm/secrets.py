"""Secret scans: base patterns, and candidates confirmed by their structure.

Base kinds are found by pattern alone. A base64 or hex candidate is reported only if it decodes to something with the
structure of a secret: a signed token whose header is JSON with an algorithm, DER whose nested lengths add up and whose
fields are those of a private key, or a private-key container of length-prefixed strings. Public keys, certificates and
signatures have other fields and are none. Row by row, without a shuffle.

What counts as a candidate: 40 or more base64 characters in lines of 20 or more, the last one of any length, broken as such,
with an indent, or as breaks are written in strings; a key may begin at each line and behind each _ or -. 64 or more hex digits,
of which one may stand before the key; armour of any length with or without header lines, where an encrypted key is told by
them. DER nested more than 16 deep, and keys of over 64 KB, are none. The work grows with the text.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "keyblob")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Three parts joined by dots; each part of a longer chain is tried as the first.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*))")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*KEY[A-Z0-9 ]*)-----((?:(?!-----).)*)-----END \1-----", re.S)
#: Header lines of old armour, up to the empty line, with line breaks as such or as written in a string.
_HEADERS = re.compile(r"(?:(?:\s|\\r|\\n)*[A-Za-z-]+: [^\n\\]*(?:\\r|\\n|\s)+)+")
#: Between lines of a block: a break with any indent, or one that is written in a string.
_BREAK = r"(?:\r?\n[ \t]*|(?:\\r)?\\n)"
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{20,}}(?:{_BREAK}[A-Za-z0-9+/_-]{{20,}})*(?:{_BREAK}[A-Za-z0-9+/_-]+)?={{0,2}}")
#: What base64 of a key begins with: a SEQUENCE, a length-prefixed type name, the name of a container.
_KEY_START = re.compile(r"M[A-P]|AAAA[BCE]|b3BlbnNzaC1rZXkt")
#: A token header begins like this once decoded.
_JSON = json.JSONDecoder()
_OBJECT = re.compile(rb"[ \t\r\n]*\{[ \t\r\n]*[\"}]")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
#: Base64 characters, of a block without its breaks, and bytes of a key at most.
LEAST_BLOCK, MOST_KEY = 40, 1 << 16


def decoded_base64(text: str) -> bytes | None:
    """Standard or URL-safe base64, with or without padding; None if it isn't."""
    body = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


Node = tuple[int, bytes, "list[Node]"]


def der(data: bytes, depth: int = 0) -> list[Node] | None:
    """The DER elements (tag, content, elements inside) if the nested lengths fill `data` exactly, else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            length, at = int.from_bytes(data[at : at + n], "big"), at + n
            if length < 0x80:
                return None
        if at + length > len(data):
            return None
        content = data[at : at + length]
        inner = (der(content, depth + 1) if depth < 16 else None) if tag & 0x20 else []
        if inner is None:
            return None
        out.append((tag, content, inner))
        at += length
    return out


_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def is_key_der(data: bytes) -> bool:
    """One SEQUENCE with the fields of a private key: a small version number and then the nine numbers of RSA or six of DSA,
    the octets of an elliptic curve, or an algorithm with octets (PKCS #8); or an encrypted one, an algorithm with parameters
    and octets. A public key has bits instead of octets and no version, a signature two numbers."""
    if len(data) < 30 or data[0] != _SEQUENCE:
        return False
    top = der(data)
    if top is None or len(top) != 1:
        return False
    fields = top[0][2]
    tags = [t for t, _, _ in fields]
    versioned = bool(fields) and tags[0] == _INTEGER and len(fields[0][1]) == 1 and fields[0][1][0] <= 2
    if versioned and all(t == _INTEGER for t in tags) and len(tags) in (6, 9):
        return True
    if versioned and len(tags) >= 2 and tags[1] == _OCTETS and len(fields[1][1]) >= 16:
        return True
    algorithm = lambda node: node[0] == _SEQUENCE and bool(node[2]) and node[2][0][0] == _OID
    if versioned and len(tags) >= 3 and algorithm(fields[1]) and tags[2] == _OCTETS:
        return True
    return tags == [_SEQUENCE, _OCTETS] and algorithm(fields[0]) and len(fields[0][2]) == 2 and len(fields[1][1]) >= 16


def _strings(data: bytes) -> list[bytes] | None:
    at, fields = 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + n > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return fields


#: How many length-prefixed fields a private key has behind its type; the public one has fewer.
_PRIVATE_FIELDS = {b"ssh-rsa": 6, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3}


def is_key_blob(data: bytes) -> bool:
    """A private key of length-prefixed strings: a container, or a type name and as many fields as a private key of the type
    has. A public key has fewer and is none."""
    if data.startswith(b"openssh-key-v1\0"):
        # Cipher, key derivation and its options, the number of keys, then each public key and all private ones.
        at = 15
        for _ in range(3):
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        inside = _strings(data[at + 4 :]) if at + 4 < len(data) else None
        return inside is not None and len(inside) == int.from_bytes(data[at : at + 4], "big") + 1 > 1
    fields = _strings(data)
    if not fields or fields[0] not in _PRIVATE_FIELDS:
        return False
    public = {b"ssh-rsa": 2, b"ssh-dss": 4, b"ssh-ed25519": 1}.get(fields[0], 2)
    # A comment may follow.
    return len(fields) - 1 in (_PRIVATE_FIELDS[fields[0]], _PRIVATE_FIELDS[fields[0]] + 1) and len(fields) - 1 > public


def der_size(data: bytes) -> int:
    """Bytes of the SEQUENCE at the start of `data`, by its own length; 0 if none of up to MOST_KEY bytes starts there."""
    if len(data) < 6 or data[0] != _SEQUENCE:
        return 0
    n = data[1] & 0x7F
    size = 2 + n if data[1] < 0x80 else 2 + n + int.from_bytes(data[2 : 2 + n], "big") if 1 <= n <= 4 else 0
    return size if size <= MOST_KEY else 0


def is_token_header(header: bytes, at: int = 0, plain: str | None = None) -> bool:
    """The first part of a signed token, decoded: from `at` on JSON with a string `alg`. plain: the bytes as characters."""
    found = _OBJECT.match(header, at)
    if not found:
        return False
    text = header.decode("latin-1") if plain is None else plain
    try:  # what is wrong is mostly wrong within the first bytes; a longer part is read only if these don't tell
        _, end = _JSON.raw_decode(text[at : at + 2048].lstrip())
        if at + 2048 >= len(text):
            return _is_header(header[at:])
        return end >= 2000 and _is_header(header[at:])
    except ValueError as e:
        open_ = "Unterminated" in str(e) or getattr(e, "pos", 0) >= 2000
        return open_ and at + 2048 < len(text) and _is_header(header[at:])
    except RecursionError:
        return False


def _is_header(data: bytes) -> bool:
    try:
        whole = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(whole, dict) and isinstance(whole.get("alg"), str)


def _header_at(run: str) -> int:
    """Where in a run of base64 a token header begins that ends with it: at its start or behind one of its _ and -; -1 if
    nowhere. Places that are a multiple of four apart share one decoding."""
    decoded: dict[int, tuple[int, bytes, str]] = {}
    for cut in (0, *(k.end() for k in re.finditer("[_-]", run))):
        rest = (len(run) - cut) % 4
        if len(run) - cut < 8 or rest == 1:
            continue
        if rest not in decoded:
            data = decoded_base64(run[cut:]) or b""
            decoded[rest] = (cut, data, data.decode("latin-1"))
        first, data, plain = decoded[rest]
        if is_token_header(data, (cut - first) // 4 * 3, plain):
            return cut
    return -1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, unsorted."""
    out = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def _armoured(kind: str, body: str) -> bool:
    """Whether armour holds a private key: by its structure, or, where header lines say that it is encrypted, by them."""
    plain = _HEADERS.sub("", body, count=1) if ": " in body else body
    data = decoded_base64(re.sub(r"\\[nr]|\s", "", plain))
    if not data:
        return False
    return is_key_der(data) or is_key_blob(data) or ("ENCRYPTED" in body and "PRIVATE" in kind and len(data) >= 32)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """The spans that the structure confirms: signed tokens, armoured keys, DER and key blobs in base64 or hex."""
    out, stop = [], 0
    if text.count(".") >= 2:
        for m in _JWT.finditer(text):
            if m.start() < stop:
                continue
            cut = _header_at(m[1])
            if cut >= 0 and decoded_base64(m[2]) is not None:
                stop = m.end(3)
                out.append((m.start() + cut, 3, stop))
    armoured = []
    if "-----BEGIN" in text:
        armoured = [(m.start(), 4, m.end()) for m in _PEM.finditer(text) if _armoured(m[1], m[2])]
    for m in _BASE64.finditer(text):
        if m.end() - m.start() >= LEAST_BLOCK and not any(a <= m.start() < b for a, _, b in armoured):
            out += _keys_in_block(m.start(), m[0])
    for m in _LONG_HEX.finditer(text):
        for odd in (0, 1):
            data = bytes.fromhex(m[0][odd : odd + (len(m[0]) - odd) // 2 * 2])
            out += [(m.start() + odd, kind, m.start() + odd + 2 * size) for kind, size in _keys_at(data)]
    return out + armoured


def _keys_at(data: bytes) -> list[tuple[int, int]]:
    """(kind, bytes) of the private keys that begin with `data`: DER says itself how long it is, a blob takes all."""
    size = der_size(data)
    out = [(5, size)] if size and size <= len(data) and is_key_der(data[:size]) else []
    return out + ([(6, len(data))] if len(data) <= MOST_KEY and is_key_blob(data) else [])


def _keys_in_block(start: int, block: str) -> list[tuple[int, int, int]]:
    """The keys in a block of lines. Ordinary lines before and after may look like lines of it, and a word with _ or - may
    stand before it: a key is looked for from each line and each such place on, and a blob also without the last line."""
    lines = [(m.start(), m[0]) for m in _LINE.finditer(re.sub(r"\\[nr]", "  ", block))]
    text = "".join(x for _, x in lines)
    if len(text) < LEAST_BLOCK:
        return []
    begins, n = [], 0
    for at, x in lines:
        begins.append((n, at))
        n += len(x)
    fresh = {i for i, _ in begins}
    place = lambda i: (k := bisect.bisect_right(begins, (i, 1 << 60)) - 1, begins[k][1] + i - begins[k][0])[1]
    stops, out, done = [len(text), begins[-1][0]] if len(lines) > 1 else [len(text)], [], 0
    for m in _KEY_START.finditer(text):
        i = m.start()
        if i < done or i not in fresh and text[i - 1] not in "_-":
            continue
        head = decoded_base64(text[i : i + 8]) or b""
        size = der_size(head)
        n_chars = -(-size * 4 // 3)
        if size and i + n_chars <= len(text):
            data = decoded_base64(text[i : i + -(-n_chars // 4) * 4]) or decoded_base64(text[i : i + n_chars])
            if data and is_key_der(data[:size]):
                out.append((i, 5, i + n_chars))
        elif not size:
            for stop in stops:
                data = decoded_base64(text[i:stop]) if 0 < stop - i <= MOST_KEY * 4 // 3 else None
                if data and is_key_blob(data):
                    out.append((i, 6, stop))
                    break
        if out and out[-1][0] == i:
            done = out[-1][2]
    # A key ends behind its last character and the padding that follows it.
    spans = [(start + place(i), kind, start + place(stop - 1) + 1) for i, kind, stop in out]
    return [(a, kind, b + len(re.match("={0,2}", block[b - start :])[0])) for a, kind, b in spans]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            found = [sorted({*base_spans(t), *confirmed_spans(t)}) for t in some.column(1).to_pylist()]
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(spans, pa.list_(kind))], ["id", "spans"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for each row of `docs`: array<struct<kind, start, end>> by start, then kind; offsets are code points.

    A null text is empty; no secret gives an empty array. Spans of different kinds may overlap. Very long texts are scanned
    whole; rows with equal ids or texts are rows of their own. The text of a secret is never returned. An empty table gives
    an empty result; other columns may have any name.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(_scan, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")
