"""Secret scan with structural confirmation.

Three base patterns (assign, access, hex) report on sight. Anything else that
looks like encoded key material is decoded and parsed first, and reported only
if its structure holds:

* ``jwt``  three base64url parts; the first decodes to a JSON object with an
  ``alg`` string, the second to a JSON object.
* ``pem``  a BEGIN/END block of one label whose base64 body is DER (or, for
  OPENSSH keys, the ``openssh-key-v1`` layout, all its fields) or an encrypted legacy
  body; also with its line ends written as escapes, as JSON has them, as quoted or
  commented lines, and as string literals put together.
* ``der``  a base64 or hex run that decodes to one ASN.1 SEQUENCE whose nested
  lengths add up exactly and which holds an INTEGER, BIT STRING or OCTET STRING.
  A run wrapped over lines, written as escapes or not, is joined as far as its first
  bytes say; one behind ``/``, ``-`` or ``_`` (a path, an option) counts from there on.
* ``ssh``  a base64 run, of one line or more, that starts with an SSH public key's length-prefixed
  algorithm name and whose length-prefixed fields fill it exactly.

Each task reads its own rows once and keeps nothing between them; there is no
shuffle, so a lost executor costs its own tasks only. A text takes time in proportion
to its length, however many keys are in it.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Order in which kinds are listed where spans start at the same place.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")

# The base patterns of the contract.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
HINT = re.compile(r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk]")

JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*(?![A-Za-z0-9_-])")
MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]+)-----")
#: Where a run may start: behind no character of its own, or behind a written line end.
START = r"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\[nrt])|(?<=\\)(?![nrt]))"
#: A line end, written out or escaped, and marks of quoted lines.
BREAK = r"(?:[ \t]*\\?\r?\n[ \t]*(?:>[ \t]*)*|(?:\\+r)?\\+n[ \t]*)"
LONG = re.compile(START + r"[A-Za-z0-9+/_-]{32,}={0,2}")
#: First line of a wrapped key: how a SEQUENCE or an SSH name's length begins.
WRAPPED = re.compile(START + r"(?:M[A-P]|AAAA|30)[A-Za-z0-9+/_-]{6,}(?=" + BREAK + ")")
NEXT_LINE = re.compile(BREAK + r"([A-Za-z0-9+/_-]+)(={0,2})")
#: Inside a run, where a key may begin behind a separator.
INSIDE = re.compile(r"[/_-](?=M[A-P]|AAAA)")
ESCAPED_END = re.compile(r"\\+[nrt]")
LITERAL_END = re.compile(r"""\\*["']\s*[+.,;]?\s*\\?$""")
LINE_MARKS = re.compile(r"""^[\s>|#*"'\\]+""")
ALL_HEX = re.compile(r"[0-9A-Fa-f]+")
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
OPENSSH = b"openssh-key-v1\0"
#: Fields of a key by its name, the name among them.
SSH_FIELDS = dict(zip((len(x).to_bytes(4, "big") + x for x in SSH_NAMES), (3, 5, 2, 3, 3, 3), strict=True))


def decode64(text: str) -> bytes | None:
    """Standard or URL alphabet, padding optional; None if it doesn't decode."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_header(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first content byte, byte after the content), by definite lengths."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def is_der(data: bytes) -> bool:
    """One SEQUENCE that ends where the data ends; every constructed value in it
    is filled exactly by its parts, and a number or string of bits is among them."""
    top = der_header(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data) or top[1] == top[2]:
        return False
    todo, leaves, payload = [(top[1], top[2])], 0, False
    while todo:
        at, end = todo.pop()
        while at < end:
            head = der_header(data, at, end)
            if head is None or head[0] & 0x1F == 0x1F:
                return False
            tag, first, at = head
            leaves += 1
            payload |= tag in (0x02, 0x03, 0x04) and at > first
            if tag & 0x20:
                todo.append((first, at))
    return payload and leaves >= 2


def fields_of(data: bytes, at: int, most: int | None = None) -> tuple[list[bytes], int] | None:
    """(length-prefixed fields from ``at`` on, the place after them): all there are, or
    ``most``; None where a length reaches over the end."""
    fields = []
    while at < len(data) if most is None else len(fields) < most:
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        if at > len(data):
            return None
        fields.append(data[at - size : at])
    return fields, at


def is_ssh_key(data: bytes) -> bool:
    read = fields_of(data, 0)
    return read is not None and len(read[0]) >= 2 and read[0][0] in SSH_NAMES


def is_openssh(data: bytes) -> bool:
    """The private key layout to its end: names of cipher and key derivation and its
    options, a number of public keys, as many public keys, and a private part of whole
    blocks (and a tag, for the ciphers that have one)."""
    if not data.startswith(OPENSSH):
        return False
    head = fields_of(data, len(OPENSSH), 3)
    if head is None or not all(re.fullmatch(rb"[!-~]+", x) for x in head[0][:2]) or head[1] + 4 > len(data):
        return False
    n, at = int.from_bytes(data[head[1] : head[1] + 4], "big"), head[1] + 4
    if not 1 <= n <= (len(data) - at) // 4:
        return False
    keys = fields_of(data, at, n)
    if keys is None or not all(_public(x) for x in keys[0]):
        return False
    private = fields_of(data, keys[1], 1)
    return private is not None and len(private[0][0]) >= 8 and len(private[0][0]) % 8 == 0 and len(data) - private[1] in (0, 16)


def _public(data: bytes) -> bool:
    read = fields_of(data, 0)
    return read is not None and len(read[0]) >= 2 and re.fullmatch(rb"[a-z0-9@.-]+", read[0][0]) is not None


def is_jwt(text: str) -> bool:
    try:
        head, body = (json.loads(decode64(x) or b"") for x in text.split(".")[:2])
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def bodies(body: str) -> Iterator[list[str]]:
    """The lines of a block as they stand; then with written line ends undone; then
    without the marks of quotes, comments and string literals around each."""
    plain = [x.strip() for x in body.strip().split("\n")]
    yield plain
    if "\\" in body:
        plain = [x.strip() for x in ESCAPED_END.sub("\n", body).strip().split("\n")]
        yield plain
    yield [LINE_MARKS.sub("", LITERAL_END.sub("", x)).strip() for x in plain]


def is_pem(label: str, body: str) -> bool:
    for lines in bodies(body):
        if any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in lines):
            data = decode64("".join(x for x in lines if x and ":" not in x))
            if data and len(data) % 8 == 0:
                return True
            continue
        data = decode64("".join("".join(lines).split()))
        if data and (is_openssh(data) if label.startswith("OPENSSH") else is_der(data)):
            return True
    return False


def pem_blocks(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, label, body) of each BEGIN mark and the first END mark of its label
    behind it, with no BEGIN between."""
    open_, label, body = -1, "", 0
    for m in MARK.finditer(text):
        if m[1] == "BEGIN":
            open_, label, body = m.start(), m[2], m.end()
        elif open_ >= 0 and m[2] == label:
            yield open_, m.end(), label, text[body : m.start()]
            open_ = -1


def outside(places: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans of ``places`` (in order) that start in none of ``taken``."""
    out, ends, i, until = [], sorted((s, e) for _, s, e in taken), 0, -1
    for x in places:
        while i < len(ends) and ends[i][0] <= x[1]:
            until = max(until, ends[i][1])
            i += 1
        if x[1] >= until:
            out.append(x)
    return out


def der_size(run: str) -> int:
    """Bytes of the SEQUENCE that starts a base64 or hex run; 0 if none does."""
    head = bytes.fromhex(run[: len(run[:12]) // 2 * 2]) if run.startswith("30") else decode64(run[:8])
    more = head[1] & 0x7F if head[1] & 0x80 else 0
    if more > 4 or more + 2 > len(head):
        return 0
    return 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])


def ssh_size(run: str) -> tuple[int, bool]:
    """Bytes of the SSH key that starts a base64 run, as far as the run tells, and
    whether that is all of it; 0 if none does."""
    data = decode64(run[: len(run) // 4 * 4]) or b""
    n = next((n for name, n in SSH_FIELDS.items() if name.startswith(data[: len(name)])), 0)
    if not n:
        return 0, False
    at = 0
    for _ in range(n):
        if at + 4 > len(data):
            return at + 4, False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at, True


def wrapped(text: str) -> list[tuple[str, int, int]]:
    """Keys that go on over line ends: runs of following lines are joined up to
    the length that the header of the SEQUENCE or the SSH key's fields say."""
    out, done = [], 0
    for m in WRAPPED.finditer(text):
        hexed, ssh = m[0].startswith("30"), m[0].startswith("AAAA")
        if m.start() < done or hexed and not ALL_HEX.fullmatch(m[0]):
            continue
        lines, chars, end, line = [m[0]], len(m[0]), m.end(), None
        size, whole = ssh_size(m[0]) if ssh else (der_size(m[0]), True)
        while size:
            need = 2 * size if hexed else -(-size * 8 // 6)
            if whole and chars >= need or line and line[2] or m.start() + need > len(text):
                break
            line = NEXT_LINE.match(text, end)
            if not line:
                break
            lines.append(line[1])
            chars, end = chars + len(line[1]), line.end()
            if not whole:
                size, whole = ssh_size("".join(lines))
        if not size or not whole or chars != need or len(lines) == 1:
            continue
        run = "".join(lines)
        data = (bytes.fromhex(run) if ALL_HEX.fullmatch(run) else None) if hexed else decode64(run)
        if data and (is_ssh_key(data) if ssh else is_der(data)):
            out.append(("ssh" if ssh else "der", m.start(), end))
            done = end
    return out


def key_of(run: str) -> tuple[str, int] | None:
    """(kind, place in the run it starts at) of the key a run ends with: the whole run,
    or what is behind a separator in it and by its first bytes just as long."""
    data = bytes.fromhex(run) if ALL_HEX.fullmatch(run) and len(run) % 2 == 0 else decode64(run)
    kind = data and ("der" if is_der(data) else "ssh" if is_ssh_key(data) else None)
    if kind:
        return kind, 0
    chars = len(run.rstrip("="))
    for m in INSIDE.finditer(run):
        rest = run[m.end() : m.end() + 64]
        ssh = rest.startswith("AAAA")
        if ssh and not any((decode64(rest[:16]) or b"").startswith(name[:12]) for name in SSH_FIELDS):
            continue
        if not ssh and -(-der_size(rest) * 8 // 6) != chars - m.end():
            continue
        data = decode64(run[m.end() :])
        if data and (is_ssh_key(data) if ssh else is_der(data)):
            return "ssh" if ssh else "der", m.end()
    return None


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """Spans of the kinds that need a structure."""
    out = []
    if "eyJ" in text:
        out += [("jwt", m.start(), m.end()) for m in JWT.finditer(text) if is_jwt(m[0])]
    if "-----BEGIN " in text:
        out += [("pem", s, e) for s, e, label, body in pem_blocks(text) if is_pem(label, body)]
    blocks = [x for x in out if x[0] == "pem"]
    joined = outside(wrapped(text), blocks)
    out += joined
    runs = outside([("run", m.start(), m.end()) for m in LONG.finditer(text)], blocks + joined)
    for _, start, end in runs:
        found = key_of(text[start:end])
        if found:
            out.append((found[0], start + found[1], end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if HINT.search(text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, spans array<struct<kind, start, end>>, in code
    points, end exclusive. Null and empty texts have none; repeated rows are
    scanned each on its own."""
    kind = docs.schema["doc_id"].dataType

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for part in parts:
            rows = []
            for at in range(len(part)):
                text = part.column(1)[at].as_py() or ""
                rows.append([{"kind": k, "start": s, "end": e} for k, s, e in ordered(base_spans(text) + confirmed(text))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, spans_type)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")
