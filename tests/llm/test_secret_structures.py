"""Structures of the secret scan: written line ends, quoted lines, OPENSSH fields, labels
and numbers of keys without bounds; spans against a slow plain reading."""

from __future__ import annotations

import base64
import json
import random
import re
import textwrap
import time

import pytest

from ledgerloom.llm import secret_scan

BODY = b"\x02\x01\x00\x02\x81\x80" + bytes(range(1, 129))
DER = b"\x30\x81" + bytes([len(BODY)]) + BODY
B64 = base64.b64encode(DER).decode()
LINES = textwrap.wrap(B64, 64)
SSH = base64.b64encode(b"\0\0\0\x0bssh-ed25519\0\0\0\x20" + b"\x07" * 32).decode()


def pem(label="PRIVATE KEY", lines=LINES):
    return f"-----BEGIN {label}-----\n" + "\n".join(lines) + f"\n-----END {label}-----\n"


def found(text):
    return [(k, text[s:e]) for k, s, e in secret_scan.ordered(secret_scan.confirmed(text))]


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_written_and_quoted_pem(ends):
    plain = pem().replace("\n", ends)
    forms = {
        "json": json.dumps({"type": "service_account", "private_key": plain, "client": "x"}), "twice": json.dumps(json.dumps({"k": plain})), "env": 'KEY="' + plain.replace("\n", "\\n") + '"',
        "mail": ends.join("> " + x for x in pem().split("\n")), "nested mail": ends.join("> > " + x for x in pem().split("\n")), "comment": ends.join("# " + x for x in pem().split("\n")),
        "literals": ends.join(f'  "{x}\\n" +' for x in pem().strip().split("\n")), "list": ends.join(f"  '{x}'," for x in pem().strip().split("\n")), "yaml": "key: |" + ends + ends.join("    " + x for x in pem().split("\n")),
    }
    for name, text in forms.items():
        spans = found(text)
        assert [k for k, _ in spans] == ["pem"], name
        assert spans[0][1].startswith("-----BEGIN PRIVATE KEY-----") and spans[0][1].endswith("-----END PRIVATE KEY-----")
    broken = pem(lines=[LINES[0], LINES[1][:-4]])
    for text in (broken, json.dumps(broken), "\n".join("> " + x for x in broken.split("\n"))):
        assert found(text) == []


def test_encrypted_body_with_written_line_ends():
    cipher = base64.b64encode(bytes(range(64))).decode()
    text = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{'0F' * 16}\n\n{cipher}\n-----END RSA PRIVATE KEY-----"
    assert [k for k, _ in found(json.dumps({"k": text}))] == ["pem"] and [k for k, _ in found(text.replace("RSA", "RSA " + "X" * 60))] == ["pem"]


def test_bare_runs_with_written_line_ends():
    for text in (json.dumps({"private_key": "\n".join(LINES)}), json.dumps({"private_key": "\n" + "\n".join(LINES) + "\n"}), json.dumps(json.dumps({"k": "\r\n".join(LINES)}))):
        assert [k for k, _ in found(text)] == ["der"], text
    ssh = textwrap.wrap(SSH, 40)
    assert [k for k, _ in found("\\n".join(ssh))] == ["ssh"]


def test_keys_behind_separators():
    for before in ("/etc/keys/", "--key-", "key_", "a/b_c-"):
        for run, kind in ((B64, "der"), (SSH, "ssh")):
            assert found(f"x {before}{run} y") == [(kind, run)], before
    assert found("x /etc/" + B64[:-8] + " y") == [] and found("/AAAA" * 5000) == [] and found("/MIGG" * 5000) == []


def openssh(cipher=b"none", kdf=b"none", options=b"", keys=None, private=b"\x01" * 64, tail=b"", n=None):
    field = lambda x: len(x).to_bytes(4, "big") + x
    public = field(b"ssh-ed25519") + field(b"\x07" * 32)
    keys = [public] if keys is None else keys
    return b"openssh-key-v1\0" + field(cipher) + field(kdf) + field(options) + (len(keys) if n is None else n).to_bytes(4, "big") + b"".join(map(field, keys)) + field(private) + tail


def test_openssh_layout_is_read_to_its_end():
    block = lambda data: pem("OPENSSH PRIVATE KEY", textwrap.wrap(base64.b64encode(data).decode(), 70))
    good = [openssh(), openssh(b"aes256-ctr", b"bcrypt", b"\0\0\0\x04salt\0\0\0\x10"), openssh(b"aes256-gcm@openssh.com", tail=b"\x05" * 16)]
    for data in good:
        assert [k for k, _ in found(block(data))] == ["pem"] and [k for k, _ in found(json.dumps(block(data)))] == ["pem"]
    bad = [b"openssh-key-v1\0garbage" * 4, openssh(tail=b"\0"), openssh(private=b"\x01" * 63), openssh(private=b""), openssh(keys=[]), openssh(keys=[b"no fields"]), openssh(n=2), openssh(n=2**32 - 1), openssh(cipher=b""), openssh(cipher=b"\xff"), openssh()[:-1], openssh()[:40]]
    for data in bad:
        assert found(block(data)) == [], data[:40]


def test_time_is_in_proportion():
    took = []
    for n in (4000, 8000):
        text = pem() * n + f"{B64} {SSH}\n" * 100
        start = time.perf_counter()
        spans = secret_scan.confirmed(text)
        took.append(time.perf_counter() - start)
        assert len(spans) == n + 200
    assert took[1] < 2 + 3 * took[0] and took[1] < 10
    for text in ("-----BEGIN A-----\n" * 50_000, "-----END A-----" * 50_000, "-----BEGIN " + "A " * 500_000, "M" * 1_000_000, "\\n" * 500_000, "MIIB\\n" * 100_000):
        start = time.perf_counter()
        assert secret_scan.confirmed(text) == [] and time.perf_counter() - start < 10, text[:20]


def slow(text):
    """Blocks by one lazy pattern, runs by trying each place against every block."""
    out = []
    for m in re.finditer(r"-----BEGIN ([A-Z0-9 ]+)-----((?:(?!-----BEGIN [A-Z0-9 ]+-----).)*?)-----END \1-----", text, re.S):
        data = secret_scan.decode64("".join(m[2].split()))
        if data and secret_scan.is_der(data):
            out.append(("pem", m.start(), m.end()))
    blocks = [x[1:] for x in out]
    for m in re.finditer(r"(?<![A-Za-z0-9+/_\\-])[A-Za-z0-9+/_-]{32,}={0,2}", text):
        if any(s <= m.start() < e for s, e in blocks):
            continue
        for at in [0, *(i + 1 for i, c in enumerate(m[0]) if c in "/_-" and re.match("M[A-P]|AAAA", m[0][i + 1 :]))]:
            data = secret_scan.decode64(m[0][at:])
            kind = data and ("der" if secret_scan.is_der(data) else "ssh" if secret_scan.is_ssh_key(data) else None)
            if kind:
                out.append((kind, m.start() + at, m.end()))
                break
    return sorted(out)


def test_spans_match_a_slow_reading():
    rng = random.Random(6)
    pieces = ["-----BEGIN A KEY-----", "-----END A KEY-----", "-----BEGIN B-----", "-----END B-----", "-----BEGIN x-----", " ", "\n", B64, SSH, B64[:-4] + "AAAA", "A" * 40, "word", "-", "é", "="]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 9)))
        assert sorted(secret_scan.confirmed(text)) == slow(text), text
