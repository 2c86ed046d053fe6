"""Secret scans with structural confirmation.

The base finds assignments of passwords and tokens, access ids and runs of hex digits by pattern.
Beyond it, base64 and hex candidates are decoded and reported only if their structure holds: DER
keys whose nested lengths add up, OpenSSH keys with their key count and strings, PEM blocks around
either (or around an encrypted body that names its cipher), and signed tokens of three parts whose
header is JSON with an algorithm. Base64 may be of either alphabet, wrapped over lines, with real or
escaped line ends, and a key may begin anywhere in its run; a decoded key is of MAX_KEY bytes at most,
so every place is looked at with bounded work and a scan takes time in proportion to the text. Places
are code points of the text as it stands, the end exclusive.

Null and empty text: no spans. Repeated rows: one result each. An empty table gives no rows. Very long
texts are scanned whole. Spans of different kinds may overlap; of equal ones there is one. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")
#: Longest private key, in bytes of its encoding; RSA with 16384 bits takes about 9300.
MAX_KEY = 16384
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_LONG = re.compile(r"\S{20,}")  # what follows holds no white space and is at least that long
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_ANY = re.compile(r"[0-9A-Fa-f]{48,}")
_HEX_KEY = re.compile(r"30[0-9A-Fa-f]|6f70656e7373682d6b65792d763100", re.I)
#: Base64 of either alphabet, with line ends between its lines.
_B64 = re.compile(r"[A-Za-z0-9+/_-]{20,}+(?:(?:\\r)?(?:\\n|\r?\n)[ \t]*+[A-Za-z0-9+/_-]{4,}+)*+={0,2}")
_LINE_END = re.compile(r"(?:\\r)?(?:\\n|\r?\n)[ \t]*")
#: How base64 of a DER sequence of 24 bytes or more, and of the OpenSSH magic, begins.
_B64_KEY = re.compile(r"M[B-I]|b3BlbnNzaC1rZXktdjEA")
_TOKEN_PART = re.compile(r"[A-Za-z0-9_-]+")
_PEM_LINE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}?PRIVATE KEY)-----")
_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*: .*")
_OPENSSH = b"openssh-key-v1\0"


def der_key(data: bytes, first: int = 0x02) -> bool:
    """A DER SEQUENCE that fills data, starts with a version number (or the tag first) and whose nested lengths all add up."""

    def items(at: int, end: int, depth: int) -> list[int] | None:
        tags = []
        while at < end:
            if end - at < 2 or depth > 8:
                return None
            tag, n, at = data[at], data[at + 1], at + 2
            if n & 0x80:
                k = n & 0x7F
                if not 0 < k <= 4 or at + k > end:
                    return None
                n, at = int.from_bytes(data[at : at + k], "big"), at + k
            if at + n > end or tag == 0:
                return None
            if tag & 0x20 and items(at, at + n, depth + 1) is None:
                return None
            tags.append(tag)
            at += n
        return tags

    if len(data) < 24 or data[0] != 0x30:
        return False
    top = items(0, len(data), 0)
    if top != [0x30]:
        return False
    head = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    inner = items(head, len(data), 1)
    return bool(inner) and len(inner) >= 2 and inner[0] == first


def der_length(head: bytes) -> int | None:
    """The whole length of the DER SEQUENCE that head begins, if it is that of a key."""
    if len(head) < 4 or head[0] != 0x30:
        return None
    if not head[1] & 0x80:
        n = 2 + head[1]
    else:
        k = head[1] & 0x7F
        if k not in (1, 2):
            return None
        n = 2 + k + int.from_bytes(head[2 : 2 + k], "big")
    return n if 24 <= n <= MAX_KEY else None


def openssh_length(data: bytes) -> int | None:
    """The length of the OpenSSH key at the start of data: magic, cipher, derivation and its options, number of keys, each public key, the private part."""
    if not data.startswith(_OPENSSH):
        return None
    at = len(_OPENSSH)

    def skip(at: int) -> int | None:
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at if at <= len(data) else None

    for _ in range(3):
        if (at := skip(at)) is None:
            return None
    keys = int.from_bytes(data[at : at + 4], "big")
    if not 0 < keys <= 16:
        return None
    at += 4
    for _ in range(keys + 1):
        if (at := skip(at)) is None:
            return None
    return at


def decoded64(s: str) -> bytes:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    s = s[: len(s) - (len(s) % 4 == 1)]
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def decoded16(s: str) -> bytes:
    return bytes.fromhex(s[: len(s) - len(s) % 2])


def key_at(run: str, at: int, decode, chars: int, per: int) -> tuple[str, int] | None:
    """Kind and end in run of the key that begins at place at; chars characters of run hold per bytes."""
    head = decode(run[at : at + 24])
    if head.startswith(_OPENSSH[:9]):
        n = openssh_length(decode(run[at : at + -(-MAX_KEY // per) * chars]))
        return n and ("openssh", min(at + -(-n * chars // per), len(run)))
    n = der_length(head)
    # version numbers of keys are small: most places are given up here
    inner = 2 + (head[1] & 0x7F if len(head) > 1 and head[1] & 0x80 else 0)
    if n is None or head[inner : inner + 2] != b"\x02\x01" or head[inner + 2] > 3:
        return None
    end = at + -(-n * chars // per)
    if end > len(run) or not der_key(decode(run[at:end])[:n]):
        return None
    return "der", end


def keys_in(run: str, starts: re.Pattern, decode, chars: int, per: int) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the keys in run, which don't overlap."""
    at = 0
    while m := starts.search(run, at):
        found = key_at(run, m.start(), decode, chars, per)
        if found:
            yield found[0], m.start(), found[1]
        at = found[1] if found else m.start() + 1


def joined_lines(block: str) -> tuple[str, list[int], list[int]]:
    """block without its line ends, and where each of its lines begins in what is left and in block."""
    lines, left, there, n, at = [], [], [], 0, 0
    for end, after in [*((m.start(), m.end()) for m in _LINE_END.finditer(block)), (len(block), len(block))]:
        lines.append(block[at:end])
        left.append(n)
        there.append(at)
        n, at = n + end - at, after
    return "".join(lines), left, there


def pem_body(body: str) -> bool:
    """Whether what stands between the lines of a PEM block is a key, or encrypted and says how."""
    lines = [x.strip(" \t\"',+") for x in re.split(r"(?:\\r)?\\n|\r?\n", body)]
    headers = [x for x in lines if _HEADER.fullmatch(x)]
    data = decoded64("".join("".join(x for x in lines if not _HEADER.fullmatch(x)).split()))
    if any(x.startswith("DEK-Info:") for x in headers):
        return len(data) >= 24 and len(data) % 8 == 0
    return der_key(data) or der_key(data, 0x30) or openssh_length(data) is not None


def signed_token(head: str, payload: str) -> bool:
    """Whether head is a JSON object with an algorithm and payload is base64 of something."""
    try:
        found = json.loads(decoded64(head))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str) and len(payload) % 4 != 1


def signed_tokens(run: str) -> Iterator[tuple[int, int]]:
    """(start, end) of signed tokens in run: two parts and a third, maybe empty, with dots between."""
    parts, at = [m.span() for m in _TOKEN_PART.finditer(run)], 0
    for i, (s, e) in enumerate(parts[:-1]):
        head = run.find("eyJ", s, e)
        if s < at or head < 0 or e - head < 11 or run[e] != "." or parts[i + 1][0] != e + 1:
            continue
        payload = parts[i + 1]
        if run[payload[1] : payload[1] + 1] == "." and signed_token(run[head:e], run[slice(*payload)]):
            at = payload[1] + 1
            if i + 2 < len(parts) and parts[i + 2][0] == at:
                at = parts[i + 2][1]
            yield head, at


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of its kind in KINDS, end) of every span, sorted."""
    out: set[tuple[int, int, int]] = set()
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out.update((m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6)
    for run in _LONG.finditer(text):
        at, end = run.span()
        out.update((m.start(), 1, m.end()) for m in _ACCESS.finditer(text, at, end))
        out.update((m.start(), 2, m.end()) for m in _HEX.finditer(text, at, end))
        for m in _HEX_ANY.finditer(text, at, end):
            out.update((m.start() + s, KINDS.index(kind), m.start() + e) for kind, s, e in keys_in(m[0], _HEX_KEY, decoded16, 2, 1))
        if "eyJ" in run[0]:
            out.update((at + s, 6, at + e) for s, e in signed_tokens(run[0]))
    if _B64_KEY.search(text):
        for m in _B64.finditer(text):
            if _B64_KEY.search(m[0]):
                run, left, there = joined_lines(m[0])

                def place(i: int, last: bool) -> int:
                    line = bisect.bisect_right(left, i - last) - 1
                    return m.start() + there[line] + i - left[line]  # noqa: B023

                for kind, s, e in keys_in(run, _B64_KEY, decoded64, 4, 3):
                    e = len(run) if set(run[e:]) <= {"="} else e
                    out.add((place(s, False), KINDS.index(kind), place(e, True)))
    if "-----BEGIN" in text:
        marks = list(_PEM_LINE.finditer(text))
        for a, b in zip(marks, marks[1:], strict=False):
            if (a[1], b[1]) == ("BEGIN", "END") and a[2] == b[2] and pem_body(text[a.end() : b.start()]):
                out.add((a.start(), 3, b.end()))
    return sorted(out)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                counts, digests, joined = [[], [], []], [], []
                for text in b.column("text").to_pylist():
                    found = spans(text or "")
                    shown = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in found]
                    for i in range(3):
                        counts[i].append(sum(k == i for k, _ in shown))
                    digests.append(hashlib.sha256(",".join(x for k, x in shown if k < 3).encode()).hexdigest())
                    joined.append(",".join(x for _, x in shown))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        rows, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
