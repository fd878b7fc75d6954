"""Secret scans with structural confirmation.

Base spans come from three patterns.  The method adds spans: base64 and hex
candidates are decoded and must hold a structure - a signed token's header and
claims, a DER key with lengths that nest exactly, a wire-format public key, a
PEM block whose body decodes to DER - before they are reported.  Candidates are tried
at every place where such a structure can begin, not only at the start of a run.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from spanlake.llm.common import id_text, table

_WORDS = ("password", "passwd", "secret", "token")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" for c in word)


ASSIGN = re.compile(
    "(" + "|".join([*map(_either, _WORDS), _either("api") + "_?" + _either("key")]) + ")"
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Any key word ends in one of these three letters, then a delimiter: a quick test of whether ASSIGN can match.
HINT = re.compile(r"""[DdTtNnYy]["']?\x20*[:=]""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ARMOR = re.compile(r"-----BEGIN ([A-Z0-9 ]{2,40})-----([A-Za-z0-9+/=\s]+)-----END \1-----")
DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
#: How base64 of a JSON object begins: a brace, then a quote or white space.
OBJECT = re.compile(r"e(?:y[A-DI-L]|w[k-r0-3])")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{32,}")
#: How base64 of a DER SEQUENCE or of a wire-format key begins; behind it at least 30 more of a run.
KEY = re.compile(r"(?=(?:M[A-P]|AAAA)[A-Za-z0-9+/_-]{28})")
BREAK = re.compile(r"[ \t]*\r?\n[ \t]*")
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
HEXKEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "sshkey", "hexder")


def _b64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_nests(data: bytes) -> bool:
    """Whether data is one DER SEQUENCE, whole, whose nested lengths fit exactly and that holds an INTEGER or OID."""
    def elements(lo: int, hi: int):
        out = []
        while lo < hi:
            if hi - lo < 2:
                return None
            tag, n, lo = data[lo], data[lo + 1], lo + 2
            if n >= 0x80:
                k = n & 0x7F
                if not 1 <= k <= 4 or hi - lo < k:
                    return None
                n, lo = int.from_bytes(data[lo:lo + k], "big"), lo + k
            if n > hi - lo:
                return None
            out.append((tag, lo, lo + n))
            lo += n
        return out

    top = elements(0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    todo, seen = [top[0]], set()
    while todo:
        tag, lo, hi = todo.pop()
        inner = elements(lo, hi)
        if inner is None:
            return False
        seen.update(x[0] for x in inner)
        todo += [x for x in inner if x[0] in (0x30, 0x31)]
    return bool(seen & {0x02, 0x06}) and len(data) >= 24


def ssh_nests(data: bytes) -> bool:
    """Whether data is length-prefixed strings, of which the first names a key type."""
    at, parts = 0, []
    while at < len(data):
        n = int.from_bytes(data[at:at + 4], "big")
        if len(data) - at < 4 or n > len(data) - at - 4:
            return False
        parts.append(data[at + 4:at + 4 + n])
        at += 4 + n
    return len(parts) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", parts[0]) is not None


def _object(s: str) -> dict | None:
    raw = _b64(s)
    try:
        x = json.loads(raw) if raw else None
    except (ValueError, UnicodeDecodeError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def signed_tokens(text: str) -> list[tuple[int, int]]:
    """Spans of header.claims.signature with JSON objects and an algorithm in the header.

    A header may begin inside a run of letters, and the three parts anywhere in a
    run of dotted ones.  A start costs the decoding of a few characters unless it
    looks like an object from its beginning to the end of its part.
    """
    out = []
    for m in DOTTED.finditer(text):
        if m.end() - m.start() < 12 or "." not in m[0] or not OBJECT.search(m[0]):
            continue
        parts, at, i = m[0].split("."), m.start(), 0
        while i + 2 < len(parts):
            head, claims, last = parts[i:i + 3]
            start = next((x.start() for x in OBJECT.finditer(head) if len(head) - x.start() >= 8 and _looks_whole(head, x.start()) and isinstance((_object(head[x.start():]) or {}).get("alg"), str)), None)
            if start is None or len(claims) < 2 or _object(claims) is None:
                at, i = at + len(head) + 1, i + 1
                continue
            end = at + len(head) + len(claims) + len(last) + 2
            out.append((at + start, end))
            at, i = end + 1, i + 3
    return out


def _looks_whole(s: str, start: int) -> bool:
    """Whether base64 from start on begins with a brace and a quote, and ends, at the end of s, with a brace."""
    first, n = _b64(s[start:start + 24][:(len(s) - start) // 4 * 4 or 4]), len(s) - start
    tail = _b64(s[len(s) - (n % 4 + 8 if n >= 12 else n):])
    return first is not None and first.lstrip(b"{ \t\r\n")[:1] == b'"' and tail is not None and tail.rstrip()[-1:] == b"}"


def _taken(text: str, start: int, n: int) -> tuple[str, int] | None:
    """n characters of base64 from start on, line breaks left out, and where they and any padding end; None if the run is shorter or longer."""
    parts, at = [], start
    while n > 0:
        run = RUN.match(text, at, at + n)
        if run is None:
            return None
        parts.append(run[0])
        n, at = n - len(run[0]), run.end()
        if n:
            gap = BREAK.match(text, at)
            if gap is None:
                return None
            at = gap.end()
    if RUN.match(text, at, at + 1) and text[at] not in "-_":
        return None
    for _ in range(2):
        at += text[at:at + 1] == "="
    return "".join(parts), at


def key_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of base64, standard or URL-safe, on one line or wrapped, that decodes to a DER structure or a wire-format public key.

    A key may begin anywhere in a run.  A start costs the decoding of a few
    characters, unless those are the head of a structure that ends where the run does.
    """
    out, free = [], 0
    for m in BASE64.finditer(text):
        for k in KEY.finditer(text, max(m.start(), free), m.end()):
            start = k.start()
            if start < free:
                continue
            head = _b64(text[start:start + 28])
            if head is None:
                continue
            if head[0] == 0x30:
                size = 2 + head[1] if head[1] < 0x80 else 2 + (head[1] & 0x7F) + int.from_bytes(head[2:2 + (head[1] & 0x7F)], "big") if 0x81 <= head[1] <= 0x84 else 0
                if size < 24 or size > len(text):
                    continue
                kind, good = 5, der_nests
            else:
                if not re.match(rb"\0\0\0.(ssh|ecdsa|sk)-", head, re.S):
                    continue
                size, kind, good = (m.end() - start) * 3 // 4, 6, ssh_nests
            got = _taken(text, start, -(-size * 4 // 3))
            raw = _b64(got[0]) if got else None
            if raw and good(raw):
                out.append((start, kind, got[1]))
                free = got[1]
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds, in order."""
    out = []
    if HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def method_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    if "-----BEGIN" in text:
        for m in ARMOR.finditer(text):
            raw = _b64("".join(m[2].split()))
            if raw and (der_nests(raw) or raw.startswith(b"openssh-key-v1\0")):
                out.append((m.start(), 3, m.end()))
    if "." in text and OBJECT.search(text):
        out += [(a, 4, b) for a, b in signed_tokens(text)]
    out += key_spans(text)
    if "30" in text:
        out += [(m.start(), 7, m.end()) for m in HEXKEY.finditer(text) if m[0].startswith("30") and der_nests(bytes.fromhex(m[0]))]
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches):
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            kinds = [k for _, k, _ in base]
            line = joined(base)
            row = (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(line.encode()).hexdigest(), joined(sorted(base + method_spans(text))))
            for c, v in zip(cols, row):
                c.append(v)
        i64, s = pa.int64(), pa.string()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (i64, i64, i64, s, s)))],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Offsets are code points, ends exclusive.  Null and empty texts have no spans;
    repeated rows give repeated rows; further columns of docs are ignored.
    """
    narrow = id_text(docs, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(_scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op8_secret_scan(spark, sf_dir):
    return secret_scan(table(spark, sf_dir, "documents"))
