"""Secret scan with structural confirmation.

Three base kinds are plain patterns (leftmost, non-overlapping, failing matches
dropped without a retry).  Further candidates, runs of base64, base64url or hex
characters, are only reported when what they decode to parses: a DER key
structure whose nested lengths fill the value exactly, an OpenSSH key blob whose
length-prefixed fields do, or a signed token whose header is JSON with an
algorithm.  A key may start at any line of a run of lines (line breaks may be
escaped) and ends at the line end that its own lengths name.

Row-local: the text is scanned where it is read, nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemap.llm.common import prepare, table

BASE_KINDS = ("assign", "access", "hex")
#: Order of kinds at equal starts: the base kinds as listed, then the confirmed ones.
KINDS = (*BASE_KINDS, "signed_token", "der_key", "ssh_key")
_ORDER = {k: i for i, k in enumerate(KINDS)}
#: Shortest base64 or hex run, its lines taken together, that is decoded; below it no key structure fits.
MIN_RUN = 40
#: Least size of an RSA modulus and greatest one of its exponent, in bytes: two integers of like size are a signature.
MIN_MODULUS, MAX_EXPONENT = 48, 8

_ASSIGN = re.compile(
    rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")  # the maximal runs of at least 16
_SIGNED = re.compile(rb"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_BREAK = rb"(?:[ \t]*\r?\n[ \t]*|(?:\\+r)?\\+n)"  # as such, with blanks around it, or escaped
_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{%d,}(?:%s[A-Za-z0-9+/_-]+)*={0,2}" % (MIN_RUN, _BREAK))
#: Runs that may be short in their first line, told by how sequences, lengths and the private kind begin.
_SHORT_LINES = re.compile(rb"(?<![A-Za-z0-9+/_-])(?:M[C-I]|AAAA|b3Bl)[A-Za-z0-9+/_-]{0,%d}(?:%s[A-Za-z0-9+/_-]+)+={0,2}"
                          % (MIN_RUN - 3, _BREAK))
#: The frame of a key in base64, at each of the three places where it may begin.
_WRAPPED = (b"LS0tLS1CRUdJTi", b"0tLS0tQkVHSU4", b"tLS0tLUJFR0lO")
_FRAME = re.compile(rb"-{5,}")
_LINE_BREAK = re.compile(_BREAK)
#: Fields of the usual public keys after which they end, their name counted.
_SSH_FIELDS = {b"ssh-ed25519": 2, b"ssh-rsa": 3, b"ssh-dss": 5, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3,
               b"ecdsa-sha2-nistp521": 3, b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4}
_SSH_PRIVATE = b"openssh-key-v1\x00"
#: Hex digits of a key from its first one on, in lines or with colons between bytes.
_HEX_RUN = re.compile(rb"(?<![0-9A-Fa-f])(?i:30|000000|6f7065)(?i:(?::|:?%s)?[0-9a-f]){%d,}" % (_BREAK, MIN_RUN - 6))
_HEX_DIGIT = re.compile(rb"[0-9A-Fa-f]")


def _decode64(raw: bytes) -> bytes | None:
    body = re.sub(rb"[\r\n=]", b"", raw).replace(b"-", b"+").replace(b"_", b"/")
    try:
        return base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_value(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """``(tag, start, stop)`` of the DER value at ``at``, if its length fits."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at:at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that fills the data, of values that fill it in turn, as key
    encodings have it: integers, or a version or algorithm and the key bits."""
    outer = _der_value(data, 0, len(data))
    if not outer or outer[0] != 0x30 or outer[2] != len(data):
        return False
    tags, sizes, at = [], [], outer[1]
    while at < outer[2]:
        value = _der_value(data, at, outer[2])
        if not value:
            return False
        if value[0] & 0x20 and value[0] != 0x30 and not 0xA0 <= value[0] <= 0xA3:
            return False
        if value[0] == 0x30:  # an algorithm: its parts fill it and an object identifier leads
            first, inner = None, value[1]
            while inner < value[2]:
                part = _der_value(data, inner, value[2])
                if not part:
                    return False
                first, inner = part[0] if first is None else first, part[2]
            if first not in (0x06, 0x02):
                return False
        tags.append(value[0])
        sizes.append(value[2] - value[1])
        at = value[2]
    integers = len(tags) in (2, 9) and set(tags) == {0x02}  # RSA public or private
    if len(tags) == 2:
        integers = integers and sizes[0] >= MIN_MODULUS and sizes[1] <= MAX_EXPONENT
    pkcs8 = tags[:3] == [0x02, 0x30, 0x04]
    public = tags == [0x30, 0x03]
    ec = tags[:2] == [0x02, 0x04] and all(0xA0 <= t <= 0xA1 for t in tags[2:])
    dsa = len(tags) == 6 and set(tags) == {0x02}
    return integers or pkcs8 or public or ec or dsa


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key blob, or a public key whose fields fill it."""
    at, texts = (len(_SSH_PRIVATE), 3) if data.startswith(_SSH_PRIVATE) else (0, 1)
    for _ in range(texts):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 > len(data) or at + 4 + size > len(data):
            return False
        first, at = data[at + 4:at + 4 + size], at + 4 + size
    if texts == 3:
        return at + 8 <= len(data)
    if not re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{3,40}", first):
        return False
    fields = 0
    while at < len(data):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return False
        at, fields = at + 4 + size, fields + 1
    return fields >= 1


def is_signed_token(raw: bytes) -> bool:
    """``header.payload.signature``: the header is a JSON object with ``alg``, the payload decodes."""
    header, payload, _ = raw.split(b".")
    head, body = _decode64(header), _decode64(payload)
    if head is None or body is None:
        return False
    try:
        value = json.loads(head)
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and isinstance(value.get("alg"), str)


def _key_kind(data: bytes | None) -> str | None:
    if data and is_der_key(data):
        return "der_key"
    return "ssh_key" if data and is_ssh_key(data) else None


def _named_sizes(body: bytes, start: int) -> list[int]:
    """How many bytes a key that starts at ``body[start]`` (base64) says that it has; several for an
    unknown kind of public key.  Only the lengths are decoded."""
    def read(at: int, n: int) -> bytes:
        first, skip = start + at // 3 * 4, at % 3
        part = body[first:first + (skip + n + 2) // 3 * 4]
        return (_decode64(part[:len(part) - (len(part) % 4 == 1)]) or b"")[skip:skip + n]

    def field(at: int) -> int | None:
        size = read(at, 4)
        end = at + 4 + int.from_bytes(size, "big")
        return end if len(size) == 4 and end <= total else None

    total = (len(body) - start) * 3 // 4
    head = read(0, 6)
    if head[:1] == b"\x30" and len(head) == 6:
        n = head[1] & 0x7F if head[1] >= 0x80 else 0
        return [2 + n + (int.from_bytes(head[2:2 + n], "big") if n else head[1])] if n <= 4 else []
    if read(0, len(_SSH_PRIVATE)) == _SSH_PRIVATE:
        at = len(_SSH_PRIVATE)
        for _ in range(3):
            if (at := field(at)) is None:
                return []
        keys, at = int.from_bytes(read(at, 4), "big"), at + 4
        for _ in range(keys + 1):  # the public keys and the private ones, which are one field
            if (at := field(at)) is None:
                return []
        return [at]
    if (at := field(0)) is None or at > 64:
        return []
    usual, ends = _SSH_FIELDS.get(read(4, at - 4)), []
    while (at := field(at)) is not None:
        ends.append(at)
        if len(ends) + 1 == usual:
            return [at, *ends[-2::-1]]
    return ends[::-1]


def _keys(raw: bytes, m: re.Match) -> Iterator[tuple[int, int, str]]:
    """The keys in a run of base64 lines: each starts at a line and ends at a line end, or at dashes of a frame."""
    lines, at = [], m.start()
    for gap in _LINE_BREAK.finditer(raw, m.start(), m.end()):
        lines.append((at, gap.start()))
        at = gap.end()
    lines.append((at, m.start() + len(m[0].rstrip(b"="))))
    body = b"".join(raw[s:e] for s, e in lines)
    ends = list(accumulate(e - s for s, e in lines))
    escaped = raw[m.start() - 1:m.start()] == b"\\" and raw[m.start():m.start() + 1] in (b"n", b"r", b"t")
    done, found = 0, False
    for i, (s, e) in enumerate(lines):
        begin = ends[i] - (e - s)
        starts = [begin, *(f.end() for f in _FRAME.finditer(body, begin, ends[i]))]
        if escaped and not i:  # the letter may belong to an escape before the run
            starts.insert(1, begin + 1)
        for start in starts:
            if start < done or body[start:start + 1] not in (b"M", b"A", b"b"):  # how sequences, lengths and the private kind begin
                continue
            for size in _named_sizes(body, start):
                stop = start + (4 * size + 2) // 3
                j = bisect_left(ends, stop)
                if stop > len(body) or (stop != ends[j] and body[stop:stop + 5] != b"-----"):
                    continue
                if kind := _key_kind(_decode64(body[start:stop])):
                    last = m.end() if stop == len(body) else lines[j][1] - (ends[j] - stop)
                    yield s + start - begin, last, kind
                    done, found = stop, True
                    break
    if not found:  # a private key whose parts do not end where they say: all the lines, else the first alone
        for stop, last in ((len(body), m.end()), (ends[0], lines[0][1] if len(lines) > 1 else m.end())):
            if kind := _key_kind(_decode64(body[:stop])):
                yield m.start(), last, kind
                return


def _wrapped_kind(body: bytes) -> str | None:
    """The kind of the key in a framed text that is itself written in base64."""
    inner = _decode64(body.rstrip(b"=")[:len(body.rstrip(b"=")) - (len(body.rstrip(b"=")) % 4 == 1)])
    for m in (m for pattern in (_BASE64, _SHORT_LINES) for m in pattern.finditer(inner or b"")):
        for _, _, kind in _keys(inner, m):
            return kind
    return None


def _hex_key(m: re.Match) -> Iterator[tuple[int, int, str]]:
    """The key at the start of a run of hex digits: a DER one ends where its length says, others fill the digits."""
    places = [d.start() for d in _HEX_DIGIT.finditer(m[0])]
    digits = bytes(m[0][p] for p in places)
    data = bytes.fromhex(digits[:len(digits) // 2 * 2].decode())
    if data[:1] == b"\x30":
        n = data[1] & 0x7F if data[1] >= 0x80 else 0
        data = data[:2 + n + (int.from_bytes(data[2:2 + n], "big") if n else data[1])] if n <= 4 else b""
    if kind := _key_kind(data):
        yield m.start(), m.start() + places[2 * len(data) - 1] + 1, kind


def find_secrets(raw: bytes) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in byte offsets of a UTF-8 text, base kinds and confirmed ones."""
    found = [(*m.span(), "assign") for m in _ASSIGN.finditer(raw) if len(m[1]) >= 12]
    found += [(*m.span(), "access") for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 18]
    found += [(*m.span(), "hex") for m in _HEX.finditer(raw)]
    if b"." in raw:
        found += [(*m.span(), "signed_token") for m in _SIGNED.finditer(raw) if is_signed_token(m[0])]
    for m in _BASE64.finditer(raw):
        found += _keys(raw, m)
        if any(mark in m[0] for mark in _WRAPPED) and (kind := _wrapped_kind(_LINE_BREAK.sub(b"", m[0]))):
            found.append((*m.span(), kind))
    for m in _SHORT_LINES.finditer(raw):
        found += _keys(raw, m)
    for m in _HEX_RUN.finditer(raw):
        found += _hex_key(m)
    return sorted(set(found), key=lambda f: (f[0], _ORDER[f[2]], f[1]))


def _in_code_points(raw: bytes, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Byte offsets to code point offsets, decoding each stretch of the text once."""
    marks, at, chars, place = sorted({p for s, e, _ in found for p in (s, e)}), 0, 0, {}
    for p in marks:
        chars += len(raw[at:p].decode("utf-8"))
        place[p], at = chars, p
    return [(place[s], place[e], k) for s, e, k in found]


def listing(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def scan_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: ``doc_id``, counts ``n_assign, n_access, n_hex``
    of the base kinds, ``base_sha256`` (digest of the base listing), ``spans``
    (the listing of all spans, ``kind:start:end`` by start and kind, code
    points, end exclusive).

    Null and empty texts have no spans; repeated rows and null ids are kept; an
    empty table gives no rows; other columns are ignored.  Confirmed spans may
    overlap base ones, which always stay.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_tm_text"))
    out = T.StructType([
        source.schema["doc_id"],
        *(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS),
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for raw in batch.column("_tm_text").cast(pa.binary()).to_pylist():
                raw = raw or b""
                found = find_secrets(raw)
                if found:
                    found = _in_code_points(raw, found)
                base = [f for f in found if f[2] in BASE_KINDS]
                for i, kind in enumerate(BASE_KINDS):
                    counts[i].append(sum(f[2] == kind for f in base))
                digests.append(hashlib.sha256(listing(base).encode()).hexdigest())
                spans.append(listing(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=[f.name for f in out])

    return source.mapInArrow(run, out)


def op6_secret_scan(spark, sf_dir):
    """All of ``documents``."""
    return scan_secrets(table(spark, sf_dir, "documents"))
