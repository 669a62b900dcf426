"""Secret scan: pattern candidates, confirmed by their inner structure.

Base patterns report assignments, access keys and long hex runs. Beyond them, base64 and hex
runs are decoded and reported only if their content parses as what it claims to be: a signed
token whose header is JSON with an algorithm, a DER structure whose nested lengths add up to a
key, an OpenSSH private key with its length-prefixed fields, or a PEM block around one of these.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from harvestline.llm.common import prepared

# Order of the kinds in listings; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "signed_token", "pem_key", "der_key", "ssh_key")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ASSIGN_WORD = re.compile(r"passw|secret|token|api_?key", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIXED_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\+[nrt])+)-----END \1-----")
BREAK = re.compile(r"\\+[nrt]|\s")
SIGNED = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
# base64 of either alphabet, with plain or escaped line ends; the places where a key can begin in it, and in hex
BASE64 = re.compile(r"[A-Za-z0-9+/_-]+(?:(?:\\+[nrt]|[\r\n])+[A-Za-z0-9+/_-]+)*={0,2}")
BEGINS = re.compile(r"(?=M[A-P][A-Za-z0-9+/_-]|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi)")
HEX_BEGINS = re.compile(r"(?=30|6f70656e7373682d6b65792d7631|2d2d2d2d2d424547494e)", re.I)
PADDING = re.compile(r"={0,2}")
TOKEN_RUN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?=\.)")
# what a PEM block holds up to its END line, and what may become its head
PEM_OPEN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----(?:[A-Za-z0-9+/=\s]|\\+[nrt])*")
PEM_HEAD = re.compile(r"-----BEGIN [A-Z0-9 ]*-{0,5}")
SSH_MAGIC = b"openssh-key-v1\0"
LEAST = 40  # characters of a base64 key, at least

Reader = Callable[[int, int], bytes]  # bytes from one offset to another, of data decoded on demand

SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
          "n_confirmed long")


def unbase64(text: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, padded or not; None if it is none."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_item(read: Reader, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of content, end) of the DER item at ``at``; None if it does not end by ``end``."""
    head = read(at, min(at + 6, end))
    if len(head) < 2:
        return None
    length, start = head[1], at + 2
    if length & 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or len(head) < 2 + n:
            return None
        length, start = int.from_bytes(head[2:2 + n], "big"), start + n
    return (head[0], start, start + length) if start + length <= end else None


def der_items(read: Reader, at: int, end: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Consecutive DER items that fill the place from ``at`` to ``end`` exactly, else None. More
    items than ``most`` are not looked for and count as None."""
    items = []
    while at < end:
        item = der_item(read, at, end)
        if item is None or len(items) == most:
            return None
        items.append(item)
        at = item[2]
    return items


def is_der_key(read: Reader, size: int) -> bool:
    """RSA or DSA integers, an EC private key, or a PKCS#8 wrapper with one of them inside. Heads
    are read where they are, so that what a head claims to hold costs nothing by itself."""
    outer = der_item(read, 0, size)
    if outer is None or outer[0] != 0x30 or outer[2] != size:
        return False
    first = der_item(read, outer[1], size)
    if first is None or first[0] != 0x02 or first[2] - first[1] != 1:
        return False
    second = der_item(read, first[2], size)
    third = der_item(read, second[2], size) if second else None
    if third is None:
        return False
    if second[0] == 0x02:
        items = der_items(read, outer[1], size, 9)
        return items is not None and len(items) in (6, 9) and {tag for tag, _, _ in items} == {0x02}
    if second[0] == 0x04:
        fits = read(first[1], first[2]) == b"\x01" and 16 <= second[2] - second[1] <= 80
    elif second[0] == 0x30 and third[0] == 0x04:
        algorithm = der_item(read, second[1], second[2])
        fits = (algorithm is not None and algorithm[0] == 0x06 and der_items(read, second[1], second[2]) is not None
                and der_items(read, third[1], third[2]) is not None)
    else:
        fits = False
    return fits and der_items(read, outer[1], size) is not None


def ssh_length(read: Reader, size: int) -> int:
    """Bytes of the OpenSSH private key that the data begin with, to the end of its private part,
    or 0: the magic text, then cipher, derivation and options as length-prefixed strings, a key
    count, and the public keys."""
    number = lambda at: int.from_bytes(read(at, at + 4), "big")
    at = len(SSH_MAGIC)
    if read(0, at) != SSH_MAGIC:
        return 0
    for _ in range(3):
        if at + 4 > size:
            return 0
        at += 4 + number(at)
    if at + 8 > size or not 1 <= (count := number(at)) <= 16:
        return 0
    at += 4
    if at + 4 + number(at) > size:
        return 0
    for _ in range(count + 1):
        if at >= size:
            return size
        at += 4 + number(at)
    return min(at, size)


def der_length(head: bytes | None) -> int:
    """Bytes of the DER sequence with this head if an integer comes first in it, else 0."""
    if not head or len(head) < 8 or head[0] != 0x30:
        return 0
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if head[1] == 0x80 or n > 4 or head[2 + n] != 0x02:
        return 0
    return 2 + n + (int.from_bytes(head[2:2 + n], "big") if n else head[1])


def pem_length(read: Reader, size: int) -> int:
    """Bytes of the PEM key that the data begin with, or 0. Data are read up to the line that ends
    the body, which another head ends as well: heads do not read each other's text again."""
    n = 256
    while True:
        n = min(n, size)
        text = read(0, n).decode("latin-1")
        m = PEM_OPEN.match(text)
        if m:
            unfinished = len(text[m.end():].lstrip("\\")) < len(m[1]) + len("-----END -----")
        else:
            unfinished = bool(PEM_HEAD.fullmatch(text))
        if not unfinished or n == size:
            m = PEM.match(text)
            return m.end() if m and is_pem_body(m[2]) else 0
        n *= 2


def is_pem_body(body: str) -> bool:
    data = unbase64(BREAK.sub("", body))
    if not data:
        return False
    read = lambda a, b: data[a:b]
    return is_der_key(read, len(data)) or ssh_length(read, len(data)) > 0


def key_at(read: Reader, size: int) -> tuple[str, int] | None:
    """Kind and bytes of the key that the data begin with."""
    head = read(0, min(8, size))
    if head[:1] == b"\x30":
        n = der_length(head)
        return ("der_key", n) if 0 < n <= size and is_der_key(read, n) else None
    kind, n = ("pem_key", pem_length(read, size)) if head[:1] == b"-" else ("ssh_key", ssh_length(read, size))
    return (kind, n) if n else None


def base64_keys(text: str) -> list[tuple[int, int, str]]:
    """Keys in base64, from every place where one can begin. A run of digits is cleared of line ends
    once; a key is decoded only where its heads and lengths are."""
    found, after, end = [], 0, -1
    for m in BEGINS.finditer(text):
        start = m.start()
        if start < after:
            continue
        if start >= end:  # another run
            run = BASE64.match(text, start)
            first, end = start, run.end()
            pieces, gaps, clean = [], [], 0  # a gap: digits before it, characters of line ends so far
            at, lost = start, 0
            for gap in BREAK.finditer(text, start, end):
                pieces.append(text[at:gap.start()])
                clean += gap.start() - at
                lost += gap.end() - gap.start()
                gaps.append((clean, lost))
                at = gap.end()
            body = ("".join([*pieces, text[at:end]])).rstrip("=").replace("-", "+").replace("_", "/")
            edges, losses = [g[0] for g in gaps], [0, *(g[1] for g in gaps)]
            starts = [g[0] + g[1] for g in gaps]  # where the digits after a gap begin, from ``first``
        # digits before ``start``: its distance less the line ends between
        here = start - first - losses[bisect.bisect_right(starts, start - first)]
        left = len(body) - here
        size = left * 3 // 4 if left % 4 != 1 else (left - 1) * 3 // 4

        def read(a: int, b: int) -> bytes:
            b = min(b, size)
            if a >= b:
                return b""
            low, high = a // 3 * 4, min(-(-b // 3) * 4, left - (left % 4 == 1))
            part = body[here + low:here + high]
            return binascii.a2b_base64(part + "=" * (-len(part) % 4))[a % 3:a % 3 + b - a]

        key = key_at(read, size) if left >= LEAST else None
        need = -(-key[1] * 4 // 3) if key else 0
        if need < LEAST:
            continue
        last = here + need
        after = first + last + losses[bisect.bisect_left(edges, last)]
        after += len(PADDING.match(text, after)[0]) if last == len(body) else 0
        found.append((start, after, key[0]))
    return found


def hex_keys(text: str) -> list[tuple[int, int, str]]:
    """Keys in hex digits of either case, from every place where one can begin."""
    found = []
    for run in MIXED_HEX.finditer(text):
        digits, after = run[0], 0
        for m in HEX_BEGINS.finditer(digits):
            at = m.start()
            size = (len(digits) - at) // 2
            if at < after or size < 32:
                continue
            key = key_at(lambda a, b: bytes.fromhex(digits[at + 2 * a:at + 2 * min(b, size)]), size)
            if key and (key[0] != "der_key" or key[1] >= 32):
                after = at + 2 * key[1]
                found.append((run.start() + at, run.start() + after, key[0]))
    return found


def signed_tokens(text: str) -> Iterator[tuple[int, int, str]]:
    """Signed tokens. What follows a run of token characters is the same for every place in it
    where a header can begin, so only the first is tried."""
    after = 0
    for run in TOKEN_RUN.finditer(text):
        if run.start() < after:
            continue
        m = SIGNED.match(text, run.start() + run[0].find("eyJ")) if "eyJ" in run[0] else None
        if m:
            after = m.end()
            if is_signed_token(m[1], m[2]):
                yield m.start(), m.end(), "signed_token"


def is_signed_token(header: str, payload: str) -> bool:
    decoded = unbase64(header)
    if decoded is None or unbase64(payload) is None:
        return False
    try:
        fields = json.loads(decoded)
    except (ValueError, RecursionError):
        return False
    return isinstance(fields, dict) and isinstance(fields.get("alg"), str)


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all findings, by start and then by kind as listed. Positions are
    code points, end exclusive."""
    found: list[tuple[int, int, str]] = []
    if ASSIGN_WORD.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    inside: list[tuple[int, int]] = []
    if "eyJ" in text:
        found += signed_tokens(text)
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            if is_pem_body(m[2]):
                found.append((m.start(), m.end(), "pem_key"))
                inside.append(m.span())
    starts = [a for a, _ in inside]  # blocks do not overlap
    for key in [*base64_keys(text), *hex_keys(text)]:
        block = bisect.bisect_right(starts, key[0]) - 1
        if block < 0 or key[0] >= inside[block][1]:
            found.append(key)
    order = {kind: k for k, kind in enumerate(KINDS)}
    return sorted(set(found), key=lambda s: (s[0], order[s[2]], s[1]))


def listing(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with its findings. Null and empty texts have
    none; a null doc_id stays null; repeated rows are scanned each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed")}
            for text in batch.column(1):
                spans = find_spans(text.as_py() or "")
                base = [s for s in spans if s[2] in BASE]
                for kind in BASE:
                    out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(listing(base).encode()).hexdigest())
                out["spans"].append(listing(spans))
                out["n_confirmed"].append(len(spans) - len(base))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *[pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in out.items()]],
                names=["doc_id", *out])

    return prepared(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with every finding replaced; overlapping findings become one mark."""
    out, at = [], 0
    for start, end, _ in find_spans(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with findings replaced in ``text`` (null stays null); all other columns are kept,
    ``n_chars`` follows the new text where it exists."""
    schema = docs.schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redact(t, mark) for t in batch.column(names.index("text")).to_pylist()]
            arrays = list(batch.columns)
            at = names.index("text")
            if "n_chars" in names:
                k = names.index("n_chars")
                old = batch.column(at).to_pylist()
                counts = [c if new == t else len(new) for c, t, new in zip(batch.column(k).to_pylist(), old, texts)]
                arrays[k] = pa.array(counts, batch.column(k).type)
            arrays[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return prepared(docs, *names).mapInArrow(run, schema)
