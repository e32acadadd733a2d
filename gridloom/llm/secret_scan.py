"""Secret scans with structural confirmation.

Base spans are assignments, access keys and hexadecimal runs (``BASE``). Longer
base64 and hexadecimal runs are candidates for more: they are decoded and only
reported when what comes out parses as the structure it claims to be. A signed
token needs three dot-separated parts whose first decodes to a JSON object with
an ``alg``; key material needs nested DER lengths that fill the whole body
(``der``), the length-prefixed fields of a binary OpenSSH key (``openssh``), or
a PEM frame around either (``pem``).

Texts are scanned row by row inside tasks, whole and independently, so nothing
is shuffled; bytes are classed for a whole batch at once and only texts with a
marker meet the patterns.

Null or empty texts have no spans. Spans of one kind never overlap; spans of
different kinds may. Repeated rows stay rows. An empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.textnum import LOWER, slices, word_spans

# The patterns of the contract, and the kinds in order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "jwt", "pem", "openssh", "der")

# begins where a run begins and gives nothing back, so that a very long run is read once
PARTS = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*KEY)-----\s*+((?:[A-Za-z][A-Za-z0-9-]*: [^\n]*+\n)*+)([A-Za-z0-9+/=\s]+)-----END \1-----")
BODY = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}|[0-9A-Fa-f]{40,}")
SAFE = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{40,}+={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{20,}+\r?\n[\x20\t]*+)+[A-Za-z0-9+/_-]++={0,2}")
SPACE = re.compile(r"[\x20\t\r\n]*+")
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Beginnings of a binary OpenSSH key and of a PEM frame in base64.
HEADS = ("b3BlbnNzaC1rZXkt", "LS0tLS1CRUdJTi")
OPENSSH = b"openssh-key-v1\x00"
#: No encoding of a key has more values on its first level (an RSA key with more than two primes has ten).
VALUES = 16
_PLAIN = str.maketrans("-_", "+/")

_HEXBYTE = np.zeros(256, bool)
_HEXBYTE[48:58] = _HEXBYTE[97:103] = True
_CODED = np.zeros(256, bool)
_CODED[48:58] = _CODED[65:91] = _CODED[97:123] = True
_CODED[[43, 45, 46, 47, 95]] = True
_MARKS = (b"passw", b"secret", b"token", b"apikey", b"api_key", b"akia", b"-----begin")


def _length(raw: bytes, at: int) -> tuple[int, int] | None:
    """(content start, content end) of the DER value whose tag is at ``at``."""
    if at + 2 > len(raw):
        return None
    n, start = raw[at + 1], at + 2
    if n >= 0x80:
        more = n & 0x7F
        if not 1 <= more <= 4 or start + more > len(raw):
            return None
        n, start = int.from_bytes(raw[start : start + more]), start + more
        if n < 0x80:
            return None
    return (start, start + n) if start + n <= len(raw) else None


def der_end(raw: bytes, at: int = 0) -> int | None:
    """End of the key that begins at ``at``: a SEQUENCE of 2 to ``VALUES`` values, one an INTEGER, BIT or OCTET STRING."""
    outer = _length(raw, at) if raw[at : at + 1] == b"\x30" else None
    if outer is None:
        return None
    at, tags = outer[0], []
    while at < outer[1]:
        inner = _length(raw, at)
        if inner is None or inner[1] > outer[1] or len(tags) == VALUES:
            return None
        tags.append(raw[at])
        at = inner[1]
    return outer[1] if len(tags) >= 2 and any(t in (2, 3, 4) for t in tags) else None


def is_der_key(raw: bytes) -> bool:
    return bool(raw) and der_end(raw) == len(raw)


def openssh_fields(raw: bytes, at: int = 0) -> tuple[bytes, int, int] | None:
    """(cipher, place after the head, number of keys) of a binary OpenSSH key: the magic, then the
    length-prefixed cipher, KDF and options, and a count of keys."""
    if not raw.startswith(OPENSSH, at):
        return None
    at += len(OPENSSH)
    cipher = raw[at + 4 : at + 4 + min(64, int.from_bytes(raw[at : at + 4]))]
    for _ in range(3):
        at += 4 + int.from_bytes(raw[at : at + 4])
        if at + 4 > len(raw):
            return None
    n = int.from_bytes(raw[at : at + 4])
    return (cipher, at + 4, n) if n >= 1 else None


def openssh_end(raw: bytes, at: int = 0) -> int | None:
    """End of the OpenSSH key at ``at`` by the lengths of its public parts, its private part and that one's tag."""
    fields = openssh_fields(raw, at)
    if fields is None:
        return None
    cipher, at, n = fields
    for _ in range(n + 1):
        if at + 4 > len(raw):
            return None
        at += 4 + int.from_bytes(raw[at : at + 4])
    # ciphers that vouch for their text put 16 more bytes after it
    at += 16 if cipher.startswith((b"aes128-gcm", b"aes256-gcm", b"chacha20-poly1305")) else 0
    return at if at <= len(raw) else None


def is_openssh_key(raw: bytes) -> bool:
    return openssh_fields(raw) is not None


def decoded(body: str) -> list[bytes]:
    out = []
    if re.fullmatch("[0-9A-Fa-f]+", body) and len(body) % 2 == 0:
        out.append(bytes.fromhex(body))
    try:
        out.append(base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if "-" in body or "_" in body else None, validate=True))
    except (binascii.Error, ValueError):
        pass
    return out


def is_pem(text: str) -> bool:
    """A frame around key material, or around whole cipher blocks where its header lines say so."""
    m = PEM.search(text)
    return m is not None and _framed(m)


def _framed(m: re.Match[str]) -> bool:
    body = "".join(m[3].split())
    if "ENCRYPTED" in m[2] and "DEK-Info:" in m[2]:
        return any(raw and len(raw) % 8 == 0 for raw in decoded(body))
    return _key_kind(body) in ("openssh", "der")


def _key_kind(body: str) -> str | None:
    for raw in decoded(body):
        if is_openssh_key(raw):
            return "openssh"
        if is_der_key(raw):
            return "der"
        if raw.lstrip().startswith(b"-----BEGIN") and is_pem(raw.decode("latin-1")):
            return "pem"
    return None


class _Block:
    """Lines of base64 in a row, decoded once for each of the four places in a group of characters a key may begin at."""

    def __init__(self, m: re.Match[str]) -> None:
        lines = [(x.start(), x[0].rstrip("=")) for x in LINE.finditer(m.string, m.start(), m.end())]
        self.starts = [a for a, _ in lines]
        self.flat = "".join(x for _, x in lines).translate(_PLAIN)
        #: characters before each line, and all of them
        self.before = [0]
        for _, x in lines:
            self.before.append(self.before[-1] + len(x))
        self.end = m.end()
        self._bytes: dict[int, bytes] = {}
        self._frames: dict[int, dict[int, int]] = {}

    def raw(self, phase: int) -> bytes:
        if phase not in self._bytes:
            body = self.flat[phase:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            self._bytes[phase] = base64.b64decode(body + "=" * (-len(body) % 4))
        return self._bytes[phase]

    def frames(self, phase: int) -> dict[int, int]:
        """End of each whole PEM frame, white space after it included, by its beginning."""
        if phase not in self._frames:
            text = self.raw(phase).decode("latin-1")
            found = [x for x in PEM.finditer(text) if _framed(x)]
            self._frames[phase] = {x.start(): SPACE.match(text, x.end()).end() for x in found}
        return self._frames[phase]

    def place(self, phase: int, upto: int) -> tuple[int, bool]:
        """(place in the text after the first ``upto`` bytes, whether a line ends there)."""
        c = phase + upto // 3 * 4 + (0, 2, 3)[upto % 3]
        j = bisect_left(self.before, c, 1) - 1
        last = c == self.before[j + 1]
        return (self.end if last and j == len(self.starts) - 1 else self.starts[j] + c - self.before[j]), last


def _wrapped(m: re.Match[str]) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of keys in base64 over several lines.

    A key begins with a line and ends where its own lengths or its frame end; a
    DER key must end with a line too. An OpenSSH key whose head is right but
    whose later lengths lead nowhere or into the next key (it is cut off)
    reaches to the next line that begins one, or to the last line.
    """
    block, out, done = _Block(m), [], 0
    heads = [i for i in range(len(block.starts)) if block.flat.startswith(("M", *HEADS), block.before[i])]
    texts = [i for i in heads if block.flat[block.before[i]] != "M"]
    for i in heads:
        start, at = block.starts[i], block.before[i]
        if start < done:
            continue
        phase, first, end = at % 4, at // 4 * 3, None
        raw = block.raw(phase)
        if block.flat[at] == "M":
            kind, stop = "der", der_end(raw, first)
            if stop is not None:
                place, last = block.place(phase, stop)
                end = place if last else None
        elif block.flat.startswith(HEADS[0], at):
            kind, stop = "openssh", openssh_end(raw, first)
            if openssh_fields(raw, first):
                after = bisect_right(texts, i)
                nxt = texts[after] if after < len(texts) else len(block.starts)
                end = block.end if nxt == len(block.starts) else block.starts[nxt - 1] + block.before[nxt] - block.before[nxt - 1]
                end = end if stop is None else min(end, block.place(phase, stop)[0])
        else:
            kind, stop = "pem", block.frames(phase).get(first)
            if stop is not None:
                end = block.place(phase, stop)[0]
        # one line alone is a candidate of the plain patterns
        if end is not None and (i + 1 == len(block.starts) or end > block.starts[i + 1]):
            out.append((start, KINDS.index(kind), end))
            done = end
    return out


def _tokens(m: re.Match[str]) -> list[tuple[int, int, int]]:
    """Signed tokens from any of the dot-separated parts of ``m`` on."""
    parts, out, i, at = m[0].split("."), [], 0, m.start()
    while i + 2 < len(parts):
        size = [len(p) for p in parts[i : i + 3]]
        if size[0] >= 8 and size[1] >= 2 and size[2] >= 8 and _signed(parts[i]):
            out.append((at, 3, at + sum(size) + 2))
            at += sum(size) + 3
            i += 3
        else:
            at += size[0] + 1
            i += 1
    return out


def _signed(token: str) -> bool:
    for raw in decoded(token.split(".")[0]):
        try:
            head = json.loads(raw)
        except (ValueError, RecursionError):
            continue
        if isinstance(head, dict) and isinstance(head.get("alg"), str):
            return True
    return False


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of kind, end) of all spans in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in PARTS.finditer(text):
        found += _tokens(m)
    frames = [(m.start(), 4, m.end()) for m in PEM.finditer(text) if _framed(m)]
    keys = set(frames)
    for pattern in (BODY, SAFE):
        for m in pattern.finditer(text):
            kind = _key_kind(m[0])
            if kind:
                keys.add((m.start(), KINDS.index(kind), m.end()))
    begins = [a for a, _, _ in frames]
    for m in WRAPPED.finditer(text):
        for x in _wrapped(m):
            at = bisect_right(begins, x[0]) - 1
            if at < 0 or x[2] > frames[at][2]:
                keys.add(x)
    # of keys of one kind that overlap, the first and longest
    done = dict.fromkeys(range(len(KINDS)), 0)
    for a, k, b in sorted(keys, key=lambda s: (s[0], -s[2])):
        if a >= done[k]:
            found.append((a, k, b))
            done[k] = b
    return sorted(found)


def _spelled(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _worth(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold a span: a marker, 16 hexadecimal or 19 coded bytes in a row."""
    out = np.zeros(len(offsets) - 1, bool)
    for table, least in ((_HEXBYTE, 16), (_CODED, 19)):
        # runs end with their row, so that a row wholly of such bytes is seen whatever its neighbours are
        starts, ends, rows = word_spans(data, offsets, table)
        out[rows[ends - starts >= least]] = True
    raw = LOWER[data].tobytes()
    for mark in _MARKS:
        at = raw.find(mark)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            out[row] = True
            at = raw.find(mark, int(offsets[row + 1]))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_added", "base_sha256", "spans"]
    for batch in batches:
        texts = batch.column("text")
        out = [[0, 0, 0, 0, nothing, ""] for _ in range(len(texts))]
        for at, data, offsets in slices(texts):
            for i in (np.flatnonzero(_worth(data, offsets)) + at).tolist():
                spans = find_spans(texts[i].as_py() or "")
                base = [s for s in spans if s[1] < 3]
                counts = [sum(s[1] == k for s in base) for k in range(3)]
                out[i] = [*counts, len(spans) - len(base), hashlib.sha256(_spelled(base).encode()).hexdigest(), _spelled(spans)]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        columns = [pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = None
    for batch in batches:
        texts = batch.column("text")
        changed: dict[int, str] = {}
        for at, data, offsets in slices(texts):
            for i in (np.flatnonzero(_worth(data, offsets)) + at).tolist():
                text = texts[i].as_py() or ""
                out, done = [], 0
                for a, k, b in find_spans(text):
                    if a >= done:
                        out += [text[done:a], f"<{KINDS[k]}>"]
                    done = max(done, b)
                if out:
                    changed[i] = "".join([*out, text[done:]])
        place = batch.schema.get_field_index("text")
        if changed:
            keep = np.ones(len(texts), bool)
            keep[list(changed)] = False
            new = pa.array([changed.get(i) for i in range(len(texts))], texts.type)
            texts = pa.compute.if_else(pa.array(keep), texts, new)
        yield batch.set_column(place, "text", texts)


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_added, base_sha256, spans) for every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_added long, base_sha256 string, spans string"
    )


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets.

    ``n_chars`` follows the text; other columns are kept.
    """
    out = docs.mapInArrow(_mask, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
