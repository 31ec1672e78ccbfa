"""Secret scans with structural confirmation.

Base kinds are patterns: ``assign`` (a secret's name and value), ``access`` (access key ids), ``hex`` (long hex
runs). Runs of base64 or hex letters are candidates for more, and are reported only if what they encode has the
structure of a secret:

``key``: a private key. The run's bytes are read in place, tag by tag: PKCS #1, PKCS #8, encrypted PKCS #8, SEC 1 and
DSA keys, whose nested lengths must add up, or an OpenSSH key, whose fields must fill their lengths. Certificates
and public keys have other structures. Lines of a wrapped run and its armour belong to it.

``token``: a signed or encrypted token of dotted parts, whose header is a JSON object with an algorithm, whose payload
is a JSON object, and whose signature has the length that the algorithm gives.

``encoded``: a run that decodes to text in which one of the other kinds is found, encoded again or not.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import table

#: The base kinds, and the least length of what they match (``assign``: of the value).
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: In the order of spans that start together.
KINDS = [*BASE, "key", "token", "encoded"]
#: The hex kind again with its least length, so that short runs are not taken up one by one.
_HEX = re.compile(r"[0-9a-f]{24,}+")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{24,}+={0,2}+")
#: A run whose lines were wrapped: whole lines of one run each, also with the line feed written as an escape.
_WRAPPED = re.compile(r"[A-Za-z0-9+/]{32,}+(?:(?:\\r)?+(?:\\n|\r?+\n)[\x20\t]*+[A-Za-z0-9+/]++)*+={0,2}+")
_BREAK = re.compile(r"(?:\\r)?+(?:\\n|\r?+\n)[\x20\t]*+")
_HEXRUN = re.compile(r"(?:[0-9A-Fa-f]{2}){24,}+")
_OPENING = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:(?:\\r)?+(?:\\n|\r?+\n)|\x20)*+$")
_CLOSING = re.compile(r"(?:(?:\\r)?+(?:\\n|\r?+\n)|\x20)*+-----END [A-Z0-9 ]*PRIVATE KEY-----")
_ARMOUR = 120
_DOTTED = re.compile(r"[A-Za-z0-9_-]{12,}+(?:\.[A-Za-z0-9_-]*+){2,4}+")
#: Where a DER sequence may start in base64, and the start of an OpenSSH key.
_DER64 = re.compile(r"(?=M[A-P])")
_DERHEX = re.compile(r"(?=30)")
_OPENSSH = b"openssh-key-v1\0"
_OPENSSH64 = "b3BlbnNzaC1rZXktdjEA"
_TEXT = re.compile(r"[\t\n\r\x20-\x7E -￿]*")
#: Bytes of a signature by algorithm; RSA signatures have at least 128.
SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EDDSA": 64}


class Encoded:
    """Bytes written in base64 or hex from a place of a string on, read where they are asked for."""

    def __init__(self, letters: str, start: int, hexed: bool = False):
        self.letters, self.start, self.hexed = letters, start, hexed
        room = len(letters if hexed else letters.rstrip("=")) - start
        self.size = room // 2 if hexed else room * 3 // 4

    def read(self, at: int, n: int) -> bytes:
        if self.hexed:
            end = self.start + 2 * min(at + n, self.size)
            return bytes.fromhex(self.letters[self.start + 2 * at : end])
        first = at // 3
        piece = self.letters[self.start + 4 * first : self.start + 4 * ((at + n + 2) // 3)]
        return _decoded(piece)[at - 3 * first : at - 3 * first + n]

    def end(self, at: int) -> int:
        """The place in the string behind the letters of the first ``at`` bytes."""
        return self.start + (2 * at if self.hexed else -(-at * 4 // 3))


def _decoded(piece: str) -> bytes:
    """The bytes of base64 letters of either alphabet; none if they cannot be decoded."""
    piece = piece.rstrip("=")
    try:
        return base64.b64decode(piece.replace("-", "+").replace("_", "/") + "=" * (-len(piece) % 4))
    except (binascii.Error, ValueError):
        return b""


def _tlv(source: Encoded, at: int) -> tuple[int, int, int] | None:
    """(tag, first content byte, end) of a DER element, with the least number of length bytes; None if it does not
    fit in what is there."""
    head = source.read(at, 6)
    if len(head) < 2:
        return None
    length, used = head[1], 2
    if length >= 128:
        used += length - 128
        if not 2 < used <= 6 or len(head) < used:
            return None
        length = int.from_bytes(head[2:used])
        if length < 128 or (used > 3 and length < 1 << 8 * (used - 3)):
            return None
    end = at + used + length
    return (head[0], at + used, end) if end <= source.size else None


def _elements(source: Encoded, at: int, end: int, most: int = 12) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``at .. end``; None if they do not, or if there are more than a key has."""
    out = []
    while at < end and len(out) < most:
        found = _tlv(source, at)
        if found is None or found[2] > end:
            return None
        out.append(found)
        at = found[2]
    return out if at == end else None


_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def _der_key(source: Encoded) -> int | None:
    """The bytes of the private key that the source starts with; None if there is none."""
    outer = _tlv(source, 0)
    if outer is None or outer[0] != _SEQUENCE:
        return None
    inner = _elements(source, outer[1], outer[2])
    if not inner:
        return None
    tags = [tag for tag, _, _ in inner]

    def number(i: int) -> int:
        return int.from_bytes(source.read(inner[i][1], min(inner[i][2] - inner[i][1], 4)))

    def algorithm(i: int) -> bool:
        parts = _elements(source, inner[i][1], inner[i][2])
        return tags[i] == _SEQUENCE and bool(parts) and parts[0][0] == _OID

    size = [end - start for _, start, end in inner]
    if tags[0] == _INTEGER and size[0] == 1 and number(0) in (0, 1):
        if len(inner) in (9, 10) and tags[:9] == [_INTEGER] * 9 and min(size[1], size[3]) >= 32:
            return outer[2]  # PKCS #1: modulus, exponents, primes and their remainders
        if number(0) == 0 and len(inner) == 6 and tags == [_INTEGER] * 6 and min(size[1], size[4]) >= 32:
            return outer[2]  # DSA
        if number(0) == 1 and tags[1:2] == [_OCTETS] and size[1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:]):
            return outer[2]  # SEC 1
        if len(inner) >= 3 and algorithm(1) and tags[2] == _OCTETS and size[2] >= 16 and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:]):
            return outer[2]  # PKCS #8
    if len(inner) == 2 and algorithm(0) and tags[1] == _OCTETS and size[1] >= 32 and size[1] % 8 == 0:
        return outer[2]  # encrypted PKCS #8
    return None


def _openssh_key(source: Encoded) -> int | None:
    """The bytes of the OpenSSH key that the source starts with; None if its fields do not fit."""
    at = len(_OPENSSH)
    if source.read(0, at) != _OPENSSH:
        return None

    def field(at: int) -> int | None:
        head = source.read(at, 4)
        end = at + 4 + int.from_bytes(head)
        return end if len(head) == 4 and end <= source.size else None

    for _ in range(3):  # cipher, key derivation, its options
        at = field(at)
        if at is None:
            return None
    keys = int.from_bytes(source.read(at, 4))
    at += 4
    for _ in range(min(keys, 16) + 1):  # public keys, the private part
        at = field(at)
        if at is None:
            return None
    return at if keys else None


def _joined(text: str, match: re.Match) -> tuple[str, list[tuple[int, int]]]:
    """The letters of a run without its line breaks, and (place in them, place in the text) of each line."""
    run = match.group()
    breaks = list(_BREAK.finditer(run))
    if not breaks:
        return run, [(0, match.start())]
    starts = [0, *(b.end() for b in breaks)]
    lines = [run[s:e] for s, e in zip(starts, [*(b.start() for b in breaks), len(run)])]
    before = [0, *accumulate(map(len, lines))]
    return "".join(lines), [(p, match.start() + s) for p, s in zip(before, starts)]


def _place(lines: list[tuple[int, int]], at: int, behind: bool) -> int:
    """Where a letter of a joined run stands in the text; ``behind``: where the letter before ``at`` ends."""
    for before, start in reversed(lines):
        if before < at or (before == at and not behind):
            return start + at - before
    return lines[0][1] + at


def _keys_in(letters: str, hexed: bool) -> Iterator[tuple[int, int]]:
    """(start, end) of the private keys in a run, from left to right, none inside another."""
    starts = [m.start() for m in (_DERHEX if hexed else _DER64).finditer(letters)]
    magic = _OPENSSH.hex() if hexed else _OPENSSH64
    low = letters.lower() if hexed else letters
    at = low.find(magic)
    opens = set()
    while at >= 0:
        opens.add(at)
        at = low.find(magic, at + 1)
    reached = 0
    for start in sorted({*starts, *opens}):
        if start < reached:
            continue
        source = Encoded(letters, start, hexed)
        size = (_openssh_key if start in opens else _der_key)(source)
        if size:
            reached = source.end(size)
            if not hexed:
                while reached < len(letters) and letters[reached] == "=":
                    reached += 1
            yield start, reached


def _keys(text: str) -> Iterator[tuple[int, int]]:
    for pattern, hexed in ((_WRAPPED, False), (_RUN, False), (_HEXRUN, True)):
        for match in pattern.finditer(text):
            letters, lines = _joined(text, match) if pattern is _WRAPPED else (match.group(), [(0, match.start())])
            for start, end in _keys_in(letters, hexed):
                a, b = _place(lines, start, False), _place(lines, end, True)
                opening = _OPENING.search(text[max(a - _ARMOUR, 0) : a])
                closing = _CLOSING.match(text, b)
                yield (a - len(opening.group()) if opening else a), (closing.end() if closing else b)


def _json_object(data: bytes) -> dict | None:
    try:
        value = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _header_in(segment: str) -> tuple[int, dict] | None:
    """(start, header) of the first JSON object with an algorithm that the letters from ``start`` on are. The
    letters are decoded once for each of the four places that a group of letters may begin at."""
    decoder, streams = json.JSONDecoder(), {}
    for match in re.finditer(r"e[w-z0-9_-]", segment):
        start = match.start()
        if not re.match(rb"\{\s*\"", _decoded(segment[start : start + 12])):
            continue
        phase = start % 4
        if phase not in streams:
            streams[phase] = _decoded(segment[phase : len(segment) - (len(segment) - phase) % 4]) + _decoded(
                segment[len(segment) - (len(segment) - phase) % 4 :]
            )
        text = streams[phase].decode("latin-1")
        try:
            value, end = decoder.raw_decode(text, (start - phase) // 4 * 3)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict) and isinstance(value.get("alg"), str) and not text[end:].strip():
            return start, value
    return None


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    for match in _DOTTED.finditer(text):
        parts = match.group().split(".")
        found = _header_in(parts[0])
        if found is None:
            continue
        start, header = match.start() + found[0], found[1]
        algorithm = header["alg"].upper()
        end = start + len(parts[0]) - found[0]
        if len(parts) == 5 and isinstance(header.get("enc"), str):
            if all(_decoded(p) for p in parts[2:]):
                yield start, match.end()
            continue
        signature = _decoded(parts[2])
        fits = len(signature) == SIGNATURES[algorithm] if algorithm in SIGNATURES else len(signature) >= 128
        if fits and _json_object(_decoded(parts[1])) is not None:
            yield start, end + len(parts[1]) + len(parts[2]) + 2


def _as_text(data: bytes) -> str | None:
    """Decoded bytes as text, if they are printable text."""
    if len(data) < 12:
        return None
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if _TEXT.fullmatch(text) else None


def _encoded(text: str) -> Iterator[tuple[int, int]]:
    for pattern, hexed in ((_WRAPPED, False), (_RUN, False), (_HEXRUN, True)):
        for match in pattern.finditer(text):
            letters = _joined(text, match)[0] if pattern is _WRAPPED else match.group()
            # Most runs are random: their first bytes tell that they hold no text.
            if _as_text_start(letters[:48], hexed):
                inner = _as_text(bytes.fromhex(letters) if hexed else _decoded(letters))
                if inner is not None and any(kind != "hex" for kind, _, _ in spans_of(inner)):
                    yield match.start(), match.end()


def _as_text_start(letters: str, hexed: bool) -> bool:
    data = bytes.fromhex(letters) if hexed else _decoded(letters)
    return bool(data) and bool(_TEXT.fullmatch(data.decode("utf-8", "ignore")))


def _apart(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans from left to right, the longer first where two start together, without those that overlap one taken."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by kind."""
    assign, group, least = BASE["assign"]
    out = [("assign", *m.span()) for m in assign.finditer(text) if len(m.group(group)) >= least]
    access, _, least = BASE["access"]
    out += [("access", *m.span()) for m in access.finditer(text) if len(m.group()) >= least]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all kinds in code points, by start, then in the order of ``KINDS``."""
    if not text:
        return []
    keys = _apart(_keys(text))
    out = base_spans(text)
    out += [("key", *s) for s in keys]
    out += [("token", *s) for s in _apart(_tokens(text))]
    inside = [s for s in _apart(_encoded(text)) if not any(a < s[1] and s[0] < b for a, b in keys)]
    out += [("encoded", *s) for s in inside]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with ``into``, the array of (kind, start, stop) of what is found in the whole text, by start and kind;
    empty for a null or empty text. Rows are scanned one by one, so repeated ones have equal results; other columns
    pass through, and one named like ``into`` is replaced. An empty table gives an empty table."""

    @F.arrow_udf("array<struct<kind:string,start:int,stop:int>>")
    def scan(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        found = [[{"kind": k, "start": s, "stop": e} for k, s, e in spans_of(t.as_py())] for t in column]
        return pa.array(found, kind)

    return docs.withColumn(into, scan(F.col(text)))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each stretch of the text that found spans cover replaced by ``mark``; a null text stays null."""

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        out = []
        for value in column:
            whole = value.as_py()
            parts, reached = [], 0
            for _, start, end in spans_of(whole):
                if end <= reached:
                    continue
                parts += [whole[reached:start], mark] if start >= reached else []
                reached = end
            out.append(None if whole is None else "".join([*parts, whole[reached:]]))
        return pa.array(out, pa.string())

    return docs.withColumn(text, clean(F.col(text)))


def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every whole document."""
    found = secrets(table(spark, folder, "documents").select("doc_id", "text"))
    listed = F.col("secrets")

    def count(kind: str):
        return F.size(F.filter(listed, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    base = F.filter(listed, lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(kind) for kind in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(listed).alias("spans")
    )


QUERIES = {"op13_secret_scan": (op13_secret_scan, None)}
