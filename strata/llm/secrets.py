"""Secrets, also inside encoded layers.

A worklist holds the text and every layer decoded from it. A layer is scanned by all
rules; with its URL or Unicode escapes or character references decoded it gives a further
layer, and so does each of its base64 or hexadecimal runs (which may be compressed), until
none is left. A layer whose text was seen before
at the same place of the original is not scanned again, so a text that decodes to itself
ends and each occurrence of a repeated run has its spans. Escapes within escapes are
decoded a layer at a time up to DEEP layers, and from there to the end in one step (kind
deep), so a tower of them takes time linear in its length. Each layer knows, for each of
its characters, which part of the original text it came from.

Kinds: assign, access and hex as the base; pem and jwt; and for a span in a layer the
rule with the layers that led there, as in assign@base64+url. Positions are code points
of the original text, the end exclusive. The lines of a wrapped base64 block are also
decoded together, and a run that gives no text is tried in pieces between / - _ and from
each of four alignments. A run that unpacks to more than LARGEST bytes gives a span of the
kind oversize, and layers of CHUNK bytes that overlap by OVERLAP characters or by the coded
run they end in (up to LARGEST characters).

A null or empty text has no spans; a very long one is scanned whole, with 8 bytes of places
for each character of a decoded layer. Repeated rows each get their row, an empty table
gives an empty one, and columns besides the id and the text play no part.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.bpe import slices

BASE = ("assign", "access", "hex")
RULES = (*BASE, "pem", "jwt")
#: Bytes that a compressed run may unpack to at once; beyond, so many bytes at a time, with so many characters in common.
LARGEST, CHUNK, OVERLAP = 32_000_000, 4_000_000, 1_000_000
#: So many layers of escapes are scanned one by one.
DEEP = 8
#: Characters of the shortest run that is decoded.
RUN = 16

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")

ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
HEXED = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){16,}(?![0-9A-Fa-f])")
CODED = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
PIECE = re.compile(r"[^/_-]{16,}")
PACKED = re.compile(rb"\x1f\x8b|x[\x01\x5e\x9c\xda]")
READABLE = re.compile(r"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ud800-\udfff]{12,}")
BREAKS = str.maketrans("", "", "\t\n\r")
RUNNING = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-= \t\r\n"


def scanned(text: str):
    """(rule, start, end) in one layer."""
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 12:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        yield from (("access", m.start(), m.end()) for m in ACCESS.finditer(text))
    yield from (("hex", m.start(), m.end()) for m in HEX.finditer(text))
    if "-----BEGIN " in text:
        yield from (("pem", m.start(), m.end()) for m in PEM.finditer(text))
    if "eyJ" in text:
        yield from (("jwt", m.start(), m.end()) for m in JWT.finditer(text))


def unpacked(data: bytes) -> bytes | None:
    """What gzip or zlib data holds; None if it is neither. OverflowError beyond LARGEST."""
    if data[:2] != b"\x1f\x8b" and data[:2] not in (b"x\x01", b"x\x5e", b"x\x9c", b"x\xda"):
        return None
    unpack = zlib.decompressobj(47)
    try:
        out = unpack.decompress(data, LARGEST)
    except zlib.error:
        return None
    if unpack.unconsumed_tail:
        raise OverflowError
    return out


def plain(data: bytes) -> str | None:
    """data as text, if it is one."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if text.translate(BREAKS).isprintable():
        return text or None
    odd = sum(not (c.isprintable() or c in "\t\n\r") for c in text)
    return text if odd * 20 <= len(text) else None


class Layer:
    """A text, the layers that led to it, and of each character its original start and end (None: itself), or one span for all."""

    def __init__(self, text: str, path: str = "", starts: np.ndarray | None = None, ends: np.ndarray | None = None, whole: tuple[int, int] | None = None, escapes: int = 0):
        self.text, self.path, self.starts, self.ends, self.whole, self.escapes = text, path, starts, ends, whole, escapes

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        return (start, end) if self.starts is None else (int(self.starts[start]), int(self.ends[end - 1]))

    def key(self) -> bytes:
        """A digest of the text and of the places it came from."""
        places = np.array(self.whole).tobytes() if self.whole else b"" if self.starts is None else self.starts.tobytes() + self.ends.tobytes()
        return hashlib.blake2b(places + self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def named(self, kind: str) -> str:
        return f"{kind}+{self.path}" if self.path else kind

    def below(self, kind: str, text: str, starts: np.ndarray, ends: np.ndarray, escapes: int = 0) -> Layer:
        """A layer decoded from this one; starts, ends: of each of its characters, here; escapes: layers of them in a row."""
        if self.whole:
            return Layer(text, self.named(kind), whole=self.whole, escapes=escapes)
        if self.starts is not None:
            starts, ends = self.starts[starts], self.ends[ends - 1]
        return Layer(text, self.named(kind), starts.astype(np.int32), ends.astype(np.int32), escapes=escapes)

    def inside(self, kind: str, text: str, start: int, end: int) -> Layer:
        """A layer that comes from one stretch of this one as a whole."""
        return Layer(text, self.named(kind), whole=self.span(start, end))


def unescaped(pattern: re.Pattern, text: str, read):
    """The text with its escapes decoded, and where its characters start and end."""
    out, found, here = [], [], 0
    for m in pattern.finditer(text):
        new = read(m)
        out += [text[here : m.start()], new]
        found.append((m.start(), m.end(), len(new)))
        here = m.end()
    out.append(text[here:])
    at = np.array(found, np.int32).reshape(-1, 3)
    # Plain stretches and escapes in turn: where each begins, its length, and whether its characters have places of their own.
    begin, size = np.zeros(2 * len(at) + 1, np.int32), np.zeros(2 * len(at) + 1, np.int32)
    begin[2::2], begin[1::2] = at[:, 1], at[:, 0]
    size[1::2], size[::2] = at[:, 2], np.append(at[:, 0], len(text)) - begin[::2]
    plain = np.repeat(np.arange(len(size)) % 2 == 0, size)
    starts = np.repeat(begin, size)
    starts += np.where(plain, np.arange(len(starts)) - np.repeat(np.cumsum(size) - size, size), 0).astype(np.int32)
    ends = np.where(plain, starts + 1, np.repeat(np.insert(np.zeros(len(at) + 1, np.int32), np.arange(1, len(at) + 1), at[:, 1]), size))
    return "".join(out), starts, ends


#: An escape that a text ends with.
LAST = re.compile(rf"(?:{UNICODE.pattern})\Z")
HEXES = frozenset("0123456789ABCDEFabcdef")


def last_escape(out: list[str]) -> tuple[int, str] | None:
    """The length of the escape that some characters end with, and what it stands for."""
    last = out[-1]
    if last in HEXES and len(out) > 2 and out[-3] == "%" and out[-2] in HEXES:
        size = 1
        while True:  # the bytes of one character, from the last one back
            data = bytes.fromhex("".join(out[-3 * size :]).replace("%", ""))
            if data[0] & 0xC0 != 0x80:
                break
            size += 1
            if size > 4 or len(out) < 3 * size or out[-3 * size] != "%" or not HEXES.issuperset(out[1 - 3 * size : 3 - 3 * size]):
                return None
        try:
            return (3 * size, char) if len(char := data.decode()) == 1 else None
        except UnicodeDecodeError:
            return None
    if (last in HEXES or last in "};") and (m := LAST.search("".join(out[-11:]))):
        return len(m[0]), letter_of(m)
    return None


def unwrapped(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The text with its escapes decoded, also those that decoding makes, and where its characters start and end."""
    out: list[str] = []
    starts, ends = [], []
    for i, c in enumerate(text):
        out.append(c)
        starts.append(i)
        ends.append(i + 1)
        while found := last_escape(out):
            size, char = found
            first, last = starts[-size], ends[-1]
            del out[-size:], starts[-size:], ends[-size:]
            out.append(char)
            starts.append(first)
            ends.append(last)
    return "".join(out), np.array(starts, np.int32), np.array(ends, np.int32)


def bytes_of(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")


def letter_of(m: re.Match) -> str:
    code = int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def decoded(layer: Layer):
    """The layers directly below, or an iterator of them, and ("oversize", start, end) for a run that is too large."""
    text = layer.text
    for mark, kind, pattern, read in (("%", "url", ESCAPES, bytes_of), ("\\", "unicode", UNICODE, letter_of), ("&#", "unicode", UNICODE, letter_of)):
        if mark in text and pattern.search(text):
            if layer.escapes == DEEP:
                yield layer.below("deep", *unwrapped(text), escapes=DEEP + 1)
                break
            if layer.escapes < DEEP:
                yield layer.below(kind, *unescaped(pattern, text, read), escapes=layer.escapes + 1)
    for m in CODED.finditer(text):
        run = m[0].rstrip("=")
        yield from run_layers(layer, run, np.arange(m.start(), m.start() + len(run)), m.end())
    for m in HEXED.finditer(text):
        data = bytes.fromhex(m[0])
        if (found := packed_layers(layer, data, m.start(), m.end(), "hex")) is not None:
            yield from found
        elif new := plain(data):
            yield text_layer(layer, new, np.arange(m.start(), m.end()), 0, "hex")
    if "\n" in text:
        for run, places, end, last in blocks(text):
            cut = len(run) - last
            if (found := whole_layers(layer, run, places, end)) is None and cut > last:  # else the last line may be of what follows
                found = whole_layers(layer, run[:cut], places[:cut], int(places[cut - 1]) + 1)
            yield from part_layers(layer, run, places) if found is None else found


def blocks(text: str):
    """Of each base64 block of several lines: its characters, their places, its end, and the length of its last line.

    Lines between the first and the last are of one length, and the last is no longer.
    """
    for m in WRAPPED.finditer(text):
        lines = [x.span() for x in LINE.finditer(text, m.start(), m.end())]
        at = 0
        while at < len(lines) - 1:
            size, to = lines[at + 1][1] - lines[at + 1][0], at + 2
            if size >= RUN:
                while to < len(lines) and lines[to][1] - lines[to][0] == size:
                    to += 1
                if to < len(lines) and lines[to][1] - lines[to][0] < size:
                    to += 1
            elif lines[at][1] - lines[at][0] < RUN:
                at += 1
                continue
            places = np.concatenate([np.arange(*x) for x in lines[at:to]])
            yield "".join(text[i:j] for i, j in lines[at:to]), places, m.end() if to == len(lines) else lines[to - 1][1], lines[to - 1][1] - lines[to - 1][0]
            at = to - 1  # the last line may be the first of another block


def bytes_in(run: str) -> bytes:
    run = run[: len(run) - (len(run) % 4 == 1)].replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return b""


def packed_layers(layer: Layer, data: bytes, start: int, end: int, kind: str = "base64"):
    """Of compressed data, its layers; None if it is none or holds no text."""
    try:
        packed = unpacked(data)
    except OverflowError:
        return [("oversize", *layer.span(start, end)), chunks(layer, data, start, end, kind)]
    new = plain(packed) if packed else None
    return [layer.inside(f"{kind}+compressed", new, start, end)] if new else None


def chunks(layer: Layer, data: bytes, start: int, end: int, kind: str):
    """The text of a large compressed run, a part at a time; it ends at bytes that are no text."""
    unpack, read, text = zlib.decompressobj(47), codecs.getincrementaldecoder("utf-8")(), ""
    try:
        while not unpack.eof:
            out = unpack.decompress(data, CHUNK)
            data = unpack.unconsumed_tail
            if not (out or data):
                return
            text += read.decode(out)
            yield layer.inside(f"{kind}+compressed", text, start, end)
            text = text[max(0, len(text) - LARGEST, min(len(text) - OVERLAP, len(text.rstrip(RUNNING)))) :]
    except (zlib.error, UnicodeDecodeError):
        return


def text_layer(layer: Layer, new: str, places: np.ndarray, byte: int, kind: str = "base64") -> Layer:
    """A text that starts at a byte of what the characters at these places decode to."""
    up, down = (4, 3) if kind == "base64" else (2, 1)
    code = np.frombuffer(new.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = byte + np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
    starts = np.append(byte, ends[:-1])
    return layer.below(kind, new, places[starts * up // down], places[np.minimum(len(places), -(-ends * up // down)) - 1] + 1)


def whole_layers(layer: Layer, run: str, places, end: int):
    """The layers of a run decoded from its first character; None if it gives no text."""
    data = bytes_in(run)
    if (found := packed_layers(layer, data, int(places[0]), end)) is not None:
        return found
    new = plain(data)
    return [text_layer(layer, new, places, 0)] if new else None


def part_layers(layer: Layer, run: str, places):
    """The layers of the pieces of a run, and of the texts in what is left, from each alignment."""
    left, at = [], 0
    for m in PIECE.finditer(run):
        if len(m[0]) < len(run) and (found := whole_layers(layer, m[0], places[m.start() : m.end()], int(places[m.end() - 1]) + 1)) is not None:
            yield from found
            left.append((at, m.start()))
            at = m.end()
    for start, end in [*left, (at, len(run))]:
        for k in range(start, min(start + 4, end - RUN + 1)):
            data, here = bytes_in(run[k:end]), places[k:end]
            for m in PACKED.finditer(data):
                yield from packed_layers(layer, data[m.start() :], int(here[m.start() * 4 // 3]), int(here[-1]) + 1) or []
            text = data.decode("utf-8", "surrogateescape")
            for m in READABLE.finditer(text):
                yield text_layer(layer, m[0], here, len(text[: m.start()].encode("utf-8", "surrogateescape")))


def run_layers(layer: Layer, run: str, places, end: int):
    found = whole_layers(layer, run, places, end)
    yield from part_layers(layer, run, places) if found is None else found


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """By start, then by kind as listed; those of layers follow the text's own of the same start."""
    work, seen, known, found = [Layer(text or "")], set(), set(), set()
    while work:
        layer = work.pop()
        if not isinstance(layer, Layer):  # chunks, of which only one at a time is held
            if (part := next(layer, None)) is None:
                continue
            work.append(layer)
            layer = part
        if (key := layer.key()) in seen:
            continue
        seen.add(key)
        for rule, start, end in scanned(layer.text):
            if (same := (rule, *layer.span(start, end))) not in known:  # else a layer above has it
                known.add(same)
                found.add((f"{rule}@{layer.path}" if layer.path else rule, *same[1:]))
        for x in decoded(layer):
            if isinstance(x, tuple):
                found.add(x)
            else:
                work.append(x)
    rank = {r: k for k, r in enumerate(RULES)}
    return sorted(found, key=lambda s: (s[1], rank.get(s[0], len(rank)), s[0], s[2]))


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def secret_spans(text: str | Column) -> Column:
    """array<struct<kind,start,end>> of a text column."""

    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def find(column: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans_of(t)] for part in slices(column) for t in part], SPAN)

    return find.asNondeterministic()(text)  # so that Spark runs it once


def query(spark, sf_dir: str) -> DataFrame:
    """op8: one row per row of documents."""
    from strata.llm.pii import joined

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", secret_spans("text").alias("found"))
    counts = [F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return docs.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
