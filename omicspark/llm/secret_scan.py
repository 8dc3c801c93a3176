"""Secrets in texts and in the encoded layers inside them, with spans in the original text."""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that sorts spans with equal starts.
KINDS = ("assign", "access", "hex")
#: A compressed layer, or all layers of a document, may grow to so many bytes; the rest beyond is not read and
#: the layer counted as ``unopened``. Layers are read in pieces, so the guard is on time, against bombs, not on memory.
MAX_LAYER_BYTES, MAX_DOCUMENT_BYTES = 1 << 30, 1 << 30
#: Bytes of a piece of a compressed layer, and by how many at least the next piece reaches back. A piece that ends
#: inside an encoded run hands the run on whole, up to RUN_BYTES; a longer run counts as unopened.
PIECE_BYTES, OVERLAP_BYTES, RUN_BYTES = 1 << 20, 64 << 10, 48 << 20
#: Compressed bytes given to a decompressor at once, which bounds what it returns at once, and its window.
_FEED, _WINDOW = 1024, 1 << 27
#: Bytes that tell compressed data, at most, and how many streams longer than a piece may stand inside each other.
_HEADER, _DEEP = 6, 64

FINDINGS = "array<struct<kind:string,start:long,end:long,base:boolean,path:string>>"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|((?:\\u[0-9A-Fa-f]{4})+)|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
    r"|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
#: Runs over both base64 alphabets, with line breaks and indents inside.
_BASE64 = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{18,}+|[A-Za-z0-9+/_-]++(?=\r?\n))(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+={0,2}"
)
#: The shortest secret, a keyword with 8 characters, takes 18 characters in base64 without its padding.
_SHORTEST = 18
_BREAKS = str.maketrans("-_", "+/", "\r\n\t =")
#: Bytes in which this finds nothing hold neither a secret nor a further layer.
_HINT = re.compile(
    rb"passw|secret|token|api_?key|AKIA|[0-9a-f]{32}|%[0-9a-f]{2}|\\[uUx]|&#|(?:[A-Za-z0-9+/_-](?:\r?\n[ \t]*)?){18}"
    rb"|(?:[\x01-\x7f]\x00{1,3}){8}",
    re.IGNORECASE,
)
#: Text in units of two or four bytes, in either order, and what stands between its characters.
_WIDE, _FILL = re.compile(r"(?:[\x01-\x7f]\x00{1,3}){8}"), re.compile(r"\x00{1,3}")
#: The escapes by which programs write bytes.
_BYTES = re.compile(r"\\(?:x|u00)([0-9A-Fa-f]{2})|\\([0-7]{1,3})|\\([abfnrtv\\'\"/])")
_BYTE_NAMES = dict(zip("abfnrtv", "\a\b\f\n\r\t\v"))
_LATIN = re.compile(r"[\x00-\xff]+")
#: First bytes of gzip, bz2, xz, zstd and zlib data.
_PACKED = re.compile(
    rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]|\x08[\x1d\x5b\x99\xd7]|\x18[\x19\x57\x95\xd3]"
    rb"|\x28[\x15\x53\x91\xcf]|\x38[\x11\x4f\x8d\xcb]|\x48[\x0d\x4b\x89\xc7]|\x58[\x09\x47\x85\xc3]|\x68[\x05\x43\x81\xde]"
)
#: What an encoded run is made of.
_RUN_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n\t %\\&#;{}"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets that stand openly in ``text``."""
    found: list[tuple[str, int, int]] = []
    lowered = text.lower()
    if any(hint in lowered for hint in _ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


@dataclass
class Layer:
    """A text, how it was reached, and the span of the original behind each of its characters.

    ``starts`` and ``ends`` of None stand for the text itself, or for ``whole`` behind every character.
    """

    text: str
    path: str = ""
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    whole: tuple[int, int] | None = None
    #: Whether the compressed data inside are read by who made the layer.
    opened: bool = False

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.whole is not None:
            return self.whole
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def child(self, text: str, step: str, starts: np.ndarray, ends: np.ndarray) -> Layer:
        """A layer whose character i was made from characters ``starts[i]`` to ``ends[i]`` of this one."""
        if self.starts is not None:
            starts, ends = self.starts[starts], self.ends[ends - 1]
        return Layer(text, f"{self.path}/{step}", starts, ends)


@dataclass
class Packed:
    """Compressed data, for which ``whole`` of the original stands, and the path of what it unpacks to."""

    data: bytes
    path: str
    whole: tuple[int, int]


def _replaced(layer: Layer, step: str, pattern: re.Pattern, decode: Callable[[re.Match], str | None]) -> Iterator[Layer]:
    """The layer with every match replaced by what it stands for, if any can be decoded."""
    pieces, starts, ends, at = [], [], [], 0

    def literal(to: int) -> None:
        pieces.append(layer.text[at:to])
        if layer.whole is not None:
            return
        starts.append(np.arange(at, to))
        ends.append(np.arange(at + 1, to + 1))

    for m in pattern.finditer(layer.text):
        plain = decode(m)
        if plain is None:
            continue
        literal(m.start())
        pieces.append(plain)
        if layer.whole is None:
            width = (m.end() - m.start()) // max(1, len(plain))
            even = pattern is _PERCENT and width == 3
            first = np.arange(len(plain)) * 3 + m.start() if even else np.full(len(plain), m.start())
            starts.append(first)
            ends.append(first + 3 if even else np.full(len(plain), m.end()))
        at = m.end()
    if at and layer.whole is not None:
        literal(len(layer.text))
        yield Layer("".join(pieces), f"{layer.path}/{step}", whole=layer.whole)
    elif at:
        literal(len(layer.text))
        yield layer.child("".join(pieces), step, np.concatenate(starts), np.concatenate(ends))


def _percent(m: re.Match) -> str | None:
    data = bytes.fromhex(m.group().replace("%", ""))
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _escape(m: re.Match) -> str | None:
    if m.group(2):
        return bytes.fromhex(m.group(2).replace("\\u", "")).decode("utf-16-be", "surrogatepass")
    digits = next((g for g in (m.group(1), m.group(3), m.group(4), m.group(5)) if g), None)
    code = int(digits, 16) if digits else int(m.group(6))
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _percent_bytes(m: re.Match) -> str:
    return bytes.fromhex(m.group().replace("%", "")).decode("latin-1")


def _byte(m: re.Match) -> str | None:
    if m.group(3):
        return _BYTE_NAMES.get(m.group(3), m.group(3))
    code = int(m.group(1), 16) if m.group(1) else int(m.group(2), 8)
    return chr(code) if code < 256 else None


def _opener(data: bytes, at: int):
    """A decompressor for the data that starts at ``at``, or None."""
    if data.startswith(b"\x1f\x8b", at):
        return zlib.decompressobj(31)
    if data.startswith(b"BZh", at):
        return bz2.BZ2Decompressor()
    if data.startswith(b"\xfd7zXZ\x00", at):
        return lzma.LZMADecompressor(memlimit=_WINDOW + (16 << 20))
    if data.startswith(b"\x28\xb5\x2f\xfd", at):
        return zstandard.ZstdDecompressor(max_window_size=_WINDOW).decompressobj()
    return zlib.decompressobj(15) if _PACKED.match(data, at) else None


_BROKEN = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError)


class _Unpacked:
    """The bytes behind compressed data, member after member; ``at`` is the end of the last whole member in ``data``.

    ``clean`` says that no member was broken off, ``cut`` that ``data`` ended inside one, ``refused`` that one asked
    for too much memory.
    """

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.refused, self.clean, self.cut = data, at, False, False, False

    def __iter__(self) -> Iterator[bytes]:
        data = self.data
        while (opened := _opener(data, self.at)) is not None:
            at = self.at
            try:
                while at < len(data) and not opened.eof:
                    fed = data[at : at + _FEED]
                    at += len(fed)
                    out = opened.decompress(fed)
                    if out:
                        yield out
            except _BROKEN as error:
                self.refused = "memory" in str(error).lower()
                return
            if not opened.eof:
                self.cut = True
                return
            self.at = at - len(opened.unused_data)
            while data.startswith(b"\0", self.at):  # padding between members
                self.at += 1
        self.clean = True


class _Reader:
    """Unpacked bytes, for which ``whole`` stands, read in overlapping pieces.

    Compressed data that end inside a piece are given out as ``Packed``; those that go on are read along.
    """

    def __init__(self, document: _Document, path: str, whole: tuple[int, int], deep: int = 0):
        self.document, self.path, self.whole, self.deep = document, path, whole, deep
        self.held, self.size, self.wanted, self.searched = [], 0, PIECE_BYTES, 0
        self.streams: list[_Stream] = []

    def feed(self, out: bytes) -> Iterator[Layer | Packed]:
        for stream in self.streams:
            yield from stream.feed(out)
        self.streams = [stream for stream in self.streams if not stream.ended]
        self.held.append(out)
        self.size += len(out)
        if self.size >= self.wanted:
            data = b"".join(self.held)
            yield from self.piece(data, len(data) - _HEADER)
            rest = len(data) - min(len(data.rstrip(_RUN_ALPHABET)), len(data) - OVERLAP_BYTES)
            if rest > RUN_BYTES:
                self.document.unopened.append(self.whole)
                rest = OVERLAP_BYTES
            self.searched = max(0, self.searched - len(data) + rest)
            self.held, self.size, self.wanted = [data[-rest:]], rest, max(PIECE_BYTES, 2 * rest)

    def close(self) -> Iterator[Layer | Packed]:
        for stream in self.streams:
            yield from stream.close()
        if self.size:
            data = b"".join(self.held)
            yield from self.piece(data, len(data))

    def piece(self, data: bytes, end: int) -> Iterator[Layer | Packed]:
        """The text of ``data`` and the compressed data that begin before ``end`` and have not been looked for yet."""
        yield Layer(data.decode("latin-1"), self.path, whole=self.whole, opened=True)
        path = f"{self.path}/compressed"
        while (found := _PACKED.search(data, self.searched)) and found.start() < end:
            begin = found.start()
            source, size = self.document.extent(data, begin)
            self.searched = max(source.at, begin + 1)
            if end < len(data) and size <= self.document.limit and (source.cut or source.at > end):
                self.searched = begin + 1
                stream = _Stream(self.document, path, self.whole, self.deep + 1)
                yield from stream.feed(data[begin:])
                self.streams += [] if stream.ended else [stream]
            elif size > self.document.limit:
                self.document.unopened.append(self.whole)
            elif size or source.refused:
                yield Packed(data[begin : source.at if source.clean else len(data)], path, self.whole)
        self.searched = max(self.searched, end)


class _Stream:
    """Compressed data, member after member, that come piece by piece."""

    def __init__(self, document: _Document, path: str, whole: tuple[int, int], deep: int):
        self.document, self.whole, self.deep = document, whole, deep
        self.reader = _Reader(document, path, whole, deep)
        self.opened, self.waiting, self.size, self.ended = None, b"", 0, False

    def feed(self, data: bytes) -> Iterator[Layer | Packed]:
        data, at = self.waiting + data, 0
        self.waiting = b""
        stopped = self.deep > _DEEP
        while at < len(data) and not self.ended and not stopped:
            if self.opened is None:
                while self.size and data.startswith(b"\0", at):
                    at += 1
                if len(data) - at < _HEADER:
                    self.waiting = data[at:]
                    return
                self.opened = _opener(data, at)
                self.ended = self.opened is None
                continue
            fed = data[at : at + _FEED]
            at += len(fed)
            try:
                out = self.opened.decompress(fed)
            except _BROKEN as error:
                self.ended, stopped = True, "memory" in str(error).lower()
                break
            self.size += len(out)
            self.document.left -= len(out)
            stopped = self.size > self.document.max_layer or self.document.left < 0
            if out:
                yield from self.reader.feed(out)
            if self.opened.eof:
                at -= len(self.opened.unused_data)
                self.opened = None
        if stopped:
            self.ended = True
            self.document.unopened.append(self.whole)
        if self.ended:
            yield from self.reader.close()

    def close(self) -> Iterator[Layer | Packed]:
        if not self.ended:
            self.ended = True
            yield from self.reader.close()


class _Document:
    """The worklist of one text."""

    def __init__(self, text: str, max_layer: int, max_total: int):
        self.max_layer, self.left = max_layer, max_total
        #: Spans behind which something was not read to its end, one entry for each layer.
        self.unopened: list[tuple[int, int]] = []
        self.found: dict[tuple[str, int, int], tuple[bool, str]] = {}
        self.seen: set[tuple] = set()
        # Depth first and lazily: only the layers that lead to the current one are held.
        self.work = [iter([Layer(text)])]
        while self.work:
            layer = next(self.work[-1], None)
            if layer is None:
                self.work.pop()
            elif (mark := self._mark(layer)) not in self.seen:
                self.seen.add(mark)
                if isinstance(layer, Packed):
                    self.work.append(self.read(layer))
                else:
                    self.scan(layer)
                    self.work.append(self.children(layer))
        self.drop_stored()

    def drop_stored(self) -> None:
        """What a compressor stored as it was shows in its bytes too; the finding of the unpacked layer covers it."""
        packed: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for (kind, start, end), (_, path) in self.found.items():
            if path.endswith("/compressed"):
                packed.setdefault((kind, path.removesuffix("/compressed")), []).append((start, end))
        for (kind, start, end), (base, path) in list(self.found.items()) if packed else ():
            if not base and any(a <= start and end <= b for a, b in packed.get((kind, path), ())):
                del self.found[kind, start, end]

    @staticmethod
    def _mark(layer: Layer | Packed) -> tuple:
        """A layer that shows the same text for the same place again ends there: decoding has come full circle."""
        if isinstance(layer, Packed):
            return "packed", hashlib.blake2b(layer.data, digest_size=16).digest(), *layer.whole
        digest = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if layer.whole is not None:
            return digest, *layer.whole
        if layer.starts is None or not len(layer.starts):
            return digest, 0, len(layer.text)
        return digest, int(layer.starts.min()), int(layer.ends.max())

    def scan(self, layer: Layer) -> None:
        base = layer.starts is None and layer.whole is None
        for kind, start, end in base_spans(layer.text):
            self.found.setdefault((kind, *layer.span(start, end)), (base, layer.path))

    def children(self, layer: Layer) -> Iterator[Layer | Packed]:
        text = layer.text
        if not layer.opened:
            for m in _LATIN.finditer(text):
                place = lambda begin, stop, at=m.start(): layer.span(at + begin, at + stop)
                yield from self.compressed(m.group().encode("latin-1"), layer.path, place)
        for m in _BASE64.finditer(text):
            if m.end() - m.start() >= _SHORTEST:
                yield from self.unpacked(layer, m.start(), m.group())
        if "\\" in text or "&#" in text:
            yield from _replaced(layer, "unicode", _ESCAPE, _escape)
        if "\\" in text:
            yield from self.raw(layer, "unicode", _BYTES, _byte)
        if "%" in text:
            yield from _replaced(layer, "url", _PERCENT, _percent)
            yield from self.raw(layer, "url", _PERCENT, _percent_bytes)
        if "\0" in text and _WIDE.search(text):
            yield from _replaced(layer, "wide", _FILL, lambda m: "")

    def raw(self, layer: Layer, step: str, pattern: re.Pattern, decode: Callable[[re.Match], str | None]) -> Iterator[Layer]:
        """The layer with what stands for bytes as these bytes, if they may hold compressed data."""
        for out in _replaced(layer, step, pattern, decode):
            if any(_PACKED.search(m.group().encode("latin-1")) for m in _LATIN.finditer(out.text)):
                yield out

    def compressed(self, data: bytes, path: str, place: Callable[[int, int], tuple[int, int]]) -> Iterator[Packed]:
        """Compressed data anywhere in ``data``; ``place`` gives the span of the original behind some of its bytes."""
        at = 0
        while (found := _PACKED.search(data, at)) is not None:
            begin = found.start()
            source, size = self.extent(data, begin)
            stop = source.at if source.clean else len(data)
            if size > self.limit:
                self.unopened.append(place(begin, stop))
            elif size or source.refused:
                yield Packed(data[begin:stop], f"{path}/compressed", place(begin, stop))
            at = max(source.at, begin + 1)

    def unpacked(self, layer: Layer, at: int, run: str) -> Iterator[Layer]:
        """Layers of a run that may start at any of four phases and hold compressed data at any place."""
        body = run.translate(_BREAKS).encode("ascii")
        wrapped = "\n" in run
        places = None
        for phase in range(4):
            chars = len(body) - phase
            chars -= chars % 4 == 1
            if chars < 2:
                continue
            data = binascii.a2b_base64(body[phase : phase + chars] + b"=" * (-chars % 4))
            packed = _PACKED.search(data)
            hinted = _HINT.search(data)
            if wrapped and places is None and (packed or hinted):
                codes = np.frombuffer(run.rstrip("=").encode("ascii"), dtype=np.uint8)
                places = at + np.flatnonzero(codes > 32)
            if hinted and layer.whole is not None:
                yield Layer(data.decode("latin-1"), f"{layer.path}/base64", whole=layer.whole, opened=True)
            elif hinted:
                ends = np.arange(1, len(data) + 1)
                first, last = phase + (ends - 1) * 8 // 6, phase + np.minimum(-(-ends * 8 // 6), chars) - 1
                first, last = (places[first], places[last] + 1) if wrapped else (at + first, at + last + 1)
                child = layer.child(data.decode("latin-1"), "base64", first, last)
                child.opened = True
                yield child
            if packed:

                def place(begin: int, stop: int, phase: int = phase, size: int = len(data)) -> tuple[int, int]:
                    first, last = phase + begin * 8 // 6, phase + -(-stop * 8 // 6) - 1
                    start = int(places[first]) if wrapped else at + first
                    end = at + len(run) if stop == size else int(places[last]) + 1 if wrapped else at + last + 1
                    return layer.span(start, end)

                yield from self.compressed(data, f"{layer.path}/base64", place)

    def extent(self, data: bytes, begin: int) -> tuple[_Unpacked, int]:
        """The compressed data that start at ``begin``, read to their end, and their size, or one too large."""
        source, size = _Unpacked(data, begin), 0
        for out in source:
            size += len(out)
            if size > self.limit:
                break
        return source, size

    @property
    def limit(self) -> int:
        """How large a layer may be now."""
        return min(self.max_layer, self.left)

    def read(self, packed: Packed) -> Iterator[Layer | Packed]:
        """The text of compressed data in pieces, and the compressed data inside."""
        source, reader = _Unpacked(packed.data, 0), _Reader(self, packed.path, packed.whole)
        for out in source:
            if len(out) > self.left:
                self.unopened.append(packed.whole)
                break
            self.left -= len(out)
            yield from reader.feed(out)
        yield from reader.close()
        if source.refused:
            self.unopened.append(packed.whole)


def findings_of(
    text: str | None, max_layer: int = MAX_LAYER_BYTES, max_total: int = MAX_DOCUMENT_BYTES
) -> tuple[list[dict], int]:
    """(findings in order of start, kind, end; layers not opened for their size) of one text."""
    document = _Document(text or "", max_layer, max_total)
    spans = sorted(document.found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    rows = [dict(zip(("kind", "start", "end", "base", "path"), (*s, *document.found[s]))) for s in spans]
    return rows, len(document.unopened)


def findings(text: Column | str, max_layer: int = MAX_LAYER_BYTES, max_total: int = MAX_DOCUMENT_BYTES) -> Column:
    """Struct (findings, unopened) of a text column.

    A finding has its kind, its span in the text as given (code points, end exclusive), whether it stands
    openly (``base``) and the path of encodings that led to it. Null and empty texts have none. The worklist
    unwraps percent runs, Unicode escapes, base64 (both alphabets, wrapped or not, from each of the four places
    a run may start at), wide characters, and compressed data anywhere in any layer, member after member, and scans
    each layer, until no layer is new. Bytes that are not UTF-8 are read as Latin-1, so no layer is dropped for odd bytes.
    """

    @F.pandas_udf(f"findings {FINDINGS}, unopened long")
    def apply(texts: pd.Series) -> pd.DataFrame:
        rows = [findings_of(t, max_layer, max_total) for t in texts]
        return pd.DataFrame({"findings": [r[0] for r in rows], "unopened": [r[1] for r in rows]})

    return apply(text)


def spans_text(found: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def scan(docs: DataFrame, text_col: str = "text", out: str = "findings") -> DataFrame:
    """``docs`` with the findings of each whole text in ``out`` and the number of unopened layers beside them."""
    both = docs.withColumn(out, findings(F.col(text_col)))
    return both.withColumn(f"{out}_unopened", F.col(out)["unopened"]).withColumn(out, F.col(out)["findings"])


def redact_text(text: str | None, max_layer: int = MAX_LAYER_BYTES, max_total: int = MAX_DOCUMENT_BYTES) -> str | None:
    """The text with every finding replaced by its kind in brackets; overlapping findings become one.

    A layer that was not read to its end may hold anything and is replaced by ``[unopened]``.
    """
    if not text:
        return text
    document = _Document(text, max_layer, max_total)
    spans = [(start, KINDS.index(kind), end, kind) for kind, start, end in document.found]
    spans += [(start, len(KINDS), end, "unopened") for start, end in document.unopened]
    rows = [{"kind": kind, "start": start, "end": end} for start, _, end, kind in sorted(spans)]
    pieces, at = [], 0
    open_kind, open_start, open_end = "", -1, -1
    for row in [*rows, {"kind": "", "start": len(text) + 1, "end": len(text) + 1}]:
        if row["start"] < open_end:
            open_end = max(open_end, row["end"])
            continue
        if open_start >= 0:
            pieces += [text[at:open_start], f"[{open_kind}]"]
            at = open_end
        open_kind, open_start, open_end = row["kind"], row["start"], row["end"]
    return "".join([*pieces, text[at:]])


def redact(text: Column | str) -> Column:
    """A text column without its secrets; null stays null."""

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([redact_text(t) for t in texts], dtype=object)

    return apply(text)
