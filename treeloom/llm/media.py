"""Media columns by signature sniffing (operator 5).

An Aho-Corasick automaton locates the magic bytes of all known formats in one pass; a
validator for the format then walks its structure and lengths. A region counts only if it
is valid to its end. The region at offset 0 gives the content's true type, which corrects
a declared one; valid regions further inside are carved as embedded media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.common import string_column

UNKNOWN = "application/octet-stream"


class Region(NamedTuple):
    """A valid medium: where it lies and where its raw samples lie (0 long if unknown)."""

    media_type: str
    offset: int
    length: int
    payload_offset: int = 0
    payload_length: int = 0


class Content(bytes):
    """Bytes that remember what validators found in them, so that many hits of a signature
    do not search the same rest again."""

    @cached_property
    def _places(self) -> dict[bytes, list[int]]:
        return {}

    def next(self, pattern: bytes, at: int) -> int:
        """The first place of the pattern from ``at`` on, -1 if there is none."""
        if pattern not in self._places:
            found, pos = [], self.find(pattern)
            while pos >= 0:
                found.append(pos)
                pos = self.find(pattern, pos + 1)
            self._places[pattern] = found
        places = self._places[pattern]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    @cached_property
    def archives(self) -> dict[int, int]:
        """Where the zip archives end that begin at a place: an end record says both."""
        out: dict[int, int] = {}
        pos = self.next(b"PK\x05\x06", 0)
        while 0 <= pos <= len(self) - 22:
            size, start, note = struct.unpack_from("<IIH", self, pos + 12)
            at = pos - size - start
            if at >= 0 and self[at + start : at + start + 4] == b"PK\x01\x02" and pos + 22 + note <= len(self):
                out.setdefault(at, pos + 22 + note)
            pos = self.next(b"PK\x05\x06", pos + 1)
        return out

    @cached_property
    def inflated(self) -> dict[int, int | None]:
        """Where the compressed data end that begin at a place, with their sums; None if they
        are not valid."""
        return {}

    @cached_property
    def endless(self) -> set[int]:
        """Places from which chains of a GIF's blocks run past the end."""
        return set()


def _png(b: Content, at: int) -> Region | None:
    pos = at + 8
    while pos + 12 <= len(b):
        (n,) = struct.unpack_from(">I", b, pos)
        if pos + 12 + n > len(b):
            return None
        kind = b[pos + 4 : pos + 8]
        if zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0] or (pos == at + 8) != (kind == b"IHDR"):
            return None
        pos += 12 + n
        if kind == b"IEND":
            return Region("image/png", at, pos - at)
    return None


def _jpeg(b: Content, at: int) -> Region | None:
    pos = at + 2
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        mark = b[pos + 1]
        if mark == 0xD9:
            return Region("image/jpeg", at, pos + 2 - at)
        (n,) = struct.unpack_from(">H", b, pos + 2)
        if mark < 0xC0 or n < 2:
            return None
        pos += 2 + n
        if mark == 0xDA:  # entropy-coded data run to the next marker proper
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return None
                if b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7:
                    pos += 2
                    continue
                break
            if b[pos + 1] == 0xD9:
                return Region("image/jpeg", at, pos + 2 - at)
    return None


def _gif(b: Content, at: int) -> Region | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while pos < len(b):
        if b[pos] == 0x3B:
            return Region("image/gif", at, pos + 1 - at)
        if b[pos] == 0x21:
            pos += 2
        elif b[pos] == 0x2C and pos + 10 <= len(b):
            flags = b[pos + 9]
            pos += 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
        else:
            return None
        chain = []
        while pos < len(b) and b[pos] and pos not in b.endless:
            chain.append(pos)
            pos += 1 + b[pos]
        if pos >= len(b) or b[pos]:
            b.endless.update(chain)
            return None
        pos += 1
    return None


def _bmp(b: Content, at: int) -> Region | None:
    if at + 30 > len(b):
        return None
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    width, height, planes, bits = struct.unpack_from("<iiHH", b, at + 18)
    if reserved or header not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width < 1 or not height:
        return None
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    if not 14 + header <= start <= size or start + rows > size or at + size > len(b):
        return None
    return Region("image/bmp", at, size, at + start, rows)


def _riff(b: Content, at: int) -> Region | None:
    if at + 12 > len(b):
        return None
    (size,) = struct.unpack_from("<I", b, at + 4)
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(b[at + 8 : at + 12])
    pos, end, names, payload = at + 12, at + 8 + size, [], (0, 0)
    if kind is None or end > len(b):
        return None
    while pos + 8 <= end:
        (n,) = struct.unpack_from("<I", b, pos + 4)
        names.append(b[pos : pos + 4])
        if names[-1] == b"data":
            payload = (pos + 8, n)
        pos += 8 + n + n % 2
    if pos != end or not names or kind == "audio/wav" and not {b"fmt ", b"data"} <= set(names):
        return None
    return Region(kind, at, 8 + size, *payload)


def _pgm(b: Content, at: int) -> Region | None:
    head = b[at : at + 40].split(None, 4)
    if len(head) < 4 or head[0] != b"P5" or not all(x.isdigit() for x in head[1:4]):
        return None
    width, height, most = map(int, head[1:4])
    start = at
    for x in head[:4]:
        start = b.index(x, start) + len(x)
    if not (width and height and 0 < most < 256) or start + 1 + width * height > len(b):
        return None
    return Region("image/x-portable-graymap", at, start + 1 + width * height - at, start + 1, width * height)


def _pdf(b: Content, at: int) -> Region | None:
    if not b[at + 5 : at + 6].isdigit() or (start := b.next(b"startxref", at)) < 0 or (end := b.next(b"%%EOF", start)) < 0:
        return None
    return Region("application/pdf", at, end + 5 - at)


def _zip(b: Content, at: int) -> Region | None:
    return Region("application/zip", at, b.archives[at] - at) if at in b.archives else None


def _inflated(b: Content, start: int) -> int | None:
    """Where the deflated data at a place end, if they are valid and so are the sums after."""
    reader, view, pos, check, size = zlib.decompressobj(-15), memoryview(b), start, 0, 0
    rest: bytes | memoryview = b""
    try:
        while not reader.eof:
            if not len(rest):
                rest = view[pos : pos + 65536]
                pos += len(rest)
                if not len(rest):
                    return None
            part = reader.decompress(rest, 1 << 20)
            check, size = zlib.crc32(part, check), size + len(part)
            rest = reader.unconsumed_tail
    except zlib.error:
        return None
    end = pos - len(reader.unused_data)
    return end + 8 if b[end : end + 8] == struct.pack("<II", check, size & 0xFFFFFFFF) else None


def _gzip(b: Content, at: int) -> Region | None:
    pos = at + 10
    if pos > len(b) or (flags := b[at + 3]) & 0xE0:
        return None
    if flags & 4:
        if pos + 2 > len(b):
            return None
        pos += 2 + struct.unpack_from("<H", b, pos)[0]
    for bit in (8, 16):  # a name, a comment
        if flags & bit:
            if (pos := b.next(b"\0", pos) + 1) == 0:
                return None
    pos += 2 * bool(flags & 2)
    if pos not in b.inflated:
        b.inflated[pos] = _inflated(b, pos)
    end = b.inflated[pos]
    return Region("application/gzip", at, end - at) if end else None


def _ogg(b: Content, at: int) -> Region | None:
    pos, last = at, False
    while b[pos : pos + 5] == b"OggS\0" and pos + 27 <= len(b) and not last:
        if pos == at and not b[pos + 5] & 2:
            return None
        n = b[pos + 26]
        last = bool(b[pos + 5] & 4)
        pos += 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if pos > len(b):
            return None
    return Region("application/ogg", at, pos - at) if last else None


def _mp4(b: Content, at: int) -> Region | None:
    pos, kinds = at, []
    while pos + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        if n < 8 or pos + n > len(b) or kind not in ((b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"sidx", b"udta", b"meta", b"uuid") if kinds else (b"ftyp",)):
            break
        kinds.append(kind)
        pos += n
    return Region("video/mp4", at, pos - at) if kinds[:1] == [b"ftyp"] and {b"moov", b"moof"} & set(kinds) else None


#: Fixed values of the formats: magic bytes, where they stand in the file, validator.
SIGNATURES: list[tuple[bytes, int, Callable[[Content, int], Region | None]]] = [
    (b"\x89PNG\r\n\x1a\n", 0, _png),
    (b"\xff\xd8\xff", 0, _jpeg),
    (b"GIF87a", 0, _gif),
    (b"GIF89a", 0, _gif),
    (b"BM", 0, _bmp),
    (b"RIFF", 0, _riff),
    (b"P5", 0, _pgm),
    (b"%PDF-", 0, _pdf),
    (b"PK\x03\x04", 0, _zip),
    (b"\x1f\x8b\x08", 0, _gzip),
    (b"OggS", 0, _ogg),
    (b"ftyp", 4, _mp4),
]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(SIGNATURES):
        found.add_word(magic.decode("latin-1"), k)
    found.make_automaton()
    return found


def regions(content: bytes, magic: ahocorasick.Automaton) -> list[Region]:
    """Valid media by offset; within one that does not start at 0, none is looked for."""
    out: list[Region] = []
    hits = sorted((end + 1 - len(SIGNATURES[k][0]) - SIGNATURES[k][1], k) for end, k in magic.iter(content.decode("latin-1")))
    inside, known = 0, Content(content)
    for at, k in hits:
        if at >= inside and (region := SIGNATURES[k][2](known, at)):
            out.append(region)
            inside = at + region.length if at else 0
    return out


def padded(text: str | None, multiple: int = 192) -> tuple[bytes, int]:
    """The text's UTF-8 filled up with bytes 32 to a positive multiple, and its own length."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (max(multiple, -(-len(data) // multiple) * multiple) - len(data)), len(data)


def as_wav(samples: bytes, rate: int = 8000) -> bytes:
    """A RIFF/WAVE file of 8-bit mono PCM samples."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + len(data), b"WAVE") + form + data


def as_pgm(samples: bytes, width: int = 192) -> bytes:
    """A portable graymap, ``width`` samples a row."""
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


STORES = {"wav": as_wav, "pgm": as_pgm}

_CARVED = T.ArrayType(T.StructType([T.StructField("media_type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))


def sniff(df: DataFrame, id_col: str = "doc_id", content_col: str = "content", declared_col: str | None = None) -> DataFrame:
    """``media_type``, ``corrected`` and ``embedded`` for each binary content.

    Null or empty content, and content of no known format, has the type
    ``application/octet-stream``; ``corrected`` says that a format was found which is not
    the declared type (null: none). Known are PNG, JPEG, GIF, BMP, WAV, WebP, AVI, PGM, PDF,
    zip, gzip, Ogg and MP4. ``embedded`` lists valid media inside: type, offset, length.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(content_col).cast("binary").alias("content"), (F.col(declared_col) if declared_col else F.lit(None)).cast("string").alias("declared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magic = automaton()
        for batch in batches:
            kinds, wrong, inner = [], [], []
            for content, declared in zip(string_column(batch, "content"), string_column(batch, "declared")):
                found = regions(content or b"", magic)
                kinds.append(found[0].media_type if found and not found[0].offset else UNKNOWN)
                wrong.append(declared is not None and kinds[-1] not in (UNKNOWN, declared))
                inner.append([{"media_type": x.media_type, "offset": x.offset, "length": x.length} for x in found if x.offset])
            carved = pa.array(inner, pa.list_(pa.struct([("media_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), pa.array(wrong, pa.bool_()), carved], names=["doc_id", "media_type", "corrected", "embedded"])

    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("media_type", T.StringType()), T.StructField("corrected", T.BooleanType()), T.StructField("embedded", _CARVED)]))


def carve(df: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """A row with the bytes of each embedded medium: doc_id, media_type, offset, content."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(content_col).cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magic = automaton()
        for batch in batches:
            for i, content in zip(string_column(batch, "doc_id"), string_column(batch, "content")):
                if found := [x for x in regions(content or b"", magic) if x.offset]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * len(found), batch.column(0).type), pa.array([x.media_type for x in found]), pa.array([x.offset for x in found], pa.int64()), pa.array([content[x.offset : x.offset + x.length] for x in found], pa.binary())],
                        names=["doc_id", "media_type", "offset", "content"],
                    )

    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("media_type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("content", T.BinaryType())]))


def _feature(found: list[Region], samples: bytes, declared: str) -> str:
    """What was sniffed, and the samples' range, mean, deviation and mean step."""
    top, inner = found[0], found[1:]
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    n, total, squares, steps = len(x), int(x.sum()), int((x * x).sum()), int(np.abs(np.diff(x)).sum())
    parts = [f"type={top.media_type}", f"declared={declared}", f"length={top.length}", f"samples={n}", f"min={x.min()}", f"max={x.max()}", f"mean={total / n:.6f}", f"var={squares / n - (total / n) ** 2:.6f}", f"step={steps / n:.6f}"]
    return ";".join([*parts, "embedded=" + ",".join(f"{r.media_type}@{r.offset}+{r.length}" for r in inner)])


_DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean"


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, store: str = "wav", declared: str = UNKNOWN, keep: bool = False) -> DataFrame:
    """Each whole text stored as a medium of 8-bit samples, sniffed and read back.

    The text (null: empty) is padded as in :func:`padded` and stored by ``store``; the
    stored bytes are sniffed, and the samples are read from where the validated structure
    says they lie. ``keep`` adds the medium itself as ``media``. A row comes out for each
    row that goes in; equal texts give equal values.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magic = automaton()
        for batch in batches:
            columns: list[list] = [[] for _ in range(9 + keep)]
            for text in string_column(batch, "text"):
                payload, n = padded(text)
                media = STORES[store](payload)
                found = regions(media, magic)
                if not found or found[0].offset:
                    raise ValueError("a stored medium was not recognised")
                back = media[found[0].payload_offset : found[0].payload_offset + found[0].payload_length]
                values = [n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), _feature(found, back, declared), found[0].media_type, declared != found[0].media_type]
                for column, value in zip(columns, [*values, *[media] * keep]):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=["doc_id", *(x.split()[0] for x in _DIGESTS.split(", ")), *["media"] * keep])

    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *T._parse_datatype_string(_DIGESTS).fields, *[T.StructField("media", T.BinaryType())] * keep])
    return rows.mapInArrow(run, schema)


def op5(docs: DataFrame) -> DataFrame:
    """Digests of all ``documents`` stored as WAV samples and read back."""
    return stored(docs)
