"""Media columns: signatures sniffed by Aho-Corasick, confirmed by format validators.

One automaton finds every magic number in a value's bytes in one pass. At each
place the format's validator walks the structure (chunks, blocks, markers,
lengths, check sums) to its end; what passes is media of that type and extent.
The type at the start corrects a declared one, and media found further on,
outside of what was found before, can be carved out.

Values are handled where they lie, one at a time and whole; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "application/octet-stream"
FRAME = 192  # payload bytes are a positive multiple of this
RATE = 8000  # samples a second of stored audio


@dataclass(frozen=True)
class Found:
    type: str
    start: int
    end: int


# --- validators: the end of valid media at ``at``, or -1


CRC_POLYNOMIAL = 0xEDB88320  # fixed value: of the CRC-32 of zlib, bits in reverse
CRC_STEP = 1 << 16


def _times(a: int, b: int) -> int:
    """Product of two polynomials over bits, modulo the CRC's; the highest bit is 1."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ CRC_POLYNOMIAL if b & 1 else b >> 1
    return out


def _power(bits: int) -> int:
    """The polynomial x to the power of ``bits``."""
    out, square = 1 << 31, 1 << 30
    while bits:
        if bits & 1:
            out = _times(out, square)
        square, bits = _times(square, square), bits >> 1
    return out


class Value:
    """A value's bytes and what is known of them: each place is walked once, however many magics lead there."""

    def __init__(self, data: bytes):
        self.b = data
        self.ends: dict[tuple, int] = {}
        self.links: dict[int, tuple] = {}

    def follow(self, kind: str, at: int, step) -> int:
        """The end of a chain of parts. ``step`` gives a part's follower and None, or None and the end (-1: broken)."""
        path = []
        while (kind, at) not in self.ends:
            path.append(at)
            on, end = step(self, at)
            if on is None:
                self.ends[kind, at] = end
            else:
                at = on
        end = self.ends[kind, at]
        self.ends.update(((kind, p), end) for p in path)
        return end

    @cached_property
    def crcs(self) -> list[int]:
        out = [0]
        for at in range(0, len(self.b), CRC_STEP):
            out.append(zlib.crc32(self.b[at : at + CRC_STEP], out[-1]))
        return out

    def crc(self, start: int, end: int) -> int:
        """Check sum of a part, from those of beginnings of the value if it is long."""
        if end - start <= 2 * CRC_STEP:
            return zlib.crc32(self.b[start:end])
        to = [zlib.crc32(self.b[x - x % CRC_STEP : x], self.crcs[x // CRC_STEP]) for x in (start, end)]
        return to[1] ^ _times(_power(8 * (end - start)), to[0])

    def places(self, mark: bytes) -> list[int]:
        out, p = [], self.b.find(mark)
        while p >= 0:
            out.append(p)
            p = self.b.find(mark, p + 1)
        return out

    @cached_property
    def zip_ends(self) -> dict[int, int]:
        """Where archives start, by the end records, and where they end."""
        out: dict[int, int] = {}
        for p in self.places(b"PK\5\6"):
            if p + 22 <= len(self.b):
                size, offset, comment = struct.unpack_from("<IIH", self.b, p + 12)
                if p + 22 + comment <= len(self.b):
                    out.setdefault(p - offset - size, p + 22 + comment)
        return out

    @cached_property
    def pdf_marks(self) -> tuple[list[int], list[int]]:
        return self.places(b"startxref"), self.places(b"%%EOF")

    def link_chunks(self, at: int) -> None:
        """Note for each chunk from ``at`` on: its follower, its kind as a bit, its number from the last one on, a far follower, and the kinds up to there.

        Far followers are spread so that a chunk on the chain is reached in a number of jumps that grows as the logarithm of its length.
        """
        path = []
        while at not in self.links and at + 8 <= len(self.b):
            path.append(at)
            size = struct.unpack_from("<I", self.b, at + 4)[0]
            at += 8 + size + (size & 1)
        number = lambda p: self.links[p][2] if p in self.links else 0
        for p in reversed(path):
            kind = CHUNK_BITS.get(self.b[p : p + 4], 0)
            count, near, kinds = self.links[at][2:] if at in self.links else (0, None, 0)
            if near in self.links and count - number(near) == number(near) - number(self.links[near][3]):
                self.links[p] = (at, kind, count + 1, self.links[near][3], kind | kinds | self.links[near][4])
            else:
                self.links[p] = (at, kind, count + 1, at, kind)
            at = p

    def chunks_to(self, at: int, end: int) -> tuple[int, int]:
        """Where the chunks from ``at`` on leave no room for another before ``end``, and the kinds of them all."""
        kinds = 0
        self.link_chunks(at)
        while at + 8 <= end:
            on, kind, _, far, over = self.links[at]
            at, kinds = (far, kinds | over) if far + 8 <= end else (on, kinds | kind)
        return at, kinds


def _png(v: Value, at: int) -> int:
    return v.follow("png", at + 8, _png_chunk) if v.b[at + 8 : at + 16] == b"\0\0\0\x0dIHDR" else -1


def _png_chunk(v: Value, p: int) -> tuple:
    if p + 12 > len(v.b):
        return None, -1
    size, kind = struct.unpack_from(">I4s", v.b, p)
    end = p + 12 + size
    if end > len(v.b) or v.crc(p + 4, end - 4) != struct.unpack_from(">I", v.b, end - 4)[0]:
        return None, -1
    return (None, end) if kind == b"IEND" else (end, None)


def _jpeg(v: Value, at: int) -> int:
    return v.follow("jpeg", at + 2, _jpeg_marker)


def _jpeg_marker(v: Value, p: int, scanned: bool = False) -> tuple:
    """Segments before the first scan; those after it are a chain of their own."""
    b = v.b
    if p + 4 > len(b) or b[p] != 0xFF:
        return None, -1
    marker = b[p + 1]
    if marker == 0xFF:
        return p + 1, None
    if marker == 0x01 or 0xD0 <= marker <= 0xD8:
        return None, -1
    if marker == 0xD9:
        return None, p + 2 if scanned else -1
    size = struct.unpack_from(">H", b, p + 2)[0]
    if size < 2:
        return None, -1
    p += 2 + size
    if marker != 0xDA:
        return p, None
    p = v.follow("jpeg data", p, _jpeg_data)
    if p < 0 or b[p + 1] == 0xD9:
        return None, p + 2 if p >= 0 else -1
    return (p, None) if scanned else (None, v.follow("jpeg after a scan", p, _jpeg_later))


def _jpeg_data(v: Value, p: int) -> tuple:
    """Entropy-coded data: up to the next byte 255 that begins a real marker."""
    p = v.b.find(b"\xff", p)
    if p < 0 or p + 1 >= len(v.b):
        return None, -1
    return (p + 2, None) if v.b[p + 1] == 0 or 0xD0 <= v.b[p + 1] <= 0xD7 else (None, p)


def _jpeg_later(v: Value, p: int) -> tuple:
    return _jpeg_marker(v, p, True)


def _gif(v: Value, at: int) -> int:
    if at + 13 > len(v.b):
        return -1
    flags = v.b[at + 10]
    return v.follow("gif", at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), _gif_block)


def _gif_block(v: Value, p: int, image: bool = False) -> tuple:
    """Blocks before the first image; those after it are a chain of their own."""
    b = v.b
    if p >= len(b):
        return None, -1
    if b[p] == 0x3B:
        return None, p + 1 if image else -1
    if b[p] == 0x21:
        end = v.follow("gif data", p + 2, _gif_data)
        return (end, None) if end > 0 else (None, -1)
    if b[p] != 0x2C or p + 10 > len(b):
        return None, -1
    flags = b[p + 9]
    end = v.follow("gif data", p + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), _gif_data)
    if end < 0 or image:
        return (end, None) if end > 0 else (None, -1)
    return None, v.follow("gif after an image", end, _gif_later)


def _gif_later(v: Value, p: int) -> tuple:
    return _gif_block(v, p, True)


def _gif_data(v: Value, p: int) -> tuple:
    if p >= len(v.b):
        return None, -1
    return (p + v.b[p] + 1, None) if v.b[p] else (None, p + 1)


#: Kinds of chunks that types of RIFF media need, as bits.
CHUNK_BITS = {b"fmt ": 1, b"data": 2, b"LIST": 4}


def _riff(form: bytes, needed: int):
    def end_of(v: Value, at: int) -> int:
        if at + 12 > len(v.b) or v.b[at + 8 : at + 12] != form:
            return -1
        end = at + 8 + struct.unpack_from("<I", v.b, at + 4)[0]
        if end > len(v.b):
            return -1
        p, kinds = v.chunks_to(at + 12, end)
        return end if at + 12 < p and end <= p <= end + 1 and kinds & needed == needed else -1

    return end_of


def _bmp(v: Value, at: int) -> int:
    b = v.b
    if at + 30 > len(b):
        return -1
    size, reserved, offset, header = struct.unpack_from("<IIII", b, at + 2)
    fits = reserved == 0 and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= offset <= size <= len(b) - at
    return at + size if fits else -1


def _ogg(v: Value, at: int) -> int:
    return v.follow("ogg", at, _ogg_page)


def _ogg_page(v: Value, p: int) -> tuple:
    b = v.b
    if p + 27 > len(b) or b[p : p + 5] != b"OggS\0":
        return None, -1
    count = b[p + 26]
    end = p + 27 + count + sum(b[p + 27 : p + 27 + count])
    if p + 27 + count > len(b) or end > len(b):
        return None, -1
    return (None, end) if b[p + 5] & 4 else (end, None)


def _gzip(v: Value, at: int) -> int:
    """Members are inflated each on its own: one that breaks costs what it gave up to there."""
    b = v.b
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return -1
    inflate = zlib.decompressobj(31)
    p = at
    try:
        while p < len(b) and not inflate.eof:
            inflate.decompress(b[p : p + 65536], 1 << 20)
            while inflate.unconsumed_tail:
                inflate.decompress(inflate.unconsumed_tail, 1 << 20)
            p += 65536
    except zlib.error:
        return -1
    return min(p, len(b)) - len(inflate.unused_data) if inflate.eof else -1


def _zip(v: Value, at: int) -> int:
    return v.zip_ends.get(at, -1)


def _pdf(v: Value, at: int) -> int:
    if not v.b[at + 5 : at + 8].replace(b".", b"").isdigit():
        return -1
    for marks in v.pdf_marks:
        n = bisect_left(marks, at)
        if n == len(marks):
            return -1
        at = marks[n]
    return at + 5


#: Magic bytes, media type, validator; one magic may begin several types.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"RIFF", "audio/wav", _riff(b"WAVE", 3)),
    (b"RIFF", "image/webp", _riff(b"WEBP", 0)),
    (b"RIFF", "video/avi", _riff(b"AVI ", 4)),
    (b"BM", "image/bmp", _bmp),
    (b"OggS", "audio/ogg", _ogg),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
)


def automaton(signatures: tuple = SIGNATURES) -> ahocorasick.Automaton:
    """Aho-Corasick automaton of all magics; each gives its length and signature numbers."""
    numbers: dict[bytes, list[int]] = {}
    for n, (magic, _, _) in enumerate(signatures):
        numbers.setdefault(magic, []).append(n)
    found = ahocorasick.Automaton()
    for magic, at in numbers.items():
        found.add_word(magic.decode("latin-1"), (len(magic), tuple(at)))
    found.make_automaton()
    return found


def sniff(data: bytes, magics: ahocorasick.Automaton | None = None) -> list[Found]:
    """Confirmed media in ``data``, by start. Media inside other media is listed too."""
    magics = magics or automaton()
    found, value = [], Value(data)
    for last, (size, numbers) in magics.iter(data.decode("latin-1")):
        start = last - size + 1
        for n in numbers:
            end = SIGNATURES[n][2](value, start)
            if end > start:
                found.append(Found(SIGNATURES[n][1], start, end))
                break
    return sorted(found, key=lambda f: (f.start, -f.end))


def corrected(declared: str | None, found: list[Found]) -> str:
    """The type at the start of the value, else the declared one, else the unknown type."""
    return found[0].type if found and found[0].start == 0 else declared or UNKNOWN


def carved(data: bytes, found: list[Found]) -> list[bytes]:
    """Media after the start of ``data``, outermost only within what follows the start's own header."""
    out, reach = [], 0
    for f in found:
        if f.start > 0 and f.start >= reach:
            out.append(data[f.start : f.end])
            reach = f.end
    return out


# --- a payload stored as audio of 8-bit samples


def to_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled with spaces to whole frames, at least one; and their number before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(data) // FRAME)) * FRAME
    return data.ljust(size, b" "), len(data)


def to_wav(payload: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def wav_samples(media: bytes) -> bytes:
    """The bytes of the data chunk of a confirmed audio value."""
    p = 12
    while p + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, p)
        if kind == b"data":
            return media[p + 8 : p + 8 + size]
        p += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def feature(samples: bytes, kind: str, embedded: int) -> str:
    """Type, duration, level, loudness, crossings of the middle, and how much media the samples hold."""
    x = np.frombuffer(samples, np.uint8)
    mean = x.mean(dtype=np.float64)
    rms = 0.0
    crossings = 0
    for at in range(0, len(x), 1 << 20):
        part = x[at : at + (1 << 20) + 1]
        rms += float(((part[: 1 << 20].astype(np.float32) - 128) ** 2).sum(dtype=np.float64))
        above = part >= 128
        crossings += int((above[1:] != above[:-1]).sum())
    return f"{kind};rate={RATE};seconds={len(x) / RATE:.3f};mean={mean:.4f};rms={(rms / len(x)) ** 0.5:.4f};crossings={crossings};embedded={embedded}"


@F.pandas_udf(T.BinaryType())
def stored(texts: pd.Series) -> pd.Series:
    return pd.Series([to_wav(to_payload(t)[0]) for t in texts])


READ = T.StructType(
    [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType())]
    + [T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("media_type", T.StringType()), T.StructField("feature", T.StringType())]
)


@F.pandas_udf(READ)
def read_back(values: pd.Series) -> pd.DataFrame:
    magics = automaton()
    rows = []
    for value in values:
        media = bytes(value)
        found = sniff(media, magics)
        kind = corrected(UNKNOWN, found)
        samples = wav_samples(media[: found[0].end]) if kind == "audio/wav" else b""
        inner = len(carved(media, found))
        rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), kind, feature(samples, kind, inner) if samples else kind))
    return pd.DataFrame(rows, columns=[f.name for f in READ])


def with_media(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Add ``out``: the text's payload as audio of 8-bit samples. Null texts are stored as empty ones."""
    return docs.withColumn(out, stored(F.col(text)))


SNIFFED = T.StructType([T.StructField("type", T.StringType()), T.StructField("embedded", T.ArrayType(T.BinaryType()))])


def with_sniffed(df: DataFrame, media: str = "media", declared: str | None = None, out: str = "sniffed") -> DataFrame:
    """Add ``out``: the corrected type of each value and the media carved out of it. Null values have null."""

    @F.pandas_udf(SNIFFED)
    def sniffed(values: pd.Series, said: pd.Series) -> pd.DataFrame:
        magics = automaton()
        rows = []
        for value, name in zip(values, said):
            found = sniff(bytes(value), magics) if value is not None else []
            rows.append((corrected(name, found), carved(bytes(value), found)) if value is not None else (name, []))
        return pd.DataFrame(rows, columns=["type", "embedded"])

    said = F.col(declared) if declared else F.lit(None).cast("string")
    return df.withColumn(out, F.when(F.col(media).isNotNull(), sniffed(F.col(media), said)))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: sizes and digests of the payload as stored and read back, and its features."""
    rows = with_media(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes")
    return rows.select(F.col("key").alias(key), size, read_back(F.col("media")).alias("r")).select(key, "n_bytes", "r.*")
